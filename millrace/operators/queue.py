"""Queue operators: claims under caps, fenced changes, leases, retries, parking, cancels. Each takes tables and gives the rows that change,
so that one commit moves many items at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.readmodel import count

DONE = ("done", "failed", "cancelled")
#: A depth beyond this, or none at all, marks a damaged row, which is never claimed.
DEEPEST = 64
WAKE = "subworkflow-complete:"


def slots(queue: DataFrame) -> DataFrame:
    """Items that take a slot: claimed and not parked."""
    return queue.where("state = 'claimed' AND parked IS NULL")


def cap_running(queue: DataFrame) -> DataFrame:
    """Slots in use by type."""
    return slots(queue).groupBy("type").agg(count("running"))


def cap_backlog(queue: DataFrame) -> DataFrame:
    """What a new scheduled item is weighed against: slots in use and pending items by type."""
    return queue.where("(state = 'claimed' AND parked IS NULL) OR state = 'pending'").groupBy("type").agg(count("backlog"))


def cap_of(type_: Column, caps: dict[str, int]) -> Column:
    """A type's cap; null (unbounded) for a type without one, for a cap of 0 or less, and for the empty type."""
    limit = F.lit(None).cast("long")
    for t, c in caps.items():
        if c > 0 and t:
            limit = F.when(type_ == t, F.lit(c)).otherwise(limit)
    return limit


def cap_admits(queue: DataFrame, asked: DataFrame, caps: dict[str, int], global_cap: int) -> DataFrame:
    """For each type in ``asked(type)``: may one more scheduled item join the running and pending ones, under its cap and the global one?"""
    by = cap_backlog(queue)
    in_all = by.agg(F.coalesce(F.sum("backlog"), F.lit(0)).alias("n")).first()["n"]
    limit, free = cap_of(F.col("type"), caps), F.lit(global_cap <= 0 or in_all < global_cap)
    out = asked.select("type").distinct().join(by, "type", "left").fillna(0, ["backlog"])
    return out.select("type", "backlog", F.lit(in_all).cast("long").alias("in_all"), ((limit.isNull() | (F.col("backlog") < limit)) & free).alias("admitted"))


def under_caps(gated: DataFrame, running: DataFrame, caps: dict[str, int], global_cap: int, order: tuple[str, ...]) -> DataFrame:
    """The gated items that fit in the free slots, first come first served: the rank within the type is held against the type's free
    slots, then the first ones of all that are left are taken for the global ones. That is what claiming one after another
    gives, as a full type is passed over and a full house ends it. Spark cuts the rank before it shuffles."""
    used = running.agg(F.coalesce(F.sum("running"), F.lit(0)).alias("n")).first()["n"] if global_cap > 0 else 0
    limit = cap_of(F.col("type"), caps)
    free = max(0, global_cap - used) if global_cap > 0 else None
    ranked = gated.withColumn("__r", F.row_number().over(Window.partitionBy("type").orderBy(*order)))
    if free is not None:
        ranked = ranked.where(F.col("__r") <= free)
    ranked = ranked.join(running, "type", "left").where(limit.isNull() | (F.col("__r") <= limit - F.coalesce("running", F.lit(0))))
    if free is not None:
        ranked = ranked.orderBy(*order).limit(free)
    return ranked.drop("__r", "running")


def claim_batch(queue: DataFrame, caps: dict[str, int], global_cap: int) -> DataFrame:
    """Pending items that one batch of claims takes, oldest first, so that neither a type's cap nor the global one is passed.

    Items with a cancel request are not gated: a worker must take them to end them.
    """
    pending = queue.where("state = 'pending'").select("workflow_id", "type", "enqueued_at", "cancel_requested")
    gated = under_caps(pending.where("cancel_requested IS NULL"), cap_running(queue), caps, global_cap, ("enqueued_at", "workflow_id"))
    free = pending.where("cancel_requested IS NOT NULL")
    cols = ["workflow_id", "type", "enqueued_at"]
    return gated.select(*cols, F.lit(True).alias("gated")).unionByName(free.select(*cols, F.lit(False).alias("gated")))


def lease_claims(leases: DataFrame, asked: DataFrame, now: int, ttl: int) -> DataFrame:
    """What becomes of the leases ``asked(workflow_id, owner_id)`` for: a token, or none while another owner's lease lives.

    No lease gives token 1; one that has lapsed (now >= expiry) the next token; the owner's own is refreshed with its token.
    """
    held = leases.select("workflow_id", F.col("owner_id").alias("__owner"), F.col("expiry").alias("__expiry"), F.col("fencing_token").alias("__token"))
    j = asked.join(held, "workflow_id", "left")
    token = F.when(F.col("__token").isNull(), F.lit(1)).when(F.col("__expiry") <= now, F.col("__token") + 1).when(F.col("__owner") == F.col("owner_id"), F.col("__token"))
    return j.withColumns({"granted": token.isNotNull(), "fencing_token": token.cast("long"), "expiry": F.when(token.isNotNull(), F.lit(now + ttl)).cast("long")}).drop("__owner", "__expiry", "__token")


def lease_renewals(leases: DataFrame, held: DataFrame, now: int, ttl: int) -> DataFrame:
    """For each ``held(workflow_id, held_token)``: renewed only under the very token of the lease; else fenced out."""
    j = held.join(leases.select("workflow_id", "fencing_token", "expiry"), "workflow_id", "left")
    same = F.coalesce(F.col("held_token") == F.col("fencing_token"), F.lit(False))
    return j.select("workflow_id", same.alias("renewed"), F.when(same, F.lit(now + ttl)).otherwise(F.col("expiry")).cast("long").alias("expiry"))


def fence_check(leases: DataFrame, held: DataFrame) -> DataFrame:
    """For each ``held(workflow_id, held_token)``: fenced if the lease is gone or has a later token."""
    j = held.join(leases.select("workflow_id", "fencing_token"), "workflow_id", "left")
    return j.select("workflow_id", (F.col("fencing_token").isNull() | (F.col("held_token") < F.col("fencing_token"))).alias("fenced"))


def claim_next(queue: DataFrame, leases: DataFrame, owner: str, now: int, ttl: int, types: tuple[str, ...] = (), caps: dict[str, int] | None = None, global_cap: int = 0, most: int | None = None) -> DataFrame:
    """The change rows of a batch of claims by one owner: oldest first, pending items and claimed ones whose lease has lapsed.

    action ``claim``: the item is claimed, its attempts go up by one, it is no longer parked, and the lease is the owner's under
    fencing_token until expiry. action ``cancel``: a claim that lapsed with a cancel request; it ends as cancelled, whatever the
    caps. A claimed item that takes no new slot (lapsed, not parked) isn't gated, nor is one with a cancel request. Items whose lease
    lives under another owner, or whose depth is damaged, are passed over. ``most`` bounds the claims, not the cancels.
    """
    open_ = queue.where(F.col("depth").between(0, DEEPEST)).where("state IN ('pending', 'claimed')")
    if types:
        open_ = open_.where(F.col("type").isin(*types))
    j = lease_claims(leases, open_.withColumn("owner_id", F.lit(owner)), now, ttl)
    lapsed = leases.where(F.col("expiry") < now).select("workflow_id", F.lit(True).alias("__lapsed"))
    j = j.where("granted").join(lapsed, "workflow_id", "left").where("state = 'pending' OR __lapsed")
    ended = j.where("state = 'claimed' AND cancel_requested IS NOT NULL")
    rest = j.where("NOT (state = 'claimed' AND cancel_requested IS NOT NULL)")
    new_slot = "(state = 'pending' OR parked IS NOT NULL) AND cancel_requested IS NULL"
    order = ("enqueued_at", "workflow_id")
    gated, free = rest.where(new_slot), rest.where(f"NOT ({new_slot})")
    if (caps and any(c > 0 for c in caps.values())) or global_cap > 0:
        gated = under_caps(gated, cap_running(queue), caps or {}, global_cap, order)
    claims = gated.unionByName(free)
    if most is not None:
        claims = claims.orderBy(*order).limit(most)
    cols = ["workflow_id", "type", "enqueued_at"]
    taken = claims.select(*cols, F.lit("claim").alias("action"), F.lit("claimed").alias("state"), (F.col("attempts") + 1).alias("attempts"), "owner_id", "fencing_token", "expiry")
    return taken.unionByName(ended.select(*cols, F.lit("cancel").alias("action"), F.lit("cancelled").alias("state"), "attempts", "owner_id", "fencing_token", "expiry"))


def _fenced(queue: DataFrame, leases: DataFrame, held: DataFrame) -> DataFrame:
    """Claimed items that somebody holds, with whether the holder's token is still good (no later one was given)."""
    j = queue.where("state = 'claimed'").join(held, "workflow_id").join(leases.select("workflow_id", "fencing_token"), "workflow_id", "left")
    return j.withColumn("__ok", F.coalesce(F.col("fencing_token") <= F.col("held_token"), F.lit(False)))


def terminal_flip(queue: DataFrame, leases: DataFrame, held: DataFrame) -> DataFrame:
    """``held(workflow_id, held_token, outcome)``: the state of each claimed item after its holder ends it. With a token that is still good the
    outcome, and the lease is released; else the item stays claimed and the flip counts as rejected. Items that are not claimed give no row."""
    f = _fenced(queue, leases, held)
    return f.select("workflow_id", F.when(F.col("__ok"), F.col("outcome")).otherwise("claimed").alias("state"), F.col("__ok").alias("flipped"), (~F.col("__ok")).alias("fence_rejected"))


def retry_flip(queue: DataFrame, leases: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """``held(workflow_id, held_token)``: after an infrastructure error a claimed item is pending again while attempts < most, else failed; it
    stays as it is if a later token was given."""
    f = _fenced(queue, leases, held)
    state = F.when(~F.col("__ok"), "claimed").when(F.col("attempts") < most, "pending").otherwise("failed")
    return f.select("workflow_id", "attempts", state.alias("state"), F.col("__ok").alias("flipped"))


def parked(queue: DataFrame, leases: DataFrame, held: DataFrame, now: int) -> DataFrame:
    """``held(workflow_id, held_token)``: a claimed item that waits keeps its claim, gives up its slot and starts its attempts anew."""
    return _fenced(queue, leases, held).where("__ok").select("workflow_id", F.lit(0).alias("attempts"), F.lit(now).cast("long").alias("parked"))


def cancels(queue: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """``asked(workflow_id)``: pending items end as cancelled at once; claimed ones get a cancel request, once, which their worker or the next
    one to claim them acts on. Others give no row."""
    open_ = queue.where("state = 'pending' OR (state = 'claimed' AND cancel_requested IS NULL)").join(asked.select("workflow_id").distinct(), "workflow_id", "left_semi")
    return open_.select("workflow_id", F.when(F.col("state") == "pending", "cancelled").otherwise("claimed").alias("state"), F.when(F.col("state") == "claimed", F.lit(now)).otherwise(F.col("cancel_requested")).cast("long").alias("cancel_requested"))


def retry_disposition(queue: DataFrame, leases: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """Claimed items after an infrastructure error: pending again while attempts remain, else failed; superseded if the fencing token held is below the lease's."""
    joined = queue.where("state = 'claimed'").join(leases.select("workflow_id", "fencing_token"), "workflow_id").join(held, "workflow_id")
    next_ = F.when(F.col("held_token") < F.col("fencing_token"), "superseded").when(F.col("attempts") < most, "pending").otherwise("failed")
    return joined.select("workflow_id", "attempts", next_.alias("next_state"))


def enqueue(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Items that are new to the queue, one for each id."""
    return items.dropDuplicates(["workflow_id"]).join(queue.select("workflow_id"), "workflow_id", "left_anti")


def enqueue_children(queue: DataFrame, parents: DataFrame, child_id: Column, type_: str, now: int, signal: Column) -> DataFrame:
    """One child a row of ``parents(workflow_id, depth, …)``, new to the queue: pending, a level deeper, with the address that its end is told to.
    Parents whose depth is damaged, or whose child would lie too deep, get none."""
    made = parents.where(F.col("depth").between(0, DEEPEST - 1)).select(child_id.alias("workflow_id"), F.lit(type_).alias("type"), F.lit(now).cast("long").alias("enqueued_at"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"), (F.col("depth") + 1).cast("int").alias("depth"), F.col("workflow_id").alias("parent_id"), signal.alias("parent_signal"))
    return enqueue(queue, made)


def wake_parents(queue: DataFrame) -> DataFrame:
    """Signals that ended children send their parents; their ids follow from the child's, so sending again changes nothing."""
    ended = queue.where(F.col("state").isin(*DONE)).where("parent_id IS NOT NULL AND parent_id <> ''")
    return ended.select(F.col("parent_id").alias("workflow_id"), F.concat(F.lit(WAKE), "workflow_id").alias("sig_id"), F.col("parent_signal").alias("name"), F.lit("").alias("payload"))


def terminal_states(queue: DataFrame, asked: DataFrame) -> DataFrame:
    """The state of each id in ``asked(workflow_id)``; an id without an item has none, which is no error."""
    return asked.select("workflow_id").join(queue.select("workflow_id", "state"), "workflow_id", "left").select("workflow_id", "state", F.col("state").isNotNull().alias("queued"), F.coalesce(F.col("state").isin(*DONE), F.lit(False)).alias("ended"))
