"""Timers, signals, schedules, change capture and branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def due_timers(waits: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Waits that are due, of steps that wait, in runs without a hard failure."""
    waiting = nodes.where("status = 'waiting'").select("workflow_id", "node_name")
    broken = nodes.where("status = 'failed' AND NOT continue_on_error").select("workflow_id").distinct()
    return waits.where(F.col("fire_at") <= now).join(waiting, ["workflow_id", "node_name"]).join(broken, "workflow_id", "left_anti").select("workflow_id", "node_name", "fire_at")


def signal_mailbox(signals: DataFrame) -> DataFrame:
    """The last delivery of each signal: a redelivery replaces the payload."""
    last = F.max_by(F.struct("name", "payload", "enqueued_at"), "seq")
    return signals.groupBy("workflow_id", "sig_id").agg(last.alias("s")).select("workflow_id", "sig_id", "s.*")


def signal_take_first(mailbox: DataFrame) -> DataFrame:
    """The signal that each run takes for each name: the first by id, whatever the time."""
    return mailbox.groupBy("workflow_id", "name").agg(F.min("sig_id").alias("sig_id"), F.min_by("payload", "sig_id").alias("payload"))


def due_schedules(schedules: DataFrame, now: int) -> DataFrame:
    return schedules.where((F.col("paused") == 0) & (F.col("next_fire_time") <= now)).select("id", "kind", "next_fire_time")


def interval_advance(schedules: DataFrame, now: int) -> DataFrame:
    """Due interval schedules: the slot that fires, how many were missed, and the next slot after now, in closed form."""
    due = schedules.where("kind = 'interval' AND paused = 0").where(F.col("next_fire_time") <= now)
    missed = F.expr(f"({now} - next_fire_time) div period")
    return due.select("id", F.col("next_fire_time").alias("slot"), missed.cast("long").alias("missed"), (F.col("next_fire_time") + (missed + 1) * F.col("period")).cast("long").alias("next_slot"), F.concat(F.lit("sched:"), "id", F.lit(":"), F.col("next_fire_time").cast("string")).alias("run_id"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that turn ``before`` into ``after``: I, U or D. Null equals null; a double differs from one of another bit pattern, so -0.0 from 0.0."""
    b = before.select(*keys, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__was"))
    a = after.select(*keys, *values, F.lit(True).alias("__is"))
    kinds = dict(after.dtypes)

    def same(v: str) -> Column:
        x, y = F.col(v), F.col(f"__{v}")
        if kinds[v] not in ("double", "float"):
            return x.eqNullSafe(y)
        return x.eqNullSafe(y) & ((x != 0) | (F.coalesce(x.cast("string"), F.lit("")) == F.coalesce(y.cast("string"), F.lit(""))) | x.isNull())

    equal = F.lit(True)
    for v in values:
        equal = equal & same(v)
    op = F.when(F.col("__was").isNull(), "I").when(F.col("__is").isNull(), "D").when(~equal, "U")
    return a.join(b, keys, "full").withColumn("op", op).where("op IS NOT NULL").select(*keys, "op", *values)


def latest_state(log: DataFrame, keys: list[str], values: list[str], version: str = "version") -> DataFrame:
    """A change log folded: of each key the last version, without deleted ones."""
    last = F.max_by(F.struct("op", *values), version)
    return log.groupBy(*keys).agg(last.alias("s")).where("s.op <> 'D'").select(*keys, *(f"s.{v}" for v in values))


def delta(rows: DataFrame, dirty: DataFrame, keys: list[str]) -> DataFrame:
    """Only the rows whose keys were touched."""
    return rows.join(dirty, keys, "left_semi")


def typed_kv(kv: DataFrame) -> DataFrame:
    """Values by declared kind (0 integer, 1 boolean, 2 double, 3 string); an integer is also readable as a double, nothing else widens."""
    k = F.col("kind")
    return kv.select("workflow_id", "key", F.when(k == 0, F.col("i_val")).alias("as_long"), F.when(k == 1, F.col("i_val") != 0).alias("as_boolean"), F.when(k == 2, F.col("f_val")).when(k == 0, F.col("i_val").cast("double")).alias("as_double"), F.when(k == 3, F.col("s_val")).alias("as_string"))


def choice_route(rows: DataFrame, branches: list[tuple[Column, str]], otherwise: str | None = None) -> DataFrame:
    """``target``: the first branch whose condition holds; without one and without a default the query fails."""
    target = None
    for c, name in branches:
        target = F.when(c, name) if target is None else target.when(c, name)
    return rows.withColumn("target", target.otherwise(F.lit(otherwise) if otherwise is not None else F.raise_error(F.lit("no branch matched"))))


def merge_fire(tails: DataFrame) -> DataFrame:
    """What becomes of each merge, from its tails (workflow_id, merge_name, tail, status, continue_on_error).

    It runs once every tail is resolved (completed, or failed and allowed to) or bypassed, and one is resolved; it is bypassed if all
    are; it is skipped if a tail failed or was skipped; else it waits.
    """
    ok = (F.col("status") == "completed") | ((F.col("status") == "failed") & F.col("continue_on_error"))
    past = F.col("status") == "bypassed"
    broken = ~ok & F.col("status").isin("failed", "skipped")
    taken, all_past = F.count_if(ok), F.bool_and(past)
    said = F.when(F.bool_or(broken), "skipped").when(all_past, "bypassed").when(F.bool_and(ok | past), "run").otherwise("waits")
    return tails.groupBy("workflow_id", "merge_name").agg(taken.cast("long").alias("taken"), said.alias("merge"))


def fanout_results(items: DataFrame, base: str) -> DataFrame:
    """Results of a fan-out under their keys: base[i], base.__count__, base.__failed__. items: (workflow_id, idx, result, ok)."""
    each = items.select("workflow_id", F.concat(F.lit(base + "["), F.col("idx").cast("string"), F.lit("]")).alias("key"), F.when(F.col("ok"), F.col("result")).alias("value"))
    failed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("idx")))), lambda x: x.cast("string")), ",")
    by = items.groupBy("workflow_id").agg(F.count("*").cast("string").alias("n"), failed.alias("f"))
    return each.unionByName(by.select("workflow_id", F.lit(base + ".__count__").alias("key"), F.col("n").alias("value"))).unionByName(by.select("workflow_id", F.lit(base + ".__failed__").alias("key"), F.col("f").alias("value")))


def approval_decisions(signals: DataFrame) -> DataFrame:
    """Decisions read from payloads; one that lacks Approved is a rejection; one that can't be read, or whose fields are of another kind, is malformed."""
    doc = F.try_parse_json("payload")
    kind = lambda field: F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))
    odd = lambda field, name: F.coalesce(kind(field) != name, F.lit(False))
    whole = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    broken = ~whole | odd("Approved", "BOOLEAN") | odd("Approver", "STRING") | odd("Comment", "STRING")
    approved = F.coalesce(F.try_variant_get(doc, "$.Approved", "boolean"), F.lit(False))
    return signals.select("workflow_id", "sig_id", F.when(broken, "malformed").when(approved, "approved").otherwise("rejected").alias("decision"))
