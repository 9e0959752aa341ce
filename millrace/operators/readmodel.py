"""Read-model operators over the queue, leases, runs and steps of all runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "skipped", "bypassed", "compensated", "compensation_failed")
STATUSES = ("pending", "running", "completed", "failed", "skipped", "waiting", "bypassed", "compensated", "compensation_failed")


def count(name: str):
    return F.count("*").cast("long").alias(name)


def of_types(queue: DataFrame, only: tuple[str, ...] = (), but: tuple[str, ...] = ()) -> DataFrame:
    """Items of the types in ``only`` (none given: of all types), without those in ``but``. An item without a type is of no listed one."""
    out = queue.where(F.col("type").isin(*only)) if only else queue
    return out.where(~F.coalesce(F.col("type").isin(*but), F.lit(False))) if but else out


def queue_counts(queue: DataFrame, type_: str | None = None) -> DataFrame:
    """Items by state, of one type or all; states without items are absent."""
    return (queue if type_ is None else queue.where(F.col("type") == type_)).groupBy("state").agg(count("n"))


def queue_counts_by_type(queue: DataFrame) -> DataFrame:
    return queue.groupBy("type", "state").agg(count("n"))


def in_flight(queue: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Claimed items that have a lease. A lease is live up to and including its expiry. Claims without lease are in ``orphaned_claims``."""
    return queue.where("state = 'claimed'").join(leases, "workflow_id").select("workflow_id", "type", "owner_id", "expiry", "fencing_token", "enqueued_at", (F.col("expiry") >= now).alias("lease_live"))


def orphaned_claims(queue: DataFrame, leases: DataFrame) -> DataFrame:
    """Claimed items without any lease: neither in flight nor stuck, and never reclaimed."""
    return queue.where("state = 'claimed'").join(leases, "workflow_id", "left_anti").select("workflow_id", "type", "enqueued_at")


def stuck_work(queue: DataFrame, leases: DataFrame, now: int, older_than: int, types: tuple[str, ...] = ()) -> DataFrame:
    """Items that will not move by themselves, and why: a lapsed claim; a type that nobody registered (only if types are given); pending for too long."""
    reason = F.when(F.col("state") == "claimed", F.lit("lapsed_claimed"))
    if types:
        reason = reason.when(~F.col("type").isin(*types), F.lit("unregistered_type"))
    reason = reason.when(F.col("enqueued_at") < older_than, F.lit("too_old_pending"))
    open_ = queue.where("state IN ('pending', 'claimed')").join(leases.select("workflow_id", "expiry"), "workflow_id", "left")
    return open_.where((F.col("state") == "pending") | (F.col("expiry") < now)).withColumn("reason", reason).where("reason IS NOT NULL").select("workflow_id", "type", "state", "enqueued_at", "reason")


def worker_health(leases: DataFrame, now: int) -> DataFrame:
    """Leases of each owner, and how many of them are live."""
    return leases.groupBy("owner_id").agg(count("leases"), F.count_if(F.col("expiry") >= now).cast("long").alias("live"))


def workflow_status(queue: DataFrame, leases: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Each item with its lease, if any, and its steps by status."""
    steps = nodes.where("status <> ''").groupBy("workflow_id").pivot("status", ["completed", "failed", "waiting", "pending", "bypassed"]).agg(F.count(F.lit(1)))
    steps = steps.select("workflow_id", *(F.coalesce(s, F.lit(0)).cast("long").alias(f"n_{s}") for s in ("completed", "failed", "waiting", "pending", "bypassed")))
    joined = queue.join(leases, "workflow_id", "left").join(steps, "workflow_id", "left").fillna(0, [c for c in steps.columns if c != "workflow_id"])
    return joined.select("workflow_id", "state", "owner_id", F.coalesce(F.col("expiry") >= now, F.lit(False)).alias("lease_live"), *[c for c in steps.columns if c != "workflow_id"])


def node_status_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("status <> ''").groupBy("workflow_id", "status").agg(count("n"))


def list_by_node_status(nodes: DataFrame, status: str, workflows: DataFrame | None = None, since: int = 0) -> DataFrame:
    """Runs with a step in the status; with since, only those updated then or later."""
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    found = nodes.where(F.col("status") == status).select("workflow_id").distinct()
    return found if not since else found.join(workflows.where(F.col("updated_at") >= since).select(F.col("id").alias("workflow_id")), "workflow_id")


def list_rolling_back(workflows: DataFrame, since: int = 0) -> DataFrame:
    return workflows.where(F.col("rolling_back") & (F.col("updated_at") >= since)).select("id", "updated_at")


def list_pending(queue: DataFrame, older_than: int) -> DataFrame:
    return queue.where((F.col("state") == "pending") & (F.col("enqueued_at") < older_than)).select("workflow_id", "type", "enqueued_at")


def reclaimable(queue: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Claimed items whose lease has lapsed."""
    return queue.where("state = 'claimed'").join(leases.where(F.col("expiry") < now), "workflow_id", "left_semi").select("workflow_id", "type", "enqueued_at")


def operation_stats(rows: DataFrame, operation: str, value: str) -> DataFrame:
    """count, total, least, most and whole average of an integer measure for each operation."""
    v = F.col(value)
    out = rows.groupBy(F.col(operation).alias("operation")).agg(count("n"), F.sum(v).cast("long").alias("total"), F.min(v).cast("long").alias("least"), F.max(v).cast("long").alias("most"))
    return out.withColumn("average", F.expr("total div n"))
