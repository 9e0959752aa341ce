"""Reports over runs, steps and the queue: snapshots, operation reports, dispatch counters, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import readmodel as r
from millrace.operators.readmodel import count

#: Signals that a run's mailbox may hold.
MAILBOX = 1 << 16
#: Counters of a dispatcher, in the order they are reported.
COUNTERS = ("reclaims", "fence_rejections", "superseded", "retries", "dead_letters", "missed_fires")


def queue_snapshot(queue: DataFrame, leases: DataFrame, now: int, older_than: int, types: tuple[str, ...] = ()) -> DataFrame:
    """Counts by state, in-flight items, stuck work and worker health as one table ``(part, key, detail, n)``, for tables of one version."""
    parts = [
        r.queue_counts(queue).select(F.lit("count").alias("part"), F.col("state").alias("key"), F.lit("").alias("detail"), "n"),
        r.in_flight(queue, leases, now).select(F.lit("in_flight").alias("part"), F.col("workflow_id").alias("key"), F.when(F.col("lease_live"), "live").otherwise("lapsed").alias("detail"), F.col("fencing_token").cast("long").alias("n")),
        r.stuck_work(queue, leases, now, older_than, types).select(F.lit("stuck").alias("part"), F.col("workflow_id").alias("key"), F.col("reason").alias("detail"), F.col("enqueued_at").alias("n")),
        r.worker_health(leases, now).select(F.lit("worker").alias("part"), F.col("owner_id").alias("key"), F.lit("live").alias("detail"), F.col("live").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def operation_report(rows: DataFrame, operation: str, outcome: str, value: str, sampled: float = 1.0) -> DataFrame:
    """Statistics of each operation, its failures, and its place by falling average. Under sampling the counts are those of the sample."""
    if not 0 < sampled <= 1:
        raise ValueError("sampled must be above 0 and at most 1")
    from pyspark.sql import Window

    stats = r.operation_stats(rows, operation, value)
    failed = rows.groupBy(F.col(operation).alias("operation")).agg(F.count_if(F.col(outcome) == "failed").cast("long").alias("failed"))
    place = F.row_number().over(Window.orderBy(F.desc("average"), "operation"))  # one row an operation: names of code, not of data
    return stats.join(failed, "operation").withColumn("place", place.cast("int"))


def slow_operations(rows: DataFrame, operation: str, value: str, threshold: int) -> DataFrame:
    """Operations whose longest run is above the threshold, slowest first by ``place``."""
    from pyspark.sql import Window

    slow = r.operation_stats(rows, operation, value).where(F.col("most") > threshold)
    return slow.select("operation", "n", "most", F.row_number().over(Window.orderBy(F.desc("most"), "operation")).cast("int").alias("place"))


def active_operations(rows: DataFrame) -> DataFrame:
    """Started and not yet ended operations of each kind; rows: (operation, event) with event ``start`` or ``end``."""
    return rows.groupBy("operation").agg((F.count_if(F.col("event") == "start") - F.count_if(F.col("event") == "end")).cast("long").alias("active"))


def dispatch_counters(events: DataFrame) -> DataFrame:
    """Each dispatch counter, 0 where nothing happened; events: (counter, …). The counters of many workers add up."""
    base = events.sparkSession.createDataFrame([(i, c) for i, c in enumerate(COUNTERS)], "place int, counter string")
    seen = events.where(F.col("counter").isin(*COUNTERS)).groupBy("counter").agg(count("n"))
    return F.broadcast(base).join(seen, "counter", "left").select("place", "counter", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mailbox_guard(signals: DataFrame, most: int = MAILBOX) -> DataFrame:
    """Mailboxes with more signals than a read may bring, with their size; they are refused, not cut."""
    return signals.groupBy("workflow_id").agg(count("n")).where(F.col("n") > most)


def count_skipped(nodes: DataFrame) -> DataFrame:
    """Skipped steps of each run."""
    return nodes.groupBy("workflow_id").agg(F.count_if(F.col("status") == "skipped").cast("long").alias("skipped"))


def ids(rows: DataFrame, column: str, condition: str = "true") -> DataFrame:
    """The ids that hold a condition, each once, in order."""
    return rows.where(condition).select(F.col(column).alias("id")).distinct().orderBy("id")
