"""Schedules: how they begin, how due ones advance, and what firing them does to the queue."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import cron
from millrace.operators.queue import cap_backlog, lease_claims, under_caps

LONG_MAX = (1 << 63) - 1
KINDS = ("cron", "interval", "oneshot")


class ScheduleError(ValueError):
    """A schedule that can't be."""


@dataclass(frozen=True)
class Schedule:
    """A schedule as it is first stored. spec: the cron fields, the period in nanoseconds as text, or empty."""

    id: str
    kind: str
    target_type: str
    spec: str
    next_fire_time: int
    missed: str = "skip"

    def __post_init__(self):
        if not self.id or not self.target_type or self.kind not in KINDS:
            raise ScheduleError(f"a schedule needs an id, a type and a kind: {self}")

    def catching_up(self) -> Schedule:
        """Records the wish to catch up. All missed slots still make one run, as with the default."""
        return Schedule(self.id, self.kind, self.target_type, self.spec, self.next_fire_time, "catchup")


def cron_schedule(id_: str, type_: str, spec: str, anchor: int) -> Schedule:
    """First fires at the first slot after the anchor, in UTC like all later ones."""
    try:
        first = cron.next_after(spec, anchor)
    except cron.CronError as e:
        raise ScheduleError(f"{id_}: {e}") from e
    return Schedule(id_, "cron", type_, spec, first)


def interval_schedule(id_: str, type_: str, period: int, anchor: int) -> Schedule:
    """First fires a period after the anchor."""
    if period <= 0 or anchor + period > LONG_MAX:
        raise ScheduleError(f"{id_}: the period must be positive and end in time: {period}")
    return Schedule(id_, "interval", type_, str(period), anchor + period)


def oneshot_schedule(id_: str, type_: str, at: int) -> Schedule:
    """Fires once and is gone."""
    return Schedule(id_, "oneshot", type_, "", at)


def run_id(schedule: str = "id", slot: str = "next_fire_time"):
    """The id of a slot's run: the same slot again makes no second run."""
    return F.concat(F.lit("sched:"), F.col(schedule), F.lit(":"), F.col(slot).cast("string"))


def lease_key(schedule: str = "id"):
    return F.concat(F.lit("schedule:"), F.col(schedule))


def advance(schedules: DataFrame, now: int) -> DataFrame:
    """Due schedules (not paused, next_fire_time <= now) with ``next_slot``, the first one after now, and ``broken``: a spec that can't be read or
    whose next slot can't be told. All missed slots count as one. A one-shot has no next slot.

    Intervals advance in closed form, by one division. Cron specs are evaluated once each, in Arrow batches.
    """
    due = schedules.where((F.col("paused") == 0) & (F.col("next_fire_time") <= now))
    specs = due.where("kind = 'cron'").select("spec").distinct()

    def slots(batches):
        for b in batches:
            found = []
            for spec in b.column(0).to_pylist():
                try:
                    found.append(cron.next_after(spec or "", now))
                except cron.CronError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["spec", "__cron"])

    table = specs.mapInArrow(slots, "spec string, __cron long")
    period = F.expr("try_cast(spec AS BIGINT)")
    steps = F.expr(f"CASE WHEN try_cast(spec AS BIGINT) > 0 THEN (cast({now} as decimal(38,0)) - next_fire_time) div try_cast(spec AS BIGINT) + 1 END").cast("decimal(38,0)")
    to = steps * period.cast("decimal(19,0)") + F.col("next_fire_time")
    interval = F.when(to <= F.lit(LONG_MAX).cast("decimal(38,0)"), to.cast("long"))
    out = due.join(table, "spec", "left").withColumn("next_slot", F.when(F.col("kind") == "cron", F.col("__cron")).when(F.col("kind") == "interval", interval))
    broken = ~F.col("kind").isin(*KINDS) | (F.col("kind").isin("cron", "interval") & F.col("next_slot").isNull())
    return out.select("id", "kind", "spec", "target_type", "next_fire_time", "next_slot", F.coalesce(broken, F.lit(True)).alias("broken"))


def fire_due(schedules: DataFrame, queue: DataFrame, leases: DataFrame, owner: str, now: int, ttl: int, caps: dict[str, int] | None = None, global_cap: int = 0) -> DataFrame:
    """What firing the due schedules does, in order of their ids: one row each that this owner's lease can be had for.

    run_id, target_type: the run of the slot. fired: it joins the queue now. missed: the caps, which weigh running and pending items,
    left no room. action: ``advance`` to next_slot (recurring ones, also when missed), ``delete`` (a one-shot that fired), ``retain`` (a
    one-shot that was missed stays due) or ``pause`` (broken). A slot whose run is already queued adds none and counts as admitted.
    """
    due = advance(schedules, now).withColumn("run_id", run_id())
    asked = due.select("id", lease_key().alias("workflow_id"), F.lit(owner).alias("owner_id"))
    mine = lease_claims(leases, asked, now, ttl).where("granted").select("id", "fencing_token", "expiry")
    due = due.join(mine, "id").join(queue.select(F.col("workflow_id").alias("run_id"), F.lit(True).alias("__there")), "run_id", "left")
    new = due.where("NOT broken AND __there IS NULL").select("id", F.col("target_type").alias("type"))
    if (caps and any(c > 0 for c in caps.values())) or global_cap > 0:
        new = under_caps(new, cap_backlog(queue).withColumnRenamed("backlog", "running"), caps or {}, global_cap, ("id",))
    out = due.join(new.select("id", F.lit(True).alias("__new")), "id", "left")
    fired = F.coalesce("__new", F.lit(False))
    missed = ~F.col("broken") & ~fired & F.col("__there").isNull()
    action = F.when(F.col("broken"), "pause").when(F.col("kind") != "oneshot", "advance").when(missed, "retain").otherwise("delete")
    return out.select("id", "run_id", "target_type", fired.alias("fired"), missed.alias("missed"), action.alias("action"), F.coalesce("next_slot", "next_fire_time").alias("next_fire_time"), "fencing_token", "expiry")
