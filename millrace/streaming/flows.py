"""Structured Streaming over runs: signals and new items flow into the store, waits flow out as they fall due, and events are counted by window.

Streams are DataFrames from any source. What is written is keyed, so a micro-batch that is tried again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WAITS_DDL = "workflow_id string, node_name string, fire_at long"


def deliver(store, signals: DataFrame) -> DataStreamWriter:
    """Delivers ``signals(workflow_id, sig_id, name, payload, enqueued_at, seq)``: one commit a micro-batch, of each signal the delivery with
    the largest seq. Start it with a checkpoint location."""

    def batch(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("workflow_id", "sig_id").agg(F.max_by(F.struct("name", "payload", "enqueued_at"), "seq").alias("s"))
        store.commit(store.change_rows("signals", last.select("workflow_id", F.col("sig_id").alias("__key"), "s.*"), "__key"))

    return signals.writeStream.foreachBatch(batch)


def take_in(store, items: DataFrame, now) -> DataStreamWriter:
    """Enqueues ``items(workflow_id, type, input)``: one commit a micro-batch, only items that the queue does not know. now(): the clock."""
    return items.writeStream.foreachBatch(lambda rows, _: store.enqueue_many(rows, now()))


def due(waits: DataFrame, at: str = "at", late: str = "10 seconds") -> DataFrame:
    """``waits(workflow_id, node_name, fire_at, at)``, where fire_at is in nanoseconds, null to disarm, and ``at`` is event time: one row for each
    wait once event time (less ``late``) has passed its fire_at. The first arming holds; a wait that was told is forgotten.

    Custom state, keyed by run and step, with event-time timers: the keys are spread over the state store's partitions.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (fire_at,) = state.get
            state.remove()
            yield pd.DataFrame({"workflow_id": [key[0]], "node_name": [key[1]], "fire_at": [fire_at]})
            return
        rows = pd.concat(batches).sort_values("at")
        held = state.get[0] if state.exists else None
        for fire_at in rows["fire_at"]:
            held = None if pd.isna(fire_at) else held if held is not None else int(fire_at)
        if held is None:
            if state.exists:
                state.remove()
            return
        if held // 1_000_000 <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({"workflow_id": [key[0]], "node_name": [key[1]], "fire_at": [held]})
            return
        state.update((held,))
        state.setTimeoutTimestamp(held // 1_000_000)

    keyed = waits.select("workflow_id", "node_name", "fire_at", F.col(at).alias("at")).withWatermark("at", late)
    return keyed.groupBy("workflow_id", "node_name").applyInPandasWithState(step, WAITS_DDL, "fire_at long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed(events: DataFrame, at: str, by: list[str], window: str, late: str) -> DataFrame:
    """Events by window and key; a window is told once, when event time has passed its end by ``late``. Later events are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").cast("long").alias("n")).select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), *by, "n")


def latest(changes: DataFrame, keys: list[str], values: list[str], version: str = "version") -> DataFrame:
    """The last version of each key so far, for a sink in update mode; a stream of changes as ``timeline.latest_state`` folds a table."""
    last = F.max_by(F.struct(*values), version)
    return changes.groupBy(*keys).agg(last.alias("s"), F.max(version).alias(version)).select(*keys, version, *(F.col(f"s.{v}").alias(v) for v in values))
