"""Graphs of steps and the status algebra, for all runs at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.readmodel import TERMINAL


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("workflow_id", "node_name").join(edges.select("workflow_id", F.col("dst").alias("node_name")), ["workflow_id", "node_name"], "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("workflow_id", "node_name").join(edges.select("workflow_id", F.col("src").alias("node_name")), ["workflow_id", "node_name"], "left_anti")


def _longest_paths(rows: pa.Table) -> pa.RecordBatch:
    """Levels of the steps of whole runs. Each edge is followed twice: to find what roots reach, and to take off one level after another."""
    run = rows.column(0).combine_chunks().dictionary_encode()
    n = rows.num_rows
    name = pa.chunked_array([*rows.column(1).chunks, *rows.column(2).chunks]).dictionary_encode().combine_chunks()
    code = np.asarray(name.indices.fill_null(len(name.dictionary))).astype(np.int64)
    wide, of_run = len(name.dictionary) + 1, np.asarray(run.indices).astype(np.int64)
    keys, at = np.unique(np.r_[of_run, of_run] * wide + code, return_inverse=True)
    src, dst, is_edge = at[:n], at[n:], np.asarray(rows.column(3))
    nameless, count = keys % wide == wide - 1, len(keys)
    links = np.unique(src[is_edge] * count + dst[is_edge])
    src, dst = links // count, links % count
    start = np.searchsorted(src, np.arange(count + 1))

    def after(steps: np.ndarray) -> np.ndarray:
        many = start[steps + 1] - start[steps]
        return dst[np.repeat(start[steps] - np.cumsum(many) + many, many) + np.arange(many.sum())]

    root = np.zeros(count, bool)
    root[at[n:][~is_edge]] = True
    root[dst[~nameless[dst]]] = False  # a null is equal to nothing
    reached, now = root.copy(), np.flatnonzero(root)
    while len(now):
        new = after(now)
        now = np.unique(new[~reached[new]])
        reached[now] = True
    left = np.bincount(dst[reached[src]], minlength=count)
    level, now, k = np.full(count, -1), np.flatnonzero(reached & (left == 0)), 0
    while len(now):
        level[now] = k
        new, times = np.unique(after(now), return_counts=True)
        left[new] -= times
        now, k = new[left[new] == 0], k + 1
    told = np.flatnonzero(level >= 0)
    names = keys[told] % wide
    return pa.RecordBatch.from_arrays([run.dictionary.take(pa.array(keys[told] // wide)), name.dictionary.take(pa.array(names, mask=nameless[told])), pa.array(level[told], pa.int32())], names=["workflow_id", "node_name", "level"])


def _levels_of(batches):
    """Rows sorted by run -> levels, for many whole runs at a time."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held, n = [*held, b], n + b.num_rows
        if n >= 100_000:
            other = np.flatnonzero(np.asarray(pc.not_equal(b.column(0), b.column(0)[b.num_rows - 1])))
            if len(other):
                cut = int(other[-1]) + 1
                yield _longest_paths(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held, n = [b.slice(cut)], b.num_rows - cut
    if held:
        yield _longest_paths(pa.Table.from_batches(held))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each step: the longest path from a root, however long or many the paths are. The graph of one run is held in one
    task, and work grows with its steps and edges. A step that is not reached from a root has no level, nor has one on a cycle, or behind
    one, that is reached."""
    wf, name = nodes.schema["workflow_id"].dataType.simpleString(), nodes.schema["node_name"].dataType
    step = nodes.select("workflow_id", F.lit(None).cast(name).alias("src"), F.col("node_name").cast(name).alias("dst"), F.lit(False).alias("is_edge"))
    edge = edges.where("workflow_id IS NOT NULL AND src IS NOT NULL").select(F.col("workflow_id").cast(wf), F.col("src").cast(name), F.col("dst").cast(name), F.lit(True).alias("is_edge"))
    rows = step.where("workflow_id IS NOT NULL").unionByName(edge).repartition("workflow_id").sortWithinPartitions("workflow_id")
    found = rows.mapInArrow(_levels_of, f"workflow_id {wf}, node_name {name.simpleString()}, level int")
    # a null run equals no other: its steps are roots
    return found.unionByName(nodes.where("workflow_id IS NULL").select("workflow_id", "node_name", F.lit(0).alias("level")).distinct())


def edge_resolution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each dependency with its state: resolved if the step it waits for completed, or failed and may."""
    source = nodes.select("workflow_id", F.col("node_name").alias("src"), "status", "continue_on_error")
    resolved = (F.col("status") == "completed") | ((F.col("status") == "failed") & F.col("continue_on_error"))
    return edges.join(source, ["workflow_id", "src"]).select("workflow_id", "src", "dst", "status", resolved.alias("resolved"))


def blocked_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What becomes of steps that wait for dependencies: all of a step's dependencies decide, the first rule that fits wins."""
    e = edge_resolution(nodes, edges)
    flags = e.groupBy("workflow_id", F.col("dst").alias("node_name")).agg(
        F.bool_or(~F.col("resolved") & F.col("status").isin("failed", "skipped")).alias("fail"),
        F.bool_or(~F.col("resolved") & (~F.col("status").isin(*TERMINAL) | (F.col("status") == "compensated"))).alias("open"),
        F.bool_or(F.col("status") == "bypassed").alias("byp"),
        F.bool_or("resolved").alias("res"),
    )
    rule = F.when(F.col("fail"), "skipped").when(F.col("open"), "unassigned").when(F.col("byp") & F.col("res"), "skipped").when(F.col("byp"), "bypassed").otherwise("unassigned")
    return flags.select("workflow_id", "node_name", rule.alias("becomes"))


def run_verdict(nodes: DataFrame) -> DataFrame:
    """Of each run: complete (every step terminal and none failed), terminal, failed, and its first failed step by name."""
    failed = F.col("status").isin("failed", "compensation_failed")
    terminal = F.col("status").isin(*TERMINAL)
    return nodes.groupBy("workflow_id").agg(F.bool_and(terminal & ~failed).alias("complete"), F.bool_and(terminal).alias("terminal"), F.bool_or(failed).alias("failed"), F.min(F.when(failed, F.col("node_name"))).alias("first_failed"))


def saga_partition(nodes: DataFrame) -> DataFrame:
    """Steps of each run as a rollback sees them, as sorted lists: to compensate, failed, skipped."""
    one = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("node_name")))), ",")
    s = F.col("status")
    return nodes.groupBy("workflow_id").agg(one(s.isin("completed", "compensated")).alias("compensate"), one(s.isin("failed", "compensation_failed")).alias("failed"), one(s.isin("skipped", "bypassed")).alias("skipped"))


def rollback_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Completed steps with their place in the rollback: the deepest level first, names in order within it."""
    at = nodes.where("status = 'completed'").select("workflow_id", "node_name").join(levels(nodes, edges), ["workflow_id", "node_name"])
    return at.withColumn("place", F.row_number().over(Window.partitionBy("workflow_id").orderBy(F.desc("level"), "node_name")).cast("int"))


def graph_identity(persisted: DataFrame, current: DataFrame) -> DataFrame:
    """Persisted steps that the present graph lacks; a run with any may not resume. ``current``: step names of each run's graph, or, without a
    workflow_id, of the one graph of all runs."""
    keys = ["workflow_id", "node_name"] if "workflow_id" in current.columns else ["node_name"]
    return persisted.select("workflow_id", "node_name").join(current.select(*keys).distinct(), keys, "left_anti").select("workflow_id", "node_name")
