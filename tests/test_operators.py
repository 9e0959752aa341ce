"""Rules that the tables' rows do not reach."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import cron, ids
from millrace.operators import queue, readmodel, status, timeline

VECTORS = [
    ("* * * * *", "2024-01-01 00:00", "2024-01-01 00:01"),
    ("30 2 * * *", "2024-01-01 00:00", "2024-01-01 02:30"),
    ("30 2 * * *", "2024-01-01 03:00", "2024-01-02 02:30"),
    ("*/15 * * * *", "2024-01-01 00:07", "2024-01-01 00:15"),
    ("*/15 * * * *", "2024-01-01 00:15", "2024-01-01 00:30"),
    ("0 0 1 * *", "2024-12-15 00:00", "2025-01-01 00:00"),
    ("0 0 31 * *", "2024-04-01 00:00", "2024-05-31 00:00"),
    ("0 0 29 2 *", "2024-01-01 00:00", "2024-02-29 00:00"),
    ("0 9-17 * * 1", "2024-01-01 08:00", "2024-01-01 09:00"),
    ("0 0 13 * 5", "2024-01-01 00:00", "2024-01-05 00:00"),
]


@pytest.mark.parametrize(("spec", "after", "want"), VECTORS)
def test_cron(spark, spec, after, want):
    got = spark.range(1).select(cron.next_slot(F.lit(after).cast("timestamp"), spec).cast("string").alias("x")).first().x
    assert got == f"{want}:00"


@pytest.mark.parametrize("spec", ["", "* * * *", "* * * * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "* * * 13 *", "* * * * 7", "*/0 * * * *", "*/x * * * *", "5-1 * * * *", "1,,2 * * * *", "1- * * * *", "5/10 * * * *"])
def test_cron_refuses(spec):
    with pytest.raises(cron.CronError):
        cron.parse(spec)


def test_cron_has_no_match_in_the_gap(spark):
    rng = random.Random(3)
    for _ in range(4):
        spec = f"{rng.choice(['*/7', '3,40', '10-20'])} {rng.choice(['*', '5-7', '23'])} * * {rng.choice(['*', '2', '0,6'])}"
        after = datetime(2024, 2, 27, rng.randrange(24), rng.randrange(60))
        f = cron.parse(spec)
        at = after + timedelta(minutes=1)
        while not (f["minute"][0] >> at.minute & 1 and f["hour"][0] >> at.hour & 1 and f["weekday"][0] >> (at.isoweekday() % 7) & 1):
            at += timedelta(minutes=1)
        got = spark.range(1).select(cron.next_slot(F.lit(str(after)).cast("timestamp"), spec).cast("string").alias("x")).first().x
        assert got == str(at)


def test_digest_has_no_ambiguous_parts(spark):
    row = spark.createDataFrame([("ab", "c", "a", "bc")], "a string, b string, c string, d string")
    got = row.select(ids.idempotency_key(F.col("a"), F.col("b")).alias("x"), ids.idempotency_key(F.col("c"), F.col("d")).alias("y")).first()
    import hashlib
    import struct

    assert got.x == hashlib.sha256(struct.pack("<Q", 2) + b"ab" + b"c").hexdigest() != got.y


def test_changes_tell_signed_zeros_apart(spark):
    a = spark.createDataFrame([("k", 0.0), ("n", float("nan"))], "key string, v double")
    b = spark.createDataFrame([("k", -0.0), ("n", float("nan"))], "key string, v double")
    assert [(r.key, r.op) for r in timeline.changes(a, b, ["key"], ["v"]).collect()] == [("k", "U")]


def test_unknown_status_is_refused(spark):
    with pytest.raises(ValueError):
        readmodel.list_by_node_status(spark.createDataFrame([], "workflow_id string, status string"), "lost")


def test_choice_without_match_fails(spark):
    rows = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(Exception, match="no branch matched"):
        timeline.choice_route(rows, [(F.col("x") > 5, "a")]).collect()


def greedy(rows, caps, total):
    """One claim at a time: the oldest pending item whose caps allow it."""
    running = {}
    for _, t, state, _, parked in rows:
        if state == "claimed" and not parked:
            running[t] = running.get(t, 0) + 1
    out = []
    for wf, t, state, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if state == "pending" and running.get(t, 0) < caps.get(t, 10**9) and sum(running.values()) < total:
            running[t] = running.get(t, 0) + 1
            out.append(wf)
    return sorted(out)


def test_batch_of_claims_equals_single_claims(spark):
    rng = random.Random(5)
    for _ in range(5):
        rows = [(f"w{i}", rng.choice("abc"), rng.choice(["pending", "pending", "claimed"]), rng.randrange(20), rng.choice([None, None, 1])) for i in range(40)]
        caps, total = {"a": rng.randrange(1, 12), "b": rng.randrange(1, 12)}, rng.randrange(1, 40)
        table = spark.createDataFrame(rows, "workflow_id string, type string, state string, enqueued_at long, parked long").withColumn("cancel_requested", F.lit(None).cast("long"))
        assert sorted(r.workflow_id for r in queue.claim_batch(table, caps, total).collect()) == greedy(rows, caps, total)


def test_levels_are_longest_paths(spark):
    rng = random.Random(9)
    nodes, edges, want = [], [], {}
    for w in range(5):
        n = rng.randrange(1, 9)
        level = [0] * n
        for i in range(n):
            nodes.append((str(w), f"n{i}"))
            for j in range(i):
                if rng.random() < 0.4:
                    edges.append((str(w), f"n{j}", f"n{i}"))
                    level[i] = max(level[i], level[j] + 1)
            want[str(w), f"n{i}"] = level[i]
    got = status.levels(spark.createDataFrame(nodes, "workflow_id string, node_name string"), spark.createDataFrame(edges, "workflow_id string, src string, dst string"))
    assert {(r.workflow_id, r.node_name): r.level for r in got.collect()} == want


def test_levels_of_long_chains_and_many_paths(spark):
    """A chain of 150 steps, 30 stacked diamonds (2 ** 30 paths), a step behind a cycle that no root reaches, a cycle that one reaches, and nulls."""
    edges = [("chain", f"c{i}", f"c{i + 1}") for i in range(149)]
    want = {("chain", f"c{i}"): i for i in range(150)}
    for i in range(30):
        edges += [("diamonds", f"t{i}", f"{side}{i}") for side in "lr"] + [("diamonds", f"{side}{i}", f"t{i + 1}") for side in "lr"]
        want |= {("diamonds", f"t{i}"): 2 * i, ("diamonds", f"l{i}"): 2 * i + 1, ("diamonds", f"r{i}"): 2 * i + 1}
    want["diamonds", "t30"] = 60
    edges += [("aside", "x", "y"), ("aside", "y", "x"), ("aside", "y", "b"), ("aside", "a", "b"), ("aside", "a", "b"), ("aside", "b", "lost"), ("aside", "a", None), (None, "a", "b")]
    want |= {("aside", "a"): 0, ("aside", "b"): 1, ("aside", "lost"): 2, ("aside", None): 1, (None, "a"): 0, (None, "b"): 0}
    edges += [("cycle", "a", "b"), ("cycle", "b", "c"), ("cycle", "c", "b"), ("cycle", "c", "d"), ("cycle", "a", "e")]
    want |= {("cycle", "a"): 0, ("cycle", "e"): 1}
    nodes = sorted({(w, x) for w, a, b in edges for x in (a, b) if x not in (None, "lost")}, key=repr) + [("chain", "c0")]
    got = status.levels(spark.createDataFrame(nodes, "workflow_id string, node_name string"), spark.createDataFrame(edges, "workflow_id string, src string, dst string")).collect()
    assert len(got) == len(want) and {(r.workflow_id, r.node_name): r.level for r in got} == want
