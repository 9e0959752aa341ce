"""Queries over the state tables, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import cron, ids
from millrace.operators import queue as q
from millrace.operators import readmodel as r
from millrace.operators import reports as rep
from millrace.operators import schedule as sch
from millrace.operators import status as s
from millrace.operators import timeline as t
from millrace.plans.fixtures import DAY, NOW, TYPES, State, duck_views

FLAGSHIP = "stuck_work"
OLD = NOW - 365 * DAY
CAPS = {"1-URGENT": 100000, "2-HIGH": 1100, "3-MEDIUM": 900}
GLOBAL_CAP = 6000
SPECS = ("30 2 * * *", "*/15 * * * *", "0 9-17 * * 1", "0 0 1 * *")
TERMINAL = "('completed', 'failed', 'skipped', 'bypassed', 'compensated', 'compensation_failed')"
_ALL: dict[str, tuple] = {}


def query(sql: str, *views: str):
    """Registers a function of State with its SQL over the named views."""

    def put(f):
        _ALL[f.__name__] = (lambda spark, sf_dir: f(State(spark, sf_dir)), (duck_views(*views) + "\n" if views else "") + sql)
        return f

    return put


@query("SELECT state, count(*)::BIGINT AS n FROM work_queue GROUP BY state", "work_queue")
def queue_counts(x):
    return r.queue_counts(x.work_queue)


@query("SELECT type, state, count(*)::BIGINT AS n FROM work_queue GROUP BY ALL", "work_queue")
def queue_counts_by_type(x):
    return r.queue_counts_by_type(x.work_queue)


@query(f"SELECT workflow_id, type, owner_id, expiry, fencing_token, enqueued_at, expiry >= {NOW} AS lease_live FROM work_queue JOIN leases USING (workflow_id) WHERE state = 'claimed'", "work_queue", "leases")
def in_flight(x):
    return r.in_flight(x.work_queue, x.leases, NOW)


@query("SELECT workflow_id, type, enqueued_at FROM work_queue WHERE state = 'claimed' AND workflow_id NOT IN (SELECT workflow_id FROM leases)", "work_queue", "leases")
def orphaned_claims(x):
    return r.orphaned_claims(x.work_queue, x.leases)


@query(f"""SELECT * FROM (SELECT workflow_id, type, state, enqueued_at, CASE WHEN state = 'claimed' THEN 'lapsed_claimed' WHEN type NOT IN {TYPES} THEN 'unregistered_type' WHEN enqueued_at < {OLD} THEN 'too_old_pending' END AS reason
FROM work_queue LEFT JOIN leases USING (workflow_id) WHERE state = 'pending' OR (state = 'claimed' AND expiry < {NOW})) WHERE reason IS NOT NULL""", "work_queue", "leases")
def stuck_work(x):
    return r.stuck_work(x.work_queue, x.leases, NOW, OLD, TYPES)


@query(f"SELECT owner_id, count(*)::BIGINT AS leases, sum(CASE WHEN expiry >= {NOW} THEN 1 ELSE 0 END)::BIGINT AS live FROM leases GROUP BY owner_id", "leases")
def worker_health(x):
    return r.worker_health(x.leases, NOW)


@query(f"""SELECT workflow_id, state, owner_id, coalesce(expiry >= {NOW}, false) AS lease_live, {', '.join(f"coalesce(n.n_{v}, 0)::BIGINT AS n_{v}" for v in ('completed', 'failed', 'waiting', 'pending', 'bypassed'))}
FROM work_queue LEFT JOIN leases USING (workflow_id) LEFT JOIN (SELECT workflow_id, {', '.join(f"count(*) FILTER (status = '{v}') AS n_{v}" for v in ('completed', 'failed', 'waiting', 'pending', 'bypassed'))} FROM nodes GROUP BY 1) n USING (workflow_id)""", "work_queue", "leases", "nodes")
def workflow_status(x):
    return r.workflow_status(x.work_queue, x.leases, x.nodes, NOW)


@query("SELECT workflow_id, status, count(*)::BIGINT AS n FROM nodes GROUP BY ALL", "nodes")
def node_status_counts(x):
    return r.node_status_counts(x.nodes)


@query("SELECT DISTINCT workflow_id FROM nodes WHERE status = 'waiting'", "nodes")
def list_by_node_status(x):
    return r.list_by_node_status(x.nodes, "waiting")


@query(f"SELECT DISTINCT workflow_id FROM nodes JOIN workflows ON id = workflow_id WHERE status = 'failed' AND updated_at >= {OLD}", "nodes", "workflows")
def list_by_node_status_since(x):
    return r.list_by_node_status(x.nodes, "failed", x.workflows, OLD)


@query(f"SELECT id, updated_at FROM workflows WHERE rolling_back AND updated_at >= {OLD}", "workflows")
def list_rolling_back(x):
    return r.list_rolling_back(x.workflows, OLD)


@query(f"SELECT workflow_id, type, enqueued_at FROM work_queue WHERE state = 'pending' AND enqueued_at < {OLD}", "work_queue")
def list_pending(x):
    return r.list_pending(x.work_queue, OLD)


@query(f"SELECT workflow_id, type, enqueued_at FROM work_queue w WHERE state = 'claimed' AND EXISTS (SELECT 1 FROM leases l WHERE l.workflow_id = w.workflow_id AND expiry < {NOW})", "work_queue", "leases")
def reclaimable(x):
    return r.reclaimable(x.work_queue, x.leases, NOW)


@query("SELECT type, count(*)::BIGINT AS running FROM work_queue WHERE state = 'claimed' AND parked IS NULL GROUP BY type", "work_queue")
def cap_running(x):
    return q.cap_running(x.work_queue)


@query("SELECT type, count(*)::BIGINT AS backlog FROM work_queue WHERE (state = 'claimed' AND parked IS NULL) OR state = 'pending' GROUP BY type", "work_queue")
def cap_backlog(x):
    return q.cap_backlog(x.work_queue)


@query(f""", caps(type, cap) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in CAPS.items())}),
running AS (SELECT type, count(*) AS n FROM work_queue WHERE state = 'claimed' AND parked IS NULL GROUP BY type),
p AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY enqueued_at, workflow_id) AS k FROM work_queue WHERE state = 'pending' AND cancel_requested IS NULL),
g AS (SELECT p.*, row_number() OVER (ORDER BY p.enqueued_at, p.workflow_id) AS j FROM p LEFT JOIN caps USING (type) LEFT JOIN running USING (type) WHERE cap IS NULL OR k <= cap - coalesce(n, 0))
SELECT workflow_id, type, enqueued_at, true AS gated FROM g WHERE j <= {GLOBAL_CAP} - (SELECT sum(n) FROM running)
UNION ALL SELECT workflow_id, type, enqueued_at, false FROM work_queue WHERE state = 'pending' AND cancel_requested IS NOT NULL""", "work_queue")
def claim_batch(x):
    return q.claim_batch(x.work_queue, CAPS, GLOBAL_CAP)


@query("""SELECT workflow_id, attempts, CASE WHEN held < fencing_token THEN 'superseded' WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS next_state
FROM (SELECT w.workflow_id, attempts, fencing_token, 1 + length(w.workflow_id) % 7 AS held FROM work_queue w JOIN leases l USING (workflow_id) WHERE state = 'claimed')""", "work_queue", "leases")
def retry_disposition(x):
    held = x.leases.select("workflow_id", (F.length("workflow_id") % 7 + 1).alias("held_token"))
    return q.retry_disposition(x.work_queue, x.leases, held, 3)


@query("SELECT workflow_id, node_name FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.workflow_id = n.workflow_id AND e.dst = n.node_name)", "nodes", "edges")
def dag_roots(x):
    return s.roots(x.nodes, x.edges)


@query("SELECT workflow_id, node_name FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.workflow_id = n.workflow_id AND e.src = n.node_name)", "nodes", "edges")
def dag_leaves(x):
    return s.leaves(x.nodes, x.edges)


LEVELS = """a(workflow_id, node_name, lvl) AS (SELECT workflow_id, node_name, 0 FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.workflow_id = n.workflow_id AND e.dst = n.node_name)
UNION ALL SELECT e.workflow_id, e.dst, lvl + 1 FROM a JOIN edges e ON e.workflow_id = a.workflow_id AND e.src = a.node_name)"""


@query(f", {LEVELS} SELECT workflow_id, node_name, max(lvl)::INTEGER AS level FROM a GROUP BY ALL", "nodes", "edges")
def dag_levels(x):
    return s.levels(x.nodes, x.edges)


@query(f", {LEVELS}, l AS (SELECT workflow_id, node_name, max(lvl)::INTEGER AS level FROM a GROUP BY ALL) SELECT workflow_id, node_name, level, (row_number() OVER (PARTITION BY workflow_id ORDER BY level DESC, node_name))::INTEGER AS place FROM l JOIN nodes USING (workflow_id, node_name) WHERE status = 'completed'", "nodes", "edges")
def rollback_order(x):
    return s.rollback_order(x.nodes, x.edges)


RESOLVED = "SELECT e.workflow_id, src, dst, status, status = 'completed' OR (status = 'failed' AND continue_on_error) AS resolved FROM edges e JOIN nodes n ON n.workflow_id = e.workflow_id AND n.node_name = e.src"


@query(RESOLVED, "nodes", "edges")
def edge_resolution(x):
    return s.edge_resolution(x.nodes, x.edges)


@query(f""", f AS (SELECT workflow_id, dst AS node_name, bool_or(NOT resolved AND status IN ('failed', 'skipped')) AS bad, bool_or(NOT resolved AND (status NOT IN {TERMINAL} OR status = 'compensated')) AS wait, bool_or(status = 'bypassed') AS byp, bool_or(resolved) AS res FROM ({RESOLVED}) GROUP BY ALL)
SELECT workflow_id, node_name, CASE WHEN bad THEN 'skipped' WHEN wait THEN 'unassigned' WHEN byp AND res THEN 'skipped' WHEN byp THEN 'bypassed' ELSE 'unassigned' END AS becomes FROM f""", "nodes", "edges")
def blocked_status(x):
    return s.blocked_status(x.nodes, x.edges)


@query(f"SELECT workflow_id, bool_and(status IN {TERMINAL} AND status NOT IN ('failed', 'compensation_failed')) AS complete, bool_and(status IN {TERMINAL}) AS terminal, bool_or(status IN ('failed', 'compensation_failed')) AS failed, min(node_name) FILTER (status IN ('failed', 'compensation_failed')) AS first_failed FROM nodes GROUP BY workflow_id", "nodes")
def run_verdict(x):
    return s.run_verdict(x.nodes)


@query("SELECT workflow_id, " + ", ".join(f"coalesce(string_agg(node_name, ',' ORDER BY node_name) FILTER (status IN {v}), '') AS {c}" for v, c in (("('completed', 'compensated')", "compensate"), ("('failed', 'compensation_failed')", "failed"), ("('skipped', 'bypassed')", "skipped"))) + " FROM nodes GROUP BY workflow_id", "nodes")
def saga_partition(x):
    return s.saga_partition(x.nodes)


@query("SELECT workflow_id, node_name FROM nodes WHERE idx > 5 OR (length(workflow_id) % 2 = 0 AND idx > 3)", "nodes")
def graph_identity(x):
    return s.graph_identity(x.nodes, x.nodes.where("idx <= 3 OR (idx <= 5 AND length(workflow_id) % 2 <> 0)"))


def _little_endian(n: str) -> str:
    h = f"printf('%016x', {n})"
    return "unhex(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2)) + ")"


def _digest(a: str, b: str) -> str:
    return f"sha256({_little_endian(f'octet_length(encode({a}))')} || encode({a}) || encode({b}))"


def _counted(a: str) -> str:
    return f"{_little_endian(f'octet_length(encode({a}))')} || encode({a})"


@query(f"SELECT workflow_id, node_name, {_digest('workflow_id', 'node_name')} AS key FROM nodes", "nodes")
def idempotency_key(x):
    return x.nodes.select("workflow_id", "node_name", ids.idempotency_key(F.col("workflow_id"), F.col("node_name")).alias("key"))


@query(f"SELECT workflow_id, node_name, 'sub:' || {_digest('workflow_id', 'node_name')} AS child_id FROM nodes", "nodes")
def child_run_id(x):
    return x.nodes.select("workflow_id", "node_name", ids.child_run_id("sub", F.col("workflow_id"), F.col("node_name")).alias("child_id"))


@query(f"SELECT workflow_id, node_name, 'fan:' || sha256({_counted('workflow_id')} || {_counted('node_name')} || {_little_endian('idx')}) AS child_id FROM nodes", "nodes")
def branch_run_id(x):
    return x.nodes.select("workflow_id", "node_name", ids.branch_run_id(F.col("workflow_id"), F.col("node_name"), F.col("idx")).alias("child_id"))


@query("SELECT workflow_id, type FROM work_queue WHERE type IN ('1-URGENT', '2-HIGH', '5-LOW') AND type NOT IN ('2-HIGH')", "work_queue")
def type_filter(x):
    return r.of_types(x.work_queue, ("1-URGENT", "2-HIGH", "5-LOW"), ("2-HIGH",)).select("workflow_id", "type")


MAILBOX = "SELECT workflow_id, sig_id, max_by(name, seq) AS name, max_by(payload, seq) AS payload, max_by(enqueued_at, seq) AS enqueued_at FROM signals GROUP BY workflow_id, sig_id"


@query(MAILBOX, "signals")
def signal_mailbox(x):
    return t.signal_mailbox(x.signals)


@query(f"SELECT workflow_id, name, min(sig_id) AS sig_id, min_by(payload, sig_id) AS payload FROM ({MAILBOX}) GROUP BY workflow_id, name", "signals")
def signal_take_first(x):
    return t.signal_take_first(t.signal_mailbox(x.signals))


@query("""SELECT workflow_id, sig_id, CASE WHEN NOT json_valid(payload) THEN 'malformed' WHEN json_type(payload) <> 'OBJECT' OR coalesce(json_type(payload, '$.Approved'), 'BOOLEAN') <> 'BOOLEAN'
OR coalesce(json_type(payload, '$.Approver'), 'VARCHAR') <> 'VARCHAR' OR coalesce(json_type(payload, '$.Comment'), 'VARCHAR') <> 'VARCHAR' THEN 'malformed' WHEN json_extract_string(payload, '$.Approved') = 'true' THEN 'approved' ELSE 'rejected' END AS decision
FROM (SELECT workflow_id, sig_id, replace(payload, '"k"', '"Comment"') AS payload FROM decisions)""", "decisions")
def approval_decisions(x):
    return t.approval_decisions(x.decisions.withColumn("payload", F.replace("payload", F.lit('"k"'), F.lit('"Comment"'))))


@query(f"""SELECT workflow_id, node_name, fire_at FROM waits JOIN nodes USING (workflow_id, node_name) WHERE fire_at <= {NOW} AND status = 'waiting'
AND workflow_id NOT IN (SELECT workflow_id FROM nodes WHERE status = 'failed' AND NOT continue_on_error)""", "waits")
def due_timers(x):
    return t.due_timers(x.waits, x.nodes, NOW)


@query(f"SELECT id, kind, next_fire_time FROM schedules WHERE paused = 0 AND next_fire_time <= {NOW}", "schedules")
def due_schedules(x):
    return t.due_schedules(x.schedules, NOW)


@query(f"SELECT id, next_fire_time AS slot, ({NOW} - next_fire_time) // period AS missed, next_fire_time + (({NOW} - next_fire_time) // period + 1) * period AS next_slot, 'sched:' || id || ':' || next_fire_time AS run_id FROM schedules WHERE kind = 'interval' AND paused = 0 AND next_fire_time <= {NOW}", "schedules")
def interval_advance(x):
    return t.interval_advance(x.schedules, NOW)


@query(f""", c AS (SELECT id, make_timestamp((next_fire_time // 1000)::BIGINT) AS after, CASE WHEN length(id) % 4 = 0 THEN 0 ELSE (hour(make_timestamp((next_fire_time // 1000)::BIGINT)) % 3) + 1 END AS k FROM schedules WHERE kind = 'cron'),
m AS (SELECT unnest(generate_series(TIMESTAMP '1998-12-20', TIMESTAMP '1999-02-10', INTERVAL 1 MINUTE)) AS m),
slots AS (SELECT m, 0 AS k FROM m WHERE hour(m) = 2 AND minute(m) = 30 UNION ALL SELECT m, 1 FROM m WHERE minute(m) % 15 = 0 UNION ALL SELECT m, 2 FROM m WHERE minute(m) = 0 AND hour(m) BETWEEN 9 AND 17 AND dayofweek(m) = 1 UNION ALL SELECT m, 3 FROM m WHERE day(m) = 1 AND hour(m) = 0 AND minute(m) = 0)
SELECT id, epoch_us(min(m)) * 1000 AS next_slot FROM c JOIN slots ON slots.k = c.k AND m > after GROUP BY id""", "schedules")
def cron_next(x):
    after = F.timestamp_micros(F.expr("next_fire_time div 1000"))
    k = F.when(F.length("id") % 4 == 0, 0).otherwise(F.hour(after) % 3 + 1)
    out = None
    for i, spec in enumerate(SPECS):
        out = F.when(k == i, cron.next_slot(after, spec)) if out is None else out.when(k == i, cron.next_slot(after, spec))
    return x.schedules.where("kind = 'cron'").select("id", (F.unix_micros(out) * 1000).alias("next_slot"))


@query("""SELECT workflow_id, key, CASE WHEN b.kind IS NULL THEN 'I' WHEN a.kind IS NULL THEN 'D' ELSE 'U' END AS op, a.kind, a.i_val, a.f_val, a.s_val FROM
(SELECT workflow_id, key, kind, i_val, CASE WHEN kind = 2 AND f_val < 0 THEN f_val + 1 ELSE f_val END AS f_val, s_val FROM data_kv WHERE NOT (kind = 1 AND i_val = 0)) a FULL JOIN (SELECT * FROM data_kv WHERE NOT (kind = 3 AND s_val = 'BUILDING')) b USING (workflow_id, key)
WHERE a.kind IS DISTINCT FROM b.kind OR a.i_val IS DISTINCT FROM b.i_val OR a.f_val IS DISTINCT FROM b.f_val OR a.s_val IS DISTINCT FROM b.s_val""", "data_kv")
def checkpoint_diff(x):
    kv = x.data_kv
    after = kv.where("NOT (kind = 1 AND i_val = 0)").withColumn("f_val", F.when((F.col("kind") == 2) & (F.col("f_val") < 0), F.col("f_val") + 1).otherwise(F.col("f_val")))
    return t.changes(kv.where("NOT (kind = 3 AND s_val = 'BUILDING')"), after, ["workflow_id", "key"], ["kind", "i_val", "f_val", "s_val"])


@query("SELECT workflow_id, key, kind, i_val, f_val, s_val FROM data_kv WHERE kind IN (0, 2)", "data_kv")
def delta_checkpoint(x):
    return t.delta(x.data_kv, x.data_kv.where("kind IN (0, 2)").select("workflow_id", "key"), ["workflow_id", "key"])


@query("SELECT workflow_id, sig_id, max_by(payload, seq) AS payload FROM signals GROUP BY ALL HAVING max_by(name, seq) <> 'error'", "signals")
def latest_state(x):
    log = x.signals.withColumn("op", F.when(F.col("name") == "error", "D").otherwise("U"))
    return t.latest_state(log, ["workflow_id", "sig_id"], ["payload"], "seq")


@query("SELECT workflow_id, key, CASE WHEN kind = 0 THEN i_val END AS as_long, CASE WHEN kind = 1 THEN i_val <> 0 END AS as_boolean, CASE WHEN kind = 2 THEN f_val WHEN kind = 0 THEN i_val::DOUBLE END AS as_double, CASE WHEN kind = 3 THEN s_val END AS as_string FROM data_kv", "data_kv")
def typed_kv(x):
    return t.typed_kv(x.data_kv)


@query("SELECT o_orderkey AS run, CASE WHEN o_totalprice > 200000 THEN 'review' WHEN o_orderpriority = '1-URGENT' THEN 'express' ELSE 'standard' END AS target FROM orders")
def choice_route(x):
    rows = x.table("orders").select(F.col("o_orderkey").alias("run"), "o_totalprice", "o_orderpriority")
    return t.choice_route(rows, [(F.col("o_totalprice") > 200000, "review"), (F.col("o_orderpriority") == "1-URGENT", "express")], "standard").select("run", "target")


@query("""SELECT workflow_id, merge_name, count(*) FILTER (ok)::BIGINT AS taken, CASE WHEN bool_or(NOT ok AND status IN ('failed', 'skipped')) THEN 'skipped' WHEN bool_and(status = 'bypassed') THEN 'bypassed'
WHEN bool_and(ok OR status = 'bypassed') THEN 'run' ELSE 'waits' END AS merge FROM (SELECT *, status = 'completed' OR (status = 'failed' AND continue_on_error) AS ok FROM tails) GROUP BY ALL""", "tails")
def merge_fire(x):
    return t.merge_fire(x.tails)


@query("""SELECT workflow_id, 'out[' || idx || ']' AS key, CASE WHEN status <> 'failed' THEN node_name END AS value FROM nodes
UNION ALL SELECT workflow_id, 'out.__count__', count(*)::VARCHAR FROM nodes GROUP BY workflow_id
UNION ALL SELECT workflow_id, 'out.__failed__', coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (status = 'failed'), '') FROM nodes GROUP BY workflow_id""", "nodes")
def fanout_results(x):
    return t.fanout_results(x.nodes.select("workflow_id", "idx", F.col("node_name").alias("result"), (F.col("status") != "failed").alias("ok")), "out")


@query("SELECT status AS operation, count(*)::BIGINT AS n, sum(idx)::BIGINT AS total, min(idx)::BIGINT AS least, max(idx)::BIGINT AS most, (sum(idx) // count(*))::BIGINT AS average FROM nodes GROUP BY status", "nodes")
def operation_stats(x):
    return r.operation_stats(x.nodes, "status", "idx")


@query("SELECT p_partkey AS record_id, p_retailprice * 1.5::DOUBLE AS record_value, upper(p_name) AS record_name FROM part")
def etl_map(x):
    return x.table("part").select(F.col("p_partkey").alias("record_id"), (F.col("p_retailprice") * F.lit(1.5)).alias("record_value"), F.upper("p_name").alias("record_name"))


@query("SELECT count(*)::BIGINT AS n, round(sum(l_extendedprice::DECIMAL(20, 2))::DOUBLE, 2) AS total, round(sum(l_extendedprice::DECIMAL(20, 2))::DOUBLE / count(*), 4) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem")
def etl_aggregate(x):
    v = F.col("l_extendedprice")
    total = F.sum(v.cast("decimal(20,2)")).cast("double")
    return x.table("lineitem").agg(F.count("*").alias("n"), F.round(total, 2).alias("total"), F.round(total / F.count("*"), 4).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


@query("SELECT user_id, count(*)::BIGINT AS events, epoch_us(max(ts)) AS last_us, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INTEGER AS days, max(ts)::DATE >= DATE '2024-01-08' AS is_active FROM events GROUP BY user_id")
def user_activity(x):
    first, last = F.min("ts"), F.max("ts")
    return x.table("events").groupBy("user_id").agg(F.count("*").alias("events"), F.unix_micros(last.cast("timestamp")).alias("last_us"), F.date_diff(last.cast("date"), first.cast("date")).alias("days"), (last.cast("date") >= F.lit("2024-01-08").cast("date")).alias("is_active"))


# ---- changes of the queue ---------------------------------------------------------------------------------------------

TTL = 30_000_000_000
OWNER = "w-3"
GOOD = "depth BETWEEN 0 AND 64"
HELD = "(SELECT w.*, held_token, outcome, fencing_token, coalesce(fencing_token <= held_token, false) AS ok FROM work_queue w JOIN held USING (workflow_id) LEFT JOIN leases USING (workflow_id) WHERE state = 'claimed')"


@query(f""", caps(type, cap) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in CAPS.items())}),
running AS (SELECT type, count(*) AS n FROM work_queue WHERE state = 'claimed' AND parked IS NULL GROUP BY type),
c AS (SELECT w.*, CASE WHEN fencing_token IS NULL THEN 1 WHEN expiry <= {NOW} THEN fencing_token + 1 WHEN owner_id = '{OWNER}' THEN fencing_token END AS token FROM work_queue w LEFT JOIN leases USING (workflow_id)
WHERE {GOOD} AND type IN {TYPES} AND (state = 'pending' OR (state = 'claimed' AND expiry < {NOW}))),
o AS (SELECT *, (state = 'pending' OR parked IS NOT NULL) AND cancel_requested IS NULL AS gated, state = 'claimed' AND cancel_requested IS NOT NULL AS ends FROM c WHERE token IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY enqueued_at, workflow_id) AS k FROM o WHERE gated),
g AS (SELECT p.*, row_number() OVER (ORDER BY p.enqueued_at, p.workflow_id) AS j FROM p LEFT JOIN caps USING (type) LEFT JOIN running USING (type) WHERE cap IS NULL OR k <= cap - coalesce(n, 0)),
taken AS (SELECT * EXCLUDE (k, j) FROM g WHERE j <= {GLOBAL_CAP} - (SELECT sum(n) FROM running) UNION ALL SELECT * FROM o WHERE NOT gated AND NOT ends)
SELECT workflow_id, type, enqueued_at, 'claim' AS action, 'claimed' AS state, attempts + 1 AS attempts, '{OWNER}' AS owner_id, token::BIGINT AS fencing_token, {NOW + TTL} AS expiry FROM taken
UNION ALL SELECT workflow_id, type, enqueued_at, 'cancel', 'cancelled', attempts, '{OWNER}', token::BIGINT, {NOW + TTL} FROM o WHERE ends""", "work_queue", "leases")
def claim_next(x):
    return q.claim_next(x.work_queue, x.leases, OWNER, NOW, TTL, TYPES, CAPS, GLOBAL_CAP)


@query(f"""SELECT workflow_id, '{OWNER}' AS owner_id, t IS NOT NULL AS granted, t::BIGINT AS fencing_token, CASE WHEN t IS NOT NULL THEN {NOW + TTL} END AS expiry
FROM (SELECT workflow_id, CASE WHEN fencing_token IS NULL THEN 1 WHEN expiry <= {NOW} THEN fencing_token + 1 WHEN owner_id = '{OWNER}' THEN fencing_token END AS t FROM work_queue LEFT JOIN leases USING (workflow_id))""", "work_queue", "leases")
def lease_claims(x):
    return q.lease_claims(x.leases, x.work_queue.select("workflow_id", F.lit(OWNER).alias("owner_id")), NOW, TTL)


@query(f"SELECT workflow_id, coalesce(held_token = fencing_token, false) AS renewed, CASE WHEN coalesce(held_token = fencing_token, false) THEN {NOW + TTL} ELSE expiry END AS expiry FROM held LEFT JOIN leases USING (workflow_id)", "held", "leases")
def lease_renewals(x):
    return q.lease_renewals(x.leases, x.held, NOW, TTL)


@query("SELECT workflow_id, fencing_token IS NULL OR held_token < fencing_token AS fenced FROM held LEFT JOIN leases USING (workflow_id)", "held", "leases")
def fence_check(x):
    return q.fence_check(x.leases, x.held)


@query(f"SELECT workflow_id, CASE WHEN ok THEN outcome ELSE 'claimed' END AS state, ok AS flipped, NOT ok AS fence_rejected FROM {HELD}", "work_queue", "leases", "held")
def terminal_flip(x):
    return q.terminal_flip(x.work_queue, x.leases, x.held)


@query(f"SELECT workflow_id, attempts, CASE WHEN NOT ok THEN 'claimed' WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS state, ok AS flipped FROM {HELD}", "work_queue", "leases", "held")
def retry_flip(x):
    return q.retry_flip(x.work_queue, x.leases, x.held, 3)


@query(f"SELECT workflow_id, 0 AS attempts, {NOW} AS parked FROM {HELD} WHERE ok", "work_queue", "leases", "held")
def park_items(x):
    return q.parked(x.work_queue, x.leases, x.held, NOW)


@query(f"""SELECT workflow_id, CASE WHEN state = 'pending' THEN 'cancelled' ELSE 'claimed' END AS state, CASE WHEN state = 'claimed' THEN {NOW} ELSE cancel_requested END AS cancel_requested
FROM work_queue WHERE state = 'pending' OR (state = 'claimed' AND cancel_requested IS NULL)""", "work_queue")
def cancel_items(x):
    return q.cancels(x.work_queue, x.work_queue.select("workflow_id"), NOW)


@query(f""", caps(type, cap) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in CAPS.items())}),
b AS (SELECT type, count(*) AS n FROM work_queue WHERE (state = 'claimed' AND parked IS NULL) OR state = 'pending' GROUP BY type)
SELECT type, coalesce(n, 0)::BIGINT AS backlog, (SELECT sum(n) FROM b)::BIGINT AS in_all, (cap IS NULL OR coalesce(n, 0) < cap) AND (SELECT sum(n) FROM b) < 1000000 AS admitted
FROM (SELECT DISTINCT type FROM work_queue UNION SELECT 'none') LEFT JOIN b USING (type) LEFT JOIN caps USING (type)""", "work_queue")
def cap_admission(x):
    asked = x.work_queue.select("type").distinct().unionByName(x.spark.range(1).select(F.lit("none").alias("type")))
    return q.cap_admits(x.work_queue, asked, CAPS, 1_000_000)


@query("SELECT DISTINCT 'wf-' || c_custkey * 20 AS workflow_id, c_mktsegment AS type FROM customer WHERE 'wf-' || c_custkey * 20 NOT IN (SELECT workflow_id FROM work_queue)", "work_queue")
def enqueue_new(x):
    items = x.table("customer").select(F.concat(F.lit("wf-"), (F.col("c_custkey") * 20).cast("string")).alias("workflow_id"), F.col("c_mktsegment").alias("type"))
    return q.enqueue(x.work_queue, items)


@query(f"SELECT 'sub:' || {_digest('workflow_id', "'s'")} AS workflow_id, 'child' AS type, {NOW} AS enqueued_at, 'pending' AS state, 0 AS attempts, depth + 1 AS depth, workflow_id AS parent_id, 'subworkflow-complete:s' AS parent_signal FROM work_queue WHERE state = 'claimed' AND {GOOD}", "work_queue")
def enqueue_children(x):
    child = ids.child_run_id("sub", F.col("workflow_id"), F.lit("s"))
    return q.enqueue_children(x.work_queue, x.work_queue.where("state = 'claimed'"), child, "child", NOW, F.lit("subworkflow-complete:s"))


@query("SELECT parent_id AS workflow_id, 'subworkflow-complete:' || workflow_id AS sig_id, parent_signal AS name, '' AS payload FROM work_queue WHERE state IN ('done', 'failed', 'cancelled') AND parent_id IS NOT NULL", "work_queue")
def wake_parents(x):
    return q.wake_parents(x.work_queue)


@query("""SELECT a.workflow_id, state, state IS NOT NULL AS queued, coalesce(state IN ('done', 'failed', 'cancelled'), false) AS ended
FROM (SELECT 'wf-' || c_custkey AS workflow_id FROM customer) a LEFT JOIN work_queue w ON w.workflow_id = a.workflow_id""", "work_queue")
def terminal_states(x):
    return q.terminal_states(x.work_queue, x.table("customer").select(F.concat(F.lit("wf-"), F.col("c_custkey").cast("string")).alias("workflow_id")))


# ---- schedules ----------------------------------------------------------------------------------------------------------

ADVANCED = f"""m AS (SELECT unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '1999-02-10', INTERVAL 1 MINUTE)) AS m),
slots AS (SELECT m, '{SPECS[0]}' AS spec FROM m WHERE hour(m) = 2 AND minute(m) = 30 UNION ALL SELECT m, '{SPECS[1]}' FROM m WHERE minute(m) % 15 = 0 UNION ALL SELECT m, '{SPECS[2]}' FROM m WHERE minute(m) = 0 AND hour(m) BETWEEN 9 AND 17 AND dayofweek(m) = 1 UNION ALL SELECT m, '{SPECS[3]}' FROM m WHERE day(m) = 1 AND hour(m) = 0 AND minute(m) = 0),
nexts AS (SELECT spec, epoch_us(min(m)) * 1000 AS slot FROM slots WHERE epoch_us(m) * 1000 > {NOW} GROUP BY spec),
a AS (SELECT id, kind, s.spec, target_type, next_fire_time, CASE WHEN kind = 'cron' THEN slot WHEN kind = 'interval' AND TRY_CAST(s.spec AS BIGINT) > 0 THEN next_fire_time + (({NOW} - next_fire_time) // TRY_CAST(s.spec AS BIGINT) + 1) * TRY_CAST(s.spec AS BIGINT) END AS next_slot
FROM schedules s LEFT JOIN nexts ON nexts.spec = s.spec WHERE paused = 0 AND next_fire_time <= {NOW}),
due AS (SELECT *, kind <> 'oneshot' AND next_slot IS NULL AS broken FROM a)"""
TYPE_CAPS = {"STANDARD BRASS": 2, "PROMO STEEL": 1}


@query(f", {ADVANCED} SELECT * FROM due", "schedules")
def schedule_advance(x):
    return sch.advance(x.schedules, NOW)


@query(f""", {ADVANCED}, caps(type, cap) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in TYPE_CAPS.items())}),
k AS (SELECT id, row_number() OVER (PARTITION BY target_type ORDER BY id) AS k, target_type FROM due WHERE NOT broken),
g AS (SELECT k.id, row_number() OVER (ORDER BY k.id) AS j FROM k LEFT JOIN caps ON caps.type = k.target_type WHERE cap IS NULL OR k <= cap),
f AS (SELECT due.*, coalesce(j <= greatest(0, 400), false) AS fired FROM due LEFT JOIN g USING (id))
SELECT id, 'sched:' || id || ':' || next_fire_time AS run_id, target_type, fired, NOT broken AND NOT fired AS missed,
CASE WHEN broken THEN 'pause' WHEN kind <> 'oneshot' THEN 'advance' WHEN fired THEN 'delete' ELSE 'retain' END AS action, coalesce(next_slot, next_fire_time) AS next_fire_time, 1::BIGINT AS fencing_token, {NOW + TTL} AS expiry FROM f""", "schedules")
def fire_due(x):
    empty = x.work_queue.where("false")
    return sch.fire_due(x.schedules, empty, x.leases, "p", NOW, TTL, TYPE_CAPS, 400)


# ---- reports ------------------------------------------------------------------------------------------------------------


@query(f"""SELECT 'count' AS part, state AS key, '' AS detail, count(*)::BIGINT AS n FROM work_queue GROUP BY state
UNION ALL SELECT 'in_flight', workflow_id, CASE WHEN expiry >= {NOW} THEN 'live' ELSE 'lapsed' END, fencing_token FROM work_queue JOIN leases USING (workflow_id) WHERE state = 'claimed'
UNION ALL SELECT 'stuck', workflow_id, reason, enqueued_at FROM (SELECT workflow_id, enqueued_at, CASE WHEN state = 'claimed' THEN 'lapsed_claimed' WHEN type NOT IN {TYPES} THEN 'unregistered_type' WHEN enqueued_at < {OLD} THEN 'too_old_pending' END AS reason
FROM work_queue LEFT JOIN leases USING (workflow_id) WHERE state = 'pending' OR (state = 'claimed' AND expiry < {NOW})) WHERE reason IS NOT NULL
UNION ALL SELECT 'worker', owner_id, 'live', count(*) FILTER (expiry >= {NOW}) FROM leases GROUP BY owner_id""", "work_queue", "leases")
def queue_snapshot(x):
    return rep.queue_snapshot(x.work_queue, x.leases, NOW, OLD, TYPES)


@query("""SELECT *, (row_number() OVER (ORDER BY average DESC, operation))::INTEGER AS place FROM (SELECT operation, count(*)::BIGINT AS n, sum(nanos)::BIGINT AS total, min(nanos) AS least, max(nanos) AS most,
(sum(nanos) // count(*))::BIGINT AS average, count(*) FILTER (outcome = 'failed')::BIGINT AS failed FROM runs_timed GROUP BY operation)""", "runs_timed")
def operation_report(x):
    return rep.operation_report(x.runs_timed, "operation", "outcome", "nanos")


@query("SELECT operation, n, most, (row_number() OVER (ORDER BY most DESC, operation))::INTEGER AS place FROM (SELECT operation, count(*)::BIGINT AS n, max(nanos) AS most FROM runs_timed GROUP BY operation) WHERE most > 50050", "runs_timed")
def slow_operations(x):
    return rep.slow_operations(x.runs_timed, "operation", "nanos", 50_050)


@query("SELECT status AS operation, (count(*) FILTER (idx % 2 = 0) - count(*) FILTER (idx % 2 = 1))::BIGINT AS active FROM nodes GROUP BY status", "nodes")
def active_operations(x):
    return rep.active_operations(x.nodes.select(F.col("status").alias("operation"), F.when(F.col("idx") % 2 == 0, "start").otherwise("end").alias("event")))


@query(f", c(place, counter) AS (VALUES {', '.join(str((i, c)) for i, c in enumerate(rep.COUNTERS))}), e AS (SELECT CASE WHEN NOT ok THEN 'fence_rejections' WHEN attempts < 3 THEN 'retries' ELSE 'dead_letters' END AS counter FROM {HELD}) SELECT place, counter, count(e.counter)::BIGINT AS n FROM c LEFT JOIN e USING (counter) GROUP BY ALL", "work_queue", "leases", "held")
def dispatch_counters(x):
    f = q.retry_flip(x.work_queue, x.leases, x.held, 3)
    kind = F.when(F.col("state") == "claimed", "fence_rejections").when(F.col("state") == "pending", "retries").otherwise("dead_letters")
    return rep.dispatch_counters(f.select(kind.alias("counter")))


@query("SELECT workflow_id, count(*)::BIGINT AS n FROM signals GROUP BY workflow_id HAVING count(*) > 60", "signals")
def mailbox_guard(x):
    return rep.mailbox_guard(x.signals, 60)


@query("SELECT workflow_id, count(*) FILTER (status = 'skipped')::BIGINT AS skipped FROM nodes GROUP BY workflow_id", "nodes")
def count_skipped(x):
    return rep.count_skipped(x.nodes)


@query("SELECT DISTINCT workflow_id AS id FROM nodes WHERE status IN ('failed', 'compensation_failed') ORDER BY id", "nodes")
def id_list(x):
    return rep.ids(x.nodes, "workflow_id", "status IN ('failed', 'compensation_failed')")


def queries() -> dict:
    return {n: f for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql.replace("WITH ", "WITH RECURSIVE ", 1) if "UNION ALL SELECT e.workflow_id, e.dst" in sql else sql for n, (_, sql) in _ALL.items()}

