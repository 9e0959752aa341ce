"""State tables as views over the star-schema tables, in SQL that both engines read after two substitutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = 915148800000000000  # 1999-01-01 in UTC, nanoseconds
HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000
TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM")

VIEWS = {
    "work_queue": """select concat('wf-', cast(o_orderkey as STR)) workflow_id, o_orderpriority type,
 case when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'P' then 'claimed' when o_orderkey % 3 = 0 then 'done' when o_orderkey % 3 = 1 then 'failed' else 'cancelled' end state,
 cast(o_orderkey % 4 as int) attempts, US(o_orderdate) * 1000 enqueued_at, case when o_orderstatus = 'P' and o_orderkey % 5 = 0 then US(o_orderdate) * 1000 end parked,
 case when o_orderkey % 11 = 0 then US(o_orderdate) * 1000 end cancel_requested, cast(case when o_orderkey % 97 = 0 then -1 else o_orderkey % 3 end as int) depth,
 case when o_orderkey % 3 <> 0 then concat('wf-', cast(o_orderkey % 1000 as STR)) end parent_id, case when o_orderkey % 3 <> 0 then concat('subworkflow-complete:n', cast(o_orderkey % 7 as STR)) end parent_signal from orders""",
    "leases": f"""select concat('wf-', cast(o_orderkey as STR)) workflow_id, concat('w-', cast(o_custkey % 16 as STR)) owner_id,
 US(o_orderdate) * 1000 + (o_orderkey % 1000) * {DAY} expiry, 1 + o_orderkey % 7 fencing_token from orders where o_orderstatus = 'P' and o_orderkey % 17 <> 0""",
    "workflows": "select concat('wf-', cast(o_orderkey as STR)) id, o_orderkey % 13 = 0 rolling_back, cast(o_orderkey % 4 as int) trigger_cause, US(o_orderdate) * 1000 updated_at from orders",
    "nodes": """select concat('wf-', cast(l_orderkey as STR)) workflow_id, concat('n', cast(l_linenumber as STR)) node_name, l_linenumber idx,
 case when min(l_quantity) < 4 then 'failed' when min(l_quantity) < 8 then 'bypassed' when min(l_quantity) < 12 then 'waiting' when min(l_quantity) < 16 then 'pending' when min(l_quantity) < 17 then 'running'
 when min(l_quantity) < 19 then 'skipped' when min(l_quantity) < 20 then 'compensation_failed' when min(l_quantity) < 22 then 'compensated' else 'completed' end status,
 max(l_tax) >= 0.07 continue_on_error from lineitem group by l_orderkey, l_linenumber""",
    "edges": """select c.workflow_id, p.node_name src, c.node_name dst from nodes c join nodes p on p.workflow_id = c.workflow_id and (p.idx = c.idx - 1 or (c.idx % 3 = 0 and p.idx = c.idx - 2))""",
    "held": "select concat('wf-', cast(o_orderkey as STR)) workflow_id, 1 + o_custkey % 7 held_token, case when o_orderkey % 2 = 0 then 'done' else 'failed' end outcome from orders where o_orderstatus = 'P'",
    "decisions": """select concat('wf-', cast(user_id as STR)) workflow_id, concat('d-', cast(event_id as STR)) sig_id, case when event_type = 'purchase' then concat(chr(123), '"Approved": true, "Approver": "a", "Comment": "', props, '"', chr(125))
 when event_type = 'click' then concat(chr(123), '"Approved": ', case when user_id % 2 = 0 then 'true' else 'false' end, chr(125)) when event_type = 'view' then props when event_type = 'signup' then concat(chr(123), '"Approved": ', cast(user_id % 3 as STR), chr(125))
 when user_id % 2 = 0 then concat('[', props, ']') else concat(chr(123), '"Approved"') end payload from events""",
    "tails": "select workflow_id, concat('m', cast(idx % 2 as STR)) merge_name, node_name tail, status, continue_on_error from nodes where idx % 7 <> 0",
    "runs_timed": "select concat('op-', cast(l_linenumber as STR)) operation, case when l_returnflag = 'R' then 'failed' else 'completed' end outcome, cast(l_quantity as bigint) * 1000 + l_suppkey % 997 nanos from lineitem",
    "waits": f"select workflow_id, node_name, {NOW} + (idx - 3) * {DAY} fire_at from nodes where status = 'waiting'",
    "signals": """select concat('wf-', cast(user_id as STR)) workflow_id, concat(event_type, '-', cast(event_id % 50 as STR)) sig_id, event_type name, props payload, US(ts) * 1000 enqueued_at, event_id seq from events""",
    "schedules": f"""select concat('s-', cast(p_partkey as STR)) id, case when p_partkey % 3 = 0 then 'interval' when p_partkey % 3 = 1 then 'cron' else 'oneshot' end kind,
 cast(p_size as bigint) * {HOUR} period, case when p_partkey % 3 = 0 and p_partkey % 41 = 0 then 'soon' when p_partkey % 3 = 0 then cast(cast(p_size as bigint) * {HOUR} as STR)
 when p_partkey % 3 = 1 and p_partkey % 4 = 0 then '30 2 * * *' when p_partkey % 3 = 1 and p_partkey % 4 = 1 then '*/15 * * * *' when p_partkey % 3 = 1 and p_partkey % 4 = 2 then '0 9-17 * * 1' when p_partkey % 3 = 1 then '0 0 1 * *' else '' end spec, p_type target_type, {NOW} - (p_partkey % 100 - 20) * {HOUR} next_fire_time, cast(case when p_partkey % 7 = 0 then 1 else 0 end as int) paused from part""",
    "data_kv": """select concat('wf-', cast(c_custkey as STR)) workflow_id, 'balance' key, cast(2 as int) kind, cast(null as bigint) i_val, c_acctbal f_val, cast(null as STR) s_val from customer
 union all select concat('wf-', cast(c_custkey as STR)), 'segment', 3, null, null, c_mktsegment from customer
 union all select concat('wf-', cast(c_custkey as STR)), 'vip', 1, c_custkey % 2, null, null from customer
 union all select concat('wf-', cast(c_custkey as STR)), 'nation', 0, cast(c_nationkey as bigint) + 9007199254740993, null, null from customer""",
}
NEEDS = {"edges": ("nodes",), "waits": ("nodes",), "tails": ("nodes",)}


def _spark(text: str) -> str:
    return text.replace("STR", "string").replace("US(o_orderdate)", "unix_micros(cast(o_orderdate as timestamp))").replace("US(ts)", "unix_micros(cast(ts as timestamp))")


def _duck(text: str) -> str:
    return text.replace("STR", "varchar").replace("US(", "epoch_us(")


def duck_views(*names: str) -> str:
    """A WITH clause for the views (and what they need)."""
    order = list(dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n)))
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_duck(VIEWS[n])})" for n in order)


class State:
    """State tables by attribute: ``State(spark, sf_dir).work_queue``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = _spark(VIEWS[name])
        base = {"work_queue": ("orders",), "leases": ("orders",), "workflows": ("orders",), "nodes": ("lineitem",), "edges": ("nodes",), "waits": ("nodes",), "signals": ("events",), "schedules": ("part",), "data_kv": ("customer",), "held": ("orders",), "decisions": ("events",), "tails": ("nodes",), "runs_timed": ("lineitem",)}[name]
        frames = {b: getattr(self, b) if b in VIEWS else self.table(b) for b in base}
        import re

        for b in frames:
            text = re.sub(rf"\b(from|join) {b}\b", rf"\1 {{{b}}}", text)
        return self.spark.sql(text, **frames)
