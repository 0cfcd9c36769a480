"""Queries over ordering, top-k and merge policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import lookups as lk
from sluice.operators import messages as m
from sluice.operators import ordering as o
from sluice.operators import requests as rq
from sluice.plans.catalog import query
from sluice.sources.tables import CFG, NOW, POOLS, QUEUES, REQ, queues, read, requests, sql

BUDGETS = "budgets as (select queue_id, least(1.0::double, round(avg(value), 2) / 100) as budget from req group by 1)"


def _budgets(r):
    return r.groupBy("queue_id").agg(F.least(F.lit(1.0), F.round(F.avg("value"), 2) / 100).alias("budget"))


@query("w1_edf_topk", sql(REQ, BUDGETS, body=f"""
select queue_id, id, deadline, rn from (select *, cast(row_number() over (partition by queue_id order by deadline, id) as int) as rn from req where deadline >= {NOW}) join budgets using (queue_id) where rn <= 10 and rn <= floor(10.0::double * budget)"""))
def w1(spark, sf_dir):
    r = requests(spark, sf_dir)
    return o.edf_topk(r.where(F.col("deadline") >= NOW), _budgets(r), 10).select("queue_id", "id", "deadline", "rn")


LANE = "cast(3 * (case class when 'reserved' then 0 else 1 end) + case tier when 'interactive' then 0 when 'async' then 1 else 2 end as int)"


@query("w2_priority_lane", sql(REQ, body=f"select event_id, {LANE} as lane from req"))
def w2(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", o.lane(F.col("class"), F.col("tier")).alias("lane"))


@query("w3_lane_round_robin", """
with b as (select o_orderkey, o_custkey % 3 as pool, cast(substr(o_orderpriority, 1, 1) as int) as lane, o_custkey % 20 as channel, cast(floor(epoch(o_orderdate)) as bigint) as t_at from orders)
select o_orderkey, pool, lane, channel, row_number() over (partition by pool, lane, channel order by t_at, o_orderkey) as rr, min(t_at) over (partition by pool, lane, channel) as first_seen from b""")
def w3(spark, sf_dir):
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    b = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("pool"), F.substring("o_orderpriority", 1, 1).cast("int").alias("lane"), (F.col("o_custkey") % 20).alias("channel"), at.alias("at"))
    return o.lane_round_robin(b, "pool", "lane", "channel", "at", "o_orderkey").select("o_orderkey", "pool", "lane", "channel", "rr", F.col("first_seen.at").alias("first_seen"))


@query("w4_latest_generation", sql(REQ, body="select tenant as id, arg_max(token, (created, event_id)) as token from req where tenant <> '' group by 1"))
def w4(spark, sf_dir):
    return lk.latest_generation(requests(spark, sf_dir).select(F.col("tenant").alias("id"), "token", "created", "event_id"))


@query("w5_due_retries", sql(REQ, body=f"select event_id, created + k as due_at from req where retry_count > 0 and created + k <= {NOW} order by due_at, event_id limit 100"))
def w5(spark, sf_dir):
    r = requests(spark, sf_dir).where("retry_count > 0").select("event_id", (F.col("created") + F.col("k")).alias("due_at"))
    return rq.due_retries(r, NOW)


@query("w6_reenter_retry", sql(REQ, body=f"""
select queue_id, id, deadline, cast(row_number() over (partition by queue_id order by deadline, id) as int) as rn from (
  select case when event_id % 9 = 0 then 'click' else queue_id end as queue_id, id, deadline from req where retry_count > 0 and created + k <= {NOW} union all select queue_id, id, deadline from req where retry_count = 0)
qualify row_number() over (partition by queue_id order by deadline, id) <= 10"""))
def w6(spark, sf_dir):
    r = requests(spark, sf_dir)
    due = r.where((F.col("retry_count") > 0) & (F.col("created") + F.col("k") <= NOW)).select(F.when(F.col("event_id") % 9 != 0, F.col("queue_id")).alias("queue_id"), "id", "deadline")
    waiting = r.where("retry_count = 0").select("queue_id", "id", "deadline")
    return rq.reenter(due, waiting, _budgets(r).withColumn("budget", F.lit(1.0)), 10, "click").select("queue_id", "id", "deadline", "rn")


@query("w7_dedupe_reentry", sql(REQ, body="select distinct id, token, retry_count from req"))
def w7(spark, sf_dir):
    r = requests(spark, sf_dir).select("id", "token", "retry_count")
    return rq.once_per_attempt(r.union(r.where("retry_count > 1")))


@query("w8_byte_budget_prefix", """
select l_orderkey, l_linenumber, upto from (select *, cast(sum(cast(l_quantity as bigint)) over (partition by l_suppkey % 5 order by t_at, l_orderkey, l_linenumber, l_partkey rows unbounded preceding) as bigint) as upto
  from (select *, cast(floor(epoch(l_shipdate)) as bigint) as t_at from lineitem)) where upto <= 51200 * (0.7::double - 0.1::double)""")
def w8(spark, sf_dir):
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))")
    b = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("q"), at.alias("at"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("tie"), F.col("l_quantity").cast("long").alias("size"))
    return o.byte_budget_prefix(b, "q", "at", "tie", "size", o.byte_cap(51200, 0.7, 0.1)).select("l_orderkey", "l_linenumber", "upto")


@query("w9_unknown_retry_queue", sql(REQ, CFG, body="select event_id, queue_id from req where retry_count > 0 and queue_id not in (select queue_id from cfg)"))
def w9(spark, sf_dir):
    return rq.unknown_queue(requests(spark, sf_dir).where("retry_count > 0"), queues(spark)).select("event_id", "queue_id")


@query("r1_merge_random_robin", sql(REQ, CFG, body="""
select event_id, pool, cast(turn as int) as turn from (select event_id, coalesce(nullif(pool, ''), 'default') as pool, row_number() over (partition by coalesce(nullif(pool, ''), 'default') order by md5('s1' || id)) as turn
  from req left join cfg using (queue_id)) where turn <= 64"""))
def r1(spark, sf_dir):
    o.register_merge_policy("seeded", lambda df: [F.md5(F.concat(F.lit("s1"), df["id"]))])
    j = lk.join_queue_config(requests(spark, sf_dir), queues(spark)).select("event_id", "id", "queue_id", "pool")
    names = [r[0] for r in QUEUES]
    each = [j.where(F.col("queue_id") == q) for q in names] + [j.where(~F.col("queue_id").isin(names))]
    return o.merge(each, [p[0] for p in POOLS], "seeded", take=64).select("event_id", "pool", "turn")


@query("r2_group_by_pool", sql(REQ, CFG, body="select coalesce(nullif(pool, ''), 'default') as pool, count(distinct queue_id) as queues, count(*) as n from req left join cfg using (queue_id) group by 1"))
def r2(spark, sf_dir):
    return rq.by_pool(requests(spark, sf_dir), queues(spark))


@query("r3_result_queue_routing", sql(REQ, CFG, body="select event_id, coalesce(nullif(result_queue, ''), case when event_id % 3 = 0 then 'from-message' end, 'results') as result_queue from req left join cfg using (queue_id)"))
def r3(spark, sf_dir):
    j = requests(spark, sf_dir).join(queues(spark), "queue_id", "left")
    return j.select("event_id", m.result_queue(F.col("result_queue"), F.when(F.col("event_id") % 3 == 0, "from-message").otherwise(""), "results").alias("result_queue"))
