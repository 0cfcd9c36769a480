"""Queries over budgets (per pool and tick) and per-message verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import budget as b
from sluice.operators import lookups as lk
from sluice.operators import requests as rq
from sluice.operators import verdicts as vd
from sluice.plans.catalog import query
from sluice.sources.tables import NOW, REQ, requests, sql

#: Ticks with samples that are missing, not numbers or infinite at given hours.
TICKS = """t0 as (select queue_id as pool, created - created % 3600 as tick, sum(value) as queue_size, avg(value) as avg_size, sum(k)::bigint as running, count(*) as n from req group by 1, 2),
g as (select *, (tick // 3600) % 4 as ready, (tick // 3600) % 5 <> 0 as has, case when (tick // 3600) % 7 = 0 then 'nan'::double when (tick // 3600) % 11 = 0 then 'inf'::double else avg_size / 100 end as v from t0)"""


def ticks(spark, sf_dir):
    t = lk.ticks(requests(spark, sf_dir))
    h = F.expr("tick div 3600")
    v = F.when(h % 7 == 0, float("nan")).when(h % 11 == 0, float("inf")).otherwise(F.col("avg_size") / 100)
    return t.withColumns({"ready": h % 4, "has": h % 5 != 0, "v": v})


def unit_sql(x):
    return f"least(1.0::double, greatest(0.0::double, {x}))"


def threshold_sql(has, v, least, fallback):
    return f"case when not ({has}) or {v} is null or isnan({v}) or isinf({v}) then {unit_sql(f'{fallback}::double')} when {v} <= {least}::double then 0.0::double else {unit_sql(f'{v} - {least}::double')} end"


def out(df, **columns):
    return df.select("pool", "tick", *(F.round(c + 1e-9, 6).alias(n) for n, c in columns.items()))


@query("g1_budget_threshold", sql(REQ, TICKS, body=f"select pool, tick, round({threshold_sql('has', 'v', 0.1, 2)} + 1e-9, 6) as budget from g"))
def g1(spark, sf_dir):
    return out(ticks(spark, sf_dir), budget=b.threshold(F.col("has"), F.col("v"), 0.1, 2))


@query("g2_budget_saturation", sql(REQ, TICKS, body=f"select pool, tick, round({threshold_sql('has', '(1 - v)', '(1 - 0.8::double)', 1)} + 1e-9, 6) as budget from g"))
def g2(spark, sf_dir):
    return out(ticks(spark, sf_dir), budget=b.saturation(F.col("has"), F.col("v")))


def ratio_sql(load):
    return f"case when ready > 0 then 1 - {load}::double / (ready * 100) end"


@query("g3_flow_control_budget", sql(REQ, TICKS, body=f"select pool, tick, round({ratio_sql('queue_size')} + 1e-9, 6) as budget from g"))
def g3(spark, sf_dir):
    return out(ticks(spark, sf_dir), budget=b.headroom(F.col("queue_size"), F.col("ready"), F.lit(100)))


@query("g4_pod_queue_budget", sql(REQ, body="""
select pool, tick, round(1 - avg(size) / 100 + 1e-9, 6) as budget from (select queue_id as pool, created - created % 3600 as tick, k % 3 as pod, sum(value) as size from req where k % 3 > 0 group by 1, 2, 3) group by 1, 2"""))
def g4(spark, sf_dir):
    r = requests(spark, sf_dir).withColumns({"pool": F.col("queue_id"), "tick": F.col("created") - F.col("created") % 3600, "pod": F.col("k") % 3})
    pods = r.where("pod > 0").groupBy("pool", "tick", "pod").agg(F.sum("value").alias("size"))
    return out(b.pod_queue(pods, ["pool", "tick"], "size", 100), budget=F.col("value"))


@query("g5_running_budget", sql(REQ, TICKS, body=f"select pool, tick, round({ratio_sql('running')} + 1e-9, 6) as budget from g"))
def g5(spark, sf_dir):
    return out(ticks(spark, sf_dir), budget=b.headroom(F.col("running").cast("double"), F.col("ready"), F.lit(100)))


CASCADE = f"""c as (select *, has as h0, {ratio_sql('queue_size')} as v0, (tick // 3600) % 3 <> 0 as h1, 1 - avg_size / 100 as v1, (tick // 3600) % 2 = 0 as h2, {ratio_sql('running')} as v2 from g),
d as (select *, h0 or h1 or h2 as any_has, case when h0 then v0 when h1 then v1 when h2 then v2 end as val, case when h0 then 0 when h1 then 1 when h2 then 2 end as source_index from c)"""


def _cascade(t):
    h = F.expr("tick div 3600")
    return b.cascade([
        (F.col("has"), b.headroom(F.col("queue_size"), F.col("ready"), F.lit(100))), (h % 3 != 0, 1 - F.col("avg_size") / 100), (h % 2 == 0, b.headroom(F.col("running").cast("double"), F.col("ready"), F.lit(100))),
    ])


@query("g6_cascade", sql(REQ, TICKS, CASCADE, body="select pool, tick, round(val + 1e-9, 6) as value, source_index from d"))
def g6(spark, sf_dir):
    t = ticks(spark, sf_dir)
    _, value, index = _cascade(t)
    return t.select("pool", "tick", F.round(value + 1e-9, 6).alias("value"), index.alias("source_index"))


@query("g7_budget_cascaded", sql(REQ, TICKS, CASCADE, body=f"select pool, tick, round({threshold_sql('any_has', 'val', 0.05, 0)} + 1e-9, 6) as budget from d"))
def g7(spark, sf_dir):
    t = ticks(spark, sf_dir)
    has, value, _ = _cascade(t)
    return out(t, budget=b.threshold(has, value, 0.05, 0))


@query("g8_budget_from_query", sql(REQ, TICKS, body=f"select pool, tick, round({threshold_sql('true', '(1 - n / 50.0::double)', 0, 0)} + 1e-9, 6) as budget from g"))
def g8(spark, sf_dir):
    return out(b.with_budget(ticks(spark, sf_dir), "1 - n / 50.0"), budget=F.col("budget"))


@query("g9_budget_from_scrape", sql(REQ, TICKS, body=f"""select pool, tick, round({threshold_sql('has and ready > 0', f"(1 - {unit_sql('avg_size / (ready * 50)')})", 0.05, 0)} + 1e-9, 6) as budget from g"""))
def g9(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return out(t, budget=b.scraped(F.col("avg_size"), F.nullif(F.col("ready") * 50, F.lit(0)), 0.05, F.col("has") & (F.col("ready") > 0)))


@query("g10_budget_binary", sql(REQ, TICKS, body="select pool, tick, case when has and n % 3 <> 0 then 0.0::double else 1.0::double end as budget from g"))
def g10(spark, sf_dir):
    return out(ticks(spark, sf_dir), budget=b.binary(F.col("has"), F.col("n") % 3))


@query("g11_budget_external", sql(REQ, TICKS, body=f"select pool, tick, round(case when ready = 3 then 0 when ready = 2 or not has then 1 else {unit_sql('n / 8.0::double')} end + 1e-9, 6) as budget from g"))
def g11(spark, sf_dir):
    text = F.when(~F.col("has"), F.lit(None)).when(F.col("ready") == 2, "open?").otherwise((F.col("n") / 8.0).cast("string"))
    return out(ticks(spark, sf_dir), budget=b.external(text, F.col("ready") == 3))


@query("g12_budget_constant", sql(REQ, TICKS, body="select pool, tick, 1.0::double as budget from g"))
def g12(spark, sf_dir):
    return out(ticks(spark, sf_dir), budget=b.gate("no such gate"))


@query("g13_budget_composite", sql(REQ, TICKS, body=f"select pool, tick, round(least(1.0::double, {threshold_sql('has', 'v', 0.1, 1)}, n / 8.0::double) + 1e-9, 6) as budget from g"))
def g13(spark, sf_dir):
    return out(ticks(spark, sf_dir), budget=b.composite([b.threshold(F.col("has"), F.col("v"), 0.1, 1), F.col("n") / 8.0]))


@query("g14_budget_local", sql(REQ, TICKS, body="select pool, tick, round(greatest(0.0::double, (8 - n) / 8.0::double) + 1e-9, 6) as budget from g"))
def g14(spark, sf_dir):
    return out(ticks(spark, sf_dir), budget=b.local(F.col("n"), 8))


@query("g15_dispatch_count", sql(REQ, TICKS, body=f"select pool, tick, cast(greatest(0, floor(10.0::double * {threshold_sql('has', 'v', 0.1, 0)})) as bigint) as dispatch from g"))
def g15(spark, sf_dir):
    return ticks(spark, sf_dir).select("pool", "tick", b.dispatch_count(10, b.threshold(F.col("has"), F.col("v"), 0.1, 0)).alias("dispatch"))


@query("g16_dispatchable_n", sql(REQ, TICKS, body="select pool, tick, round(case when avg_size / 100 > 0.05::double then ready * 100 * (avg_size / 100 - 0.05::double) else 0 end + 1e-9, 6) as n from g"))
def g16(spark, sf_dir):
    return out(ticks(spark, sf_dir), n=rq.dispatchable(F.col("ready"), F.lit(100), F.col("avg_size") / 100, 0.05))


@query("g17_closing_point", sql(REQ, TICKS, body="select pool, tick, ready * 95.0::double as closing from g"))
def g17(spark, sf_dir):
    return out(ticks(spark, sf_dir), closing=rq.closing_point(F.col("ready"), F.lit(100), 0.05))


@query("g18_peak_per_pod", sql(REQ, TICKS, body="select pool, tick - tick % 21600 as start, round(max(case when ready > 0 then running::double / ready end) + 1e-9, 6) as peak from g group by 1, 2"))
def g18(spark, sf_dir):
    t = ticks(spark, sf_dir)
    t = t.withColumn("start", F.col("tick") - F.col("tick") % 21600)
    return rq.peak_per_pod(t, ["pool", "start"], "running", "ready").withColumn("peak", F.round(F.col("peak") + 1e-9, 6))


# Per-message verdicts. The inner verdict and the class are functions of the request.
INNER = "case event_id % 4 when 0 then 'REFUSE' when 1 then 'WAIT' else 'CONTINUE' end"


def inner():
    m = F.col("event_id") % 4
    return F.when(m == 0, "REFUSE").when(m == 1, "WAIT").otherwise("CONTINUE")


@query("a4_quota_key", sql(REQ, body="select event_id, case when event_id % 6 <> 0 then 'quota:userid:' || case when event_id % 5 = 0 then '' else tenant end end as key from req"))
def a4(spark, sf_dir):
    labels = F.map_filter(F.create_map(F.lit("userid"), F.when(F.col("event_id") % 6 != 0, F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("tenant")))), lambda k, v: v.isNotNull())
    return requests(spark, sf_dir).select("event_id", vd.quota_key(labels, "quota:", "userid").alias("key"))


@query("a6_tier_admission", sql(REQ, body=f"""select event_id, case when {INNER} <> 'REFUSE' then 'CONTINUE' when class = 'reserved' then 'WAIT' when class = 'overflow' and tier = 'interactive' then 'DROP' else 'REFUSE' end as verdict,
  case when {INNER} = 'REFUSE' and class = 'overflow' and tier = 'interactive' then 429 end as code from req"""))
def a6(spark, sf_dir):
    v = vd.tier_admission(inner(), F.col("class"), F.col("tier"))
    return requests(spark, sf_dir).select("event_id", v.alias("verdict"), F.get_json_object(F.when(v == "DROP", F.lit(vd.DROP_BODY)), "$.code").cast("int").alias("code"))


@query("a7_wait_on_refuse", sql(REQ, body=f"select event_id, case when {INNER} = 'REFUSE' then 'WAIT' else {INNER} end as verdict from req"))
def a7(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", vd.wait_on_refuse(inner()).alias("verdict"))


@query("a9_budget_verdict", sql(REQ, TICKS, body=f"select pool, tick, case when {threshold_sql('has', 'v', 0.1, 0)} <= 0 then 'REFUSE' else 'CONTINUE' end as verdict from g"))
def a9(spark, sf_dir):
    return ticks(spark, sf_dir).select("pool", "tick", vd.budget_verdict(b.threshold(F.col("has"), F.col("v"), 0.1, 0)).alias("verdict"))


@query("a10_verdict_routing", sql(REQ, body=f"select event_id, case {INNER} when 'REFUSE' then 'requeue' when 'WAIT' then 'dispatch' else 'dispatch' end as at_queue, case {INNER} when 'REFUSE' then 'requeue' when 'WAIT' then 'park' else 'dispatch' end as at_pool from req"))
def a10(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", vd.route(inner(), "queue").alias("at_queue"), vd.route(inner(), "pool").alias("at_pool"))


@query("a11_decision_reason", sql(REQ, body=f"select event_id, case when event_id % 31 = 0 then 'error' when {INNER} = 'REFUSE' then case when class = 'overflow' then 'quota_exhausted' else 'gate_closed' end end as reason from req"))
def a11(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", vd.decision_reason(inner(), F.col("class"), F.col("event_id") % 31 == 0).alias("reason"))


@query("a12_closed_round", sql(REQ, TICKS, body=f"""select g.pool, tick, (p.backlog > 0) or g.pool = 'purchase' as counted from g left join (select queue_id as pool, count(*) filter (where deadline >= {NOW} and event_id % 2 = 0) as backlog from req group by 1) p on p.pool = g.pool where {threshold_sql('has', 'v', 0.1, 0)} <= 0"""))
def a12(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("budget", b.threshold(F.col("has"), F.col("v"), 0.1, 0))
    pending = requests(spark, sf_dir).groupBy(F.col("queue_id").alias("pool")).agg(F.count_if((F.col("deadline") >= NOW) & (F.col("event_id") % 2 == 0)).alias("backlog"))
    return vd.closed_rounds(t.withColumn("topic", F.col("pool") == "purchase"), pending, "pool").select("pool", "tick", "counted")
