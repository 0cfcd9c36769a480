"""Queries over counters, histograms, rates and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import budget as b
from sluice.operators import lookups as lk
from sluice.operators import metrics as mt
from sluice.operators import requests as rq
from sluice.operators import verdicts as vd
from sluice.plans.catalog import query
from sluice.plans.gates import TICKS, threshold_sql, ticks
from sluice.plans.outcomes import OUT, C, attempts
from sluice.operators import outcome as oc
from sluice.sources.tables import CFG, NOW, POOL, REQ, pools, queues, requests, sql

TRIPLE = ["queue_id", "queue_name", "pool_name"]
NAMED = "n as (select c.*, 'q-' || queue_id as queue_name, coalesce(pool, '') as pool_name from c left join cfg using (queue_id))"


def named(spark, sf_dir):
    a = lk.join_queue_config(attempts(spark, sf_dir), queues(spark))
    return a.withColumns({"queue_name": F.concat(F.lit("q-"), "queue_id"), "pool_name": F.col("pool"), "outcome": oc.attempt_outcome(F.col("category"), F.col("status"))})


@query("m1_outcome_counters", sql(REQ, C, CFG, NAMED, body=f"""
select queue_id, queue_name, pool_name, count(*) filter (where retry_count = 0) as requests, count(*) filter (where {OUT} = 'retry') as retries, count(*) filter (where {OUT} = 'result' and status < 400) as success,
  count(*) filter (where {OUT} = 'error' or {OUT} = 'result' and status >= 400) as failed, count(*) filter (where seconds_left <= 0) as deadline, count(*) filter (where category = 'RATE_LIMIT') as shed from n group by 1, 2, 3"""))
def m1(spark, sf_dir):
    return rq.outcome_counters(named(spark, sf_dir), TRIPLE)


# Bucket bounds in milliseconds, typed here once more so that the SQL holds the operators' own to them.
SQL_INFERENCE = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 120000)
SQL_RESIDENCE = (500, 1000, 2000, 5000, 10000, 30000, 60000, 120000, 300000, 600000, 1800000, 3600000, 7200000, 21600000, 43200000, 86400000)
SQL_LATENCY = (100, 1000, 5000, 10000, 20000, 50000, 100000, 200000, 500000, 1000000)


def hist_sql(value, bounds, where="true", cents=True):
    rows = " union all ".join([f"select queue_id, {float(b)}::double as le, count(*) filter (where v <= {b}) as n from x group by 1" for b in bounds] + ["select queue_id, null::double, count(*) from x group by 1"])
    return f"""select h.queue_id, le, n, round(t.total, 4) as total, t.count from (with x as (select queue_id, {value} as v from req where {where}) {rows}) h join (select queue_id, sum({value}) as total, count(*) as count from req where {where} group by 1) t on t.queue_id = h.queue_id"""


def _hist(df, bounds):
    return mt.histogram(df, ["queue_id"], "v", bounds).select("queue_id", "le", "n", F.round("total", 4).alias("total"), "count")


@query("m2_histogram_inference", sql(REQ, body=hist_sql("value * 20", SQL_INFERENCE)))
def m2(spark, sf_dir):
    return _hist(requests(spark, sf_dir).withColumn("v", F.col("value") * 20), mt.INFERENCE_MS)


@query("m3_histogram_residence", sql(REQ, body=hist_sql("k * k * 1000.0::double", SQL_RESIDENCE)))
def m3(spark, sf_dir):
    return _hist(requests(spark, sf_dir).withColumn("v", F.col("k") * F.col("k") * 1000.0), mt.RESIDENCE_MS)


@query("m4_histogram_latency", sql(REQ, body=hist_sql("k * 30.0::double", SQL_LATENCY, "status = 200")))
def m4(spark, sf_dir):
    return _hist(requests(spark, sf_dir).where("status = 200").withColumn("v", F.col("k") * 30.0), mt.LATENCY_MS)


@query("m5_depth_inflight_gauge", sql(REQ, body="""
select queue_id, tick, cast(sum(d) over (partition by queue_id order by tick) as bigint) as level from (select queue_id, moment - moment % 600 as tick, sum(d) as d from (
  select queue_id, created as moment, 1 as d from req union all select queue_id, created + 60 * k, -1 from req) group by 1, 2)"""))
def m5(spark, sf_dir):
    return mt.gauge(requests(spark, sf_dir).withColumn("done", F.col("created") + 60 * F.col("k")), ["queue_id"], "created", "done", 600)


@query("m6_backlog", sql(REQ, CFG, body=f"select queue_id, count(id) as pending from cfg left join (select queue_id, id from req where deadline >= {NOW} and queue_id <> 'view') using (queue_id) group by 1"))
def m6(spark, sf_dir):
    return rq.backlog(requests(spark, sf_dir).where((F.col("deadline") >= NOW) & (F.col("queue_id") != "view")), queues(spark))


REASON = "case when event_id % 31 = 0 then 'error' when event_id % 4 = 0 then case when class = 'overflow' then 'quota_exhausted' else 'gate_closed' end end"


@query("m7_gate_decisions", sql(REQ, CFG, body=f"""
select c.queue_id, r.reason, coalesce(d.n, 0) as n from cfg c cross join (values ('gate_closed'), ('quota_exhausted'), ('dropped'), ('error')) r(reason)
left join (select queue_id, {REASON} as reason, count(*) as n from req group by 1, 2) d on d.queue_id = c.queue_id and d.reason = r.reason"""))
def m7(spark, sf_dir):
    verdict = F.when(F.col("event_id") % 4 == 0, "REFUSE").otherwise("CONTINUE")
    reason = vd.decision_reason(verdict, F.col("class"), F.col("event_id") % 31 == 0)
    return rq.gate_decisions(requests(spark, sf_dir).withColumn("reason", reason), queues(spark), mt.REASONS)


@query("m8_gate_gauges", sql(REQ, TICKS, CFG, body=f"""
select g.pool as queue_id, 'q-' || g.pool as queue_name, coalesce(c.pool, '') as pool_name, round(arg_max({threshold_sql('has', 'v', 0.1, 0)}, tick) + 1e-9, 6) as budget, round(arg_max(v, tick) filter (where has and isfinite(v)) + 1e-9, 6) as value,
  0.1::double as threshold, arg_max(has and isfinite(v), tick) as available, max(tick) as seen from g left join cfg c on c.queue_id = g.pool group by 1, 2, 3"""))
def m8(spark, sf_dir):
    t = lk.join_queue_config(ticks(spark, sf_dir).withColumnRenamed("pool", "queue_id"), queues(spark))
    t = t.withColumns({"queue_name": F.concat(F.lit("q-"), "queue_id"), "pool_name": F.col("pool"), "budget": b.threshold(F.col("has"), F.col("v"), 0.1, 0)})
    g = mt.gate_gauges(t, TRIPLE, "tick", "has", "v", "budget", 0.1)
    return g.withColumns({"budget": F.round(F.col("budget") + 1e-9, 6), "value": F.round(F.col("value") + 1e-9, 6)})


COUNTER = "ct as (select queue_id, created, sum(n) over (partition by queue_id, created // 86400 order by created) as v from (select queue_id, created, count(*) as n from req group by 1, 2))"


def counter(r):
    """A counter per queue that restarts every day."""
    from sluice.operators import windows

    per = r.groupBy("queue_id", "created").agg(F.count("*").alias("n")).withColumn("day", F.floor(F.col("created") / 86400))
    return windows.running(per, ["queue_id", "day"], "created", [], v=F.col("n")).select("queue_id", "created", "v")


def rate_sql(src, out="rate", keys="queue_id"):
    return f"select {keys}, created - created % 3600 as start, round(sum(case when p is null then 0 when v >= p then v - p else v end) / 3600.0::double, 8) as {out} from (select *, lag(v) over (partition by {keys} order by created) as p from {src}) group by all"


@query("m9_rate", sql(REQ, COUNTER, body=rate_sql("ct")))
def m9(spark, sf_dir):
    return mt.rate(counter(requests(spark, sf_dir)), ["queue_id"], "created", "v", 3600).withColumn("rate", F.round("rate", 8))


COUNTED = {"requests": "true", "retries": "status in (429, 503)", "success": "status = 200", "shed": "status = 429", "deadline": "seconds_left <= 0"}
RATES = "ctr as (" + " union all ".join(f"select queue_id, '{n}' as counter, created, cast(sum(count(*) filter (where {c})) over (partition by queue_id, created // 86400 order by created) as double) as v from c group by queue_id, created" for n, c in COUNTED.items()) + """),
stp as (select *, lag(v) over (partition by queue_id, counter order by created) as p from ctr),
rts as (select queue_id, counter, created - created % 21600 as start, sum(case when p is null then 0 when v >= p then v - p else v end) / 21600.0::double as r from stp group by 1, 2, 3),
rt as (select a.queue_id, a.start, a.counter, a.r / nullif(b.r, 0) as ratio from rts a join rts b on a.queue_id = b.queue_id and a.start = b.start and b.counter = 'requests' where a.counter <> 'requests')"""


def ratios(spark, sf_dir):
    """Shares of the request rate, per queue and six hours, from counters that restart every day."""
    from sluice.operators import windows

    r = attempts(spark, sf_dir).withColumn("day", F.floor(F.col("created") / 86400))
    per = r.groupBy("queue_id", "day", "created").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in COUNTED.items()))
    total = windows.running(per, ["queue_id", "day"], "created", [], **{f"t_{n}": F.col(n) for n in COUNTED})
    long = total.select("queue_id", "created", F.inline(F.array(*(F.struct(F.lit(n).alias("counter"), F.col(f"t_{n}").alias("v")) for n in COUNTED))))
    return mt.rate_ratios(mt.rate(long, ["queue_id", "counter"], "created", "v", 21600), ["queue_id"], "counter", "requests")


@query("m10_rate_ratio", sql(REQ, C, RATES, body="""
select queue_id, start, """ + ", ".join(f"round(max(ratio) filter (where counter = '{n}'), 6) as {n}" for n in COUNTED if n != "requests") + " from rt group by 1, 2"))
def m10(spark, sf_dir):
    names = [n for n in COUNTED if n != "requests"]
    wide = ratios(spark, sf_dir).groupBy("queue_id", "start").pivot("counter", names).agg(F.first("ratio"))
    return wide.select("queue_id", "start", *(F.round(n, 6).alias(n) for n in names))


@query("m11_histogram_quantile", sql(REQ, "h as (" + hist_sql("value * 20", SQL_INFERENCE) + ")", body="""
select queue_id, round(case when le is null then low else low + (le - low) * (rank - below) / (n - below) end, 4) as value from (
  select *, coalesce(lag(le) over w, 0) as low, coalesce(lag(n) over w, 0) as below, count * 0.95::double as rank from h window w as (partition by queue_id order by le nulls last)) where n >= rank
qualify row_number() over (partition by queue_id order by le nulls last) = 1"""))
def m11(spark, sf_dir):
    h = mt.histogram(requests(spark, sf_dir).withColumn("v", F.col("value") * 20), ["queue_id"], "v", mt.INFERENCE_MS)
    return mt.quantile(h, ["queue_id"], 0.95).withColumn("value", F.round("value", 4))


@query("m12_alert_sessions", sql(REQ, C, RATES, """ru as (select queue_id, rule, start, coalesce(case when ups then ratio > least_ else ratio < least_ end, false) as c, hold from rt join (values ('high retry rate', 'retries', true, 0.5::double, 900),
  ('high deadline exceeded rate', 'deadline', true, 0.1::double, 600), ('low success rate', 'success', false, 0.9::double, 600), ('high shed rate', 'shed', true, 0.1::double, 600)) l(rule, counter, ups, least_, hold) using (counter)),
s as (select *, case when c and not coalesce(lag(c) over (partition by queue_id, rule order by start), false) then start end as st from ru)""", body="""
select queue_id, rule, start, case when c then max(st) over w end as session, c and start - max(st) over w >= hold as firing from s window w as (partition by queue_id, rule order by start)"""))
def m12(spark, sf_dir):
    return mt.alerts(ratios(spark, sf_dir), ["queue_id"], "start", "counter", "ratio", mt.ALERT_RULES)


@query("m13_rates_by_queue", sql(REQ, C, body=f"""
select queue_id, count(*) filter (where {OUT} = 'result') / 2592000.0::double as result, count(*) filter (where {OUT} = 'retry') / 2592000.0::double as retry, count(*) filter (where {OUT} = 'error') / 2592000.0::double as error from c group by 1"""))
def m13(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("outcome", oc.attempt_outcome(F.col("category"), F.col("status")))
    return rq.outcome_rates(a, ["queue_id"], 2592000)


@query("m14_throttle_by_pool", sql(REQ, CFG, body="select coalesce(pool, '') as pool, created - created % 86400 as start, count(*) / 86400.0::double as rate from req left join cfg using (queue_id) where event_id % 4 = 0 and class <> 'overflow' group by 1, 2"))
def m14(spark, sf_dir):
    return rq.throttle_rates(requests(spark, sf_dir).where("event_id % 4 = 0"), queues(spark))


@query("m15_headroom", sql(REQ, TICKS, body="select pool, tick, n / 10.0::double - 0.8::double as headroom from g"))
def m15(spark, sf_dir):
    t = ticks(spark, sf_dir)
    values = t.select("pool", "tick", (F.col("n") / F.lit(10.0)).alias("value"))
    return lk.join_unique(values, t.select("pool", "tick", F.lit(0.8).alias("least")), ["pool", "tick"]).select("pool", "tick", (F.col("value") - F.col("least")).alias("headroom"))


@query("m16_relabel_pool", sql(REQ, body="select event_id, case when event_id % 2 = 0 then 'pool-x' else queue_id end as pool from req"))
def m16(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", rq.pool_or_default(F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("queue_id")), "pool-x").alias("pool"))


@query("m17_worker_utilisation", sql(REQ, CFG, POOL, body="""
select p.pool, tick, round(level / (case when workers > 0 then workers else 64 end)::double, 6) as used from (
  select pool, tick, cast(sum(d) over (partition by pool order by tick) as bigint) as level from (select pool, moment - moment % 3600 as tick, sum(d) as d from (
    select coalesce(nullif(pool, ''), 'default') as pool, created as moment, 1 as d from req left join cfg using (queue_id) union all select coalesce(nullif(pool, ''), 'default'), created + 60 * k, -1 from req left join cfg using (queue_id)) group by 1, 2)) x join pools p on p.pool = x.pool"""))
def m17(spark, sf_dir):
    j = lk.join_queue_config(requests(spark, sf_dir), queues(spark)).withColumns({"pool": rq.pool_or_default("pool"), "done": F.col("created") + 60 * F.col("k")})
    g = mt.gauge(j, ["pool"], "created", "done", 3600).join(pools(spark), "pool")
    return g.select("pool", "tick", F.round(F.col("level") / rq.worker_count(F.col("workers")), 6).alias("used"))


@query("m18_load_summary", sql(REQ, body="select queue_id, max(created + k) - min(created) as clearing, round(avg(case when event_id % 7 <> 0 then value end), 6) as mean_saturation from req group by 1"))
def m18(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("sat", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))
    r = r.withColumn("finished", F.col("created") + F.col("k"))
    return rq.load_summary(r, ["queue_id"], "created", "finished", "sat").withColumn("mean_saturation", F.round("mean_saturation", 6))


@query("m19_source_health", sql(REQ, body="""
select tenant, case when bad is not null and (good is null or bad > good) and 1706659200 - bad < 86400 then 'unhealthy' when good is not null and 1706659200 - good < 86400 then 'healthy' else 'unknown' end as health from (
  select tenant, max(case when status = 200 then created end) as good, max(case when status <> 200 then created end) as bad from req group by 1)"""))
def m19(spark, sf_dir):
    return mt.source_health(requests(spark, sf_dir).select("tenant", F.col("created").alias("at"), (F.col("status") == 200).alias("ok")), ["tenant"], 1706659200, 86400)
