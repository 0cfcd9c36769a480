"""Queries over projections, filters and lookups of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import scalars as sc
from sluice.functions.maps import as_text, overlay, without
from sluice.operators import lookups as lk
from sluice.operators import ordering, windows
from sluice.operators.caching import cached_asof
from sluice.operators import requests as rq
from sluice.plans.catalog import query
from sluice.sources.tables import CFG, NOW, POOL, POOLS, REQ, pools, queues, read, requests, sql


def message():
    """Labels that a request carries."""
    return F.create_map(F.lit("tenant"), F.col("tenant"), F.lit("class"), F.col("class"))


@query("p1_drop_expired_at_dequeue", sql(REQ, body=f"select event_id, deadline from req where deadline >= {NOW}"))
def p1(spark, sf_dir):
    return rq.not_expired(requests(spark, sf_dir), NOW).select("event_id", "deadline")


@query("p2_validate_request", sql(REQ, body=f"select event_id, case when event_id % 13 = 0 then 'INVALID_REQUEST' when deadline < {NOW} then 'DEADLINE_EXCEEDED' end as error_code from req"))
def p2(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("deadline", F.when(F.col("event_id") % 13 == 0, -1).otherwise(F.col("deadline")))
    return r.select("event_id", rq.validity(F.col("deadline"), NOW).alias("error_code"))


@query("p3_drop_invalid_at_dequeue", sql(REQ, body="select event_id, case when event_id % 5 = 0 then 'unparsable' when event_id % 13 = 0 then 'no deadline' end as reject from req where event_id % 5 = 0 or event_id % 13 = 0"))
def p3(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("value", F.expr("case when event_id % 5 = 0 then '{' else concat('{\"deadline\":', if(event_id % 13 = 0, 0, deadline), '}') end"))
    return r.select("event_id", rq.dequeue_reject(F.col("value")).alias("reject")).where("reject is not null")


@query("p4_inject_labels", sql(REQ, CFG, body="""
select event_id, 'class=' || class || case when coalesce(team, '') <> '' then ';team=' || team else '' end || ';tenant=' || case when coalesce(tenant_label, '') <> '' then tenant_label else tenant end as labels from req left join cfg using (queue_id)"""))
def p4(spark, sf_dir):
    j = requests(spark, sf_dir).join(queues(spark), "queue_id", "left")
    return j.select("event_id", as_text(overlay(message(), F.col("labels"))).alias("labels"))


@query("p5_default_routing", sql(REQ, body="select event_id, case when event_id % 3 = 0 then 'requests' else 'own' end as request_queue, case when event_id % 4 = 0 then 'q0' else queue_id end as queue_id from req"))
def p5(spark, sf_dir):
    r = requests(spark, sf_dir).withColumns({"request_queue": F.when(F.col("event_id") % 3 == 0, "").otherwise("own"), "queue_id": F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("queue_id"))})
    return rq.default_routing(r, "requests", "q0").select("event_id", "request_queue", "queue_id")


@query("p6_build_url", sql(REQ, CFG, body="""
select event_id, regexp_replace(base, '/+$', '') || case when starts_with(p, '/') then p else '/' || p end as url from (select event_id, base, case when event_id % 3 = 0 then 'v2/own' else path end as p from req join cfg using (queue_id))"""))
def p6(spark, sf_dir):
    j = requests(spark, sf_dir).join(queues(spark), "queue_id")
    return j.select("event_id", sc.build_url(F.col("base"), F.when(F.col("event_id") % 3 == 0, "v2/own").otherwise(""), F.col("path")).alias("url"))


@query("p7_build_headers", sql(REQ, CFG, body="""
select event_id, 'Content-Type=' || case when event_id % 2 = 0 then 'text/plain' else 'application/json' end || case when objective <> '' then ';x-gateway-inference-objective=' || objective else '' end as headers from req join cfg using (queue_id)"""))
def p7(spark, sf_dir):
    j = requests(spark, sf_dir).join(queues(spark), "queue_id")
    return j.select("event_id", as_text(lk.build_headers(F.col("objective"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("Content-Type"), F.lit("text/plain"))))).alias("headers"))


@query("p8_stamp_fairness", sql(REQ, body="""
select event_id, case when tenant = '' or event_id % 5 = 0 or event_id % 7 = 0 then 'X-FAIR=caller;other=1' else 'other=1;x-fair=' || tenant end as headers from req"""))
def p8(spark, sf_dir):
    r = requests(spark, sf_dir)
    attr = F.when(F.col("event_id") % 5 == 0, F.repeat(F.lit("é"), 129)).when(F.col("event_id") % 7 == 0, F.lit("a\nb")).otherwise(F.col("tenant"))
    given = F.create_map(F.lit("X-FAIR"), F.lit("caller"), F.lit("other"), F.lit("1"))
    return r.select("event_id", as_text(lk.stamp_fairness(given, attr, "x-fair")).alias("headers"))


LANE = "cast(3 * (case class when 'reserved' then 0 else 1 end) + case tier when 'interactive' then 0 when 'async' then 1 else 2 end as int)"


@query("p9_priority_header", sql(REQ, body=f"select event_id, 'a=1;x-priority=' || {LANE} as headers from req"))
def p9(spark, sf_dir):
    lane = ordering.lane(F.col("class"), F.col("tier")).cast("string")
    return requests(spark, sf_dir).select("event_id", as_text(overlay(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("x-priority"), lane))).alias("headers"))


@query("p10_content_type_override", sql(REQ, body="select event_id, 'Content-Type=multipart/form-data;a=' || tenant as headers from req"))
def p10(spark, sf_dir):
    given = F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("a"), F.col("tenant"))
    return requests(spark, sf_dir).select("event_id", as_text(overlay(without(given, F.lit("content-type")), F.create_map(F.lit("Content-Type"), F.lit("multipart/form-data")))).alias("headers"))


@query("p11_label_match", sql(REQ, body="select event_id, (class = 'reserved' and (event_id % 2 = 0 or queue_id = '')) as matches from req"))
def p11(spark, sf_dir):
    labels = F.map_filter(F.create_map(F.lit("class"), F.col("class"), F.lit("zone"), F.when(F.col("event_id") % 2 == 1, "z")), lambda k, v: v.isNotNull())
    wanted = F.create_map(F.lit("class"), F.lit("reserved"), F.lit("zone"), F.lit(""))
    return requests(spark, sf_dir).select("event_id", lk.label_match(labels, wanted).alias("matches"))


@query("p12_effective_deadline", sql(REQ, body=f"select event_id, least({NOW} + 300, deadline) as effective_deadline from req"))
def p12(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", rq.effective_deadline(F.col("deadline"), F.lit(NOW), 300).alias("effective_deadline"))


@query("p13_pool_defaults", "select cast(s_nationkey as int) as pool, sum(case when s_suppkey % 4 > 0 then s_suppkey % 4 else 64 end)::bigint as workers from supplier group by 1")
def p13(spark, sf_dir):
    w = F.col("s_suppkey") % 4
    return read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("pool")).agg(F.sum(rq.worker_count(w)).alias("workers"))


@query("j1_join_queue_config", sql(REQ, CFG, body="select event_id, queue_id, coalesce(pool, '') as pool, result_queue from req left join cfg using (queue_id)"))
def j1(spark, sf_dir):
    return lk.join_queue_config(requests(spark, sf_dir), queues(spark)).select("event_id", "queue_id", "pool", "result_queue")


@query("j2_join_pool_config", sql(REQ, CFG, POOL, body="select event_id, p.pool, p.workers from req join cfg using (queue_id) join pools p on p.pool = coalesce(nullif(cfg.pool, ''), 'default')"))
def j2(spark, sf_dir):
    j = lk.join_queue_config(requests(spark, sf_dir), queues(spark)).where("result_queue is not null").withColumn("pool", rq.pool_or_default("pool"))
    return lk.join_pool_config(j, pools(spark), [p[0] for p in POOLS]).select("event_id", "pool", "workers")


CANCELS = "cancels as (select id, token from req where event_id % 17 = 0 union all select id, 'stale' from req where event_id % 19 = 0)"


def _cancels(r):
    return r.where("event_id % 17 = 0").select("id", "token").union(r.where("event_id % 19 = 0").select("id", F.lit("stale")))


@query("j3_anti_join_cancelled", sql(REQ, CANCELS, body="select event_id from req where not exists (select 1 from cancels c where c.id = req.id and c.token = req.token)"))
def j3(spark, sf_dir):
    r = requests(spark, sf_dir)
    return lk.not_cancelled(r, _cancels(r)).select("event_id")


GEN = "gen as (select tenant as id, token, created, event_id from req where tenant <> '')"


@query("j4_mark_cancelled", sql(REQ, GEN, body="""
select id, arg_max(token, (created, event_id)) as token from gen where id in (select tenant from req where event_id % 23 = 0) group by id"""))
def j4(spark, sf_dir):
    r = requests(spark, sf_dir)
    commands = r.where("event_id % 23 = 0").select(F.col("tenant").alias("id"))
    return lk.mark_cancelled(commands, r.select(F.col("tenant").alias("id"), "token", "created", "event_id"))


@query("j5_cleanup_generation", sql(REQ, body="""
select m.id, m.token from (select id, token from req where event_id % 3 = 0) m where not exists (select 1 from (select id, case when event_id % 2 = 0 then token else 'old' end as token from req) d where d.id = m.id and d.token = m.token)"""))
def j5(spark, sf_dir):
    r = requests(spark, sf_dir)
    done = r.select("id", F.when(F.col("event_id") % 2 == 0, F.col("token")).otherwise("old").alias("token"))
    return rq.open_generations(r.where("event_id % 3 = 0").select("id", "token"), done)


TICK = "tick as (select queue_id as pool, created - created % 3600 as tick, sum(value) as queue_size, avg(value) as avg_size, sum(k)::bigint as running, count(*) as n from req group by 1, 2)"


@query("j6_join_ready_pods", sql(REQ, TICK, body="select t.pool, t.tick, round(queue_size, 6) as queue_size, ready from tick t join (select pool, tick, (tick // 3600) % 4 as ready from tick) r on r.pool = t.pool and r.tick = t.tick"))
def j6(spark, sf_dir):
    t = lk.ticks(requests(spark, sf_dir))
    ready = t.select("pool", "tick", F.expr("(tick div 3600) % 4").alias("ready"))
    return lk.join_unique(t, ready, ["pool", "tick"]).select("pool", "tick", F.round("queue_size", 6).alias("queue_size"), "ready")


@query("j7_latest_sample_asof", sql(REQ, body="""
, l as (select event_id, queue_id, created from req where event_id % 5 = 1), r as (select queue_id, created, max(value) as sample from req where event_id % 5 <> 1 group by 1, 2)
select l.event_id, case when l.created - r.created <= 3600 then r.created end as at, case when l.created - r.created <= 3600 then r.sample end as sample from l asof left join r on l.queue_id = r.queue_id and l.created >= r.created""".replace("\n, l as", "\nselect * from (with l as", 1) + ")"))
def j7(spark, sf_dir):
    r = requests(spark, sf_dir)
    samples = r.where("event_id % 5 <> 1").groupBy("queue_id", "created").agg(F.max("value").alias("sample"))
    found = windows.asof(r.where("event_id % 5 = 1").select("event_id", "queue_id", "created"), samples, ["queue_id"], "created", ["sample"])
    fresh = F.col("created") - F.col("at") <= 3600
    return found.select("event_id", F.when(fresh, F.col("at")).alias("at"), F.when(fresh, F.col("sample")).alias("sample"))


@query("j7_cached_sample", f"""with recursive {REQ}, l as (select event_id, queue_id, created from req where event_id % 5 <> 0), s as (select queue_id, created, max(value) as sample from req where event_id % 5 = 0 group by 1, 2),
tt as (select distinct queue_id, created from l), nxt as (select queue_id, created, min(created) over (partition by queue_id order by created range between 3600 following and unbounded following) as following from tt),
r as (select queue_id, min(created) as created from tt group by 1 union all select r.queue_id, nxt.following from r join nxt on r.queue_id = nxt.queue_id and r.created = nxt.created and nxt.following is not null),
f as (select r.queue_id, r.created, s.created as at, s.sample from (select distinct * from r) r asof left join s on r.queue_id = s.queue_id and r.created >= s.created)
select l.event_id, f.created as refreshed_at, f.at, f.sample from l asof join f on l.queue_id = f.queue_id and l.created >= f.created""")
def j7_cached(spark, sf_dir):
    r = requests(spark, sf_dir)
    samples = r.where("event_id % 5 = 0").groupBy("queue_id", "created").agg(F.max("value").alias("sample"))
    reads = r.where("event_id % 5 <> 0").select("event_id", "queue_id", "created")
    return cached_asof(reads, samples, ["queue_id"], "created", ["sample"], 3600).select("event_id", "refreshed_at", "at", "sample")


@query("j8_gate_gauges_join", sql(REQ, TICK, body="select pool, tick, round(1 - running / 1000.0::double, 6) as budget, round(avg_size, 6) as value, 0.8::double as threshold, n > 3 as available from tick"))
def j8(spark, sf_dir):
    t = lk.ticks(requests(spark, sf_dir))
    key = ["pool", "tick"]
    out = lk.join_unique(t.select(*key, F.round(1 - F.col("running") / F.lit(1000.0), 6).alias("budget")), t.select(*key, F.round("avg_size", 6).alias("value")), key)
    return lk.join_unique(out, t.select(*key, F.lit(0.8).alias("threshold"), (F.col("n") > 3).alias("available")), key)


@query("j9_match_results_to_requests", sql(REQ, body="select event_id, case when event_id % 6 <> 0 then created + k end as finished, case when event_id % 6 <> 0 then k end as latency from req"))
def j9(spark, sf_dir):
    r = requests(spark, sf_dir)
    results = r.where("event_id % 6 <> 0").select("id", (F.col("created") + F.col("k")).alias("finished"))
    return rq.match_results(r.select("event_id", "id", "created"), results).select("event_id", "finished", "latency")
