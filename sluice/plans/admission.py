"""Queries over quotas that depend on earlier admissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import admission as ad
from sluice.plans.catalog import query
from sluice.plans.gates import TICKS, threshold_sql, ticks
from sluice.operators import budget as b
from sluice.operators import verdicts as vd
from sluice.sources.tables import REQ, requests, sql


def replay_sql(key, end, limit, extra="", columns="event_id, key, admitted"):
    """Replay of each key's requests one after another, with the ends of the live slots in a list."""
    free = "list_filter(r.live, lambda x: x > o.created)"
    return f"""with recursive {REQ}{extra}, o as (select event_id, {key} as key, created, {end} as done, row_number() over (partition by {key} order by created, event_id) as rn from req),
r as (select key, rn, event_id, created, true as admitted, [done] as live from o where rn = 1
  union all select o.key, o.rn, o.event_id, o.created, len({free}) < {limit}, case when len({free}) < {limit} then list_append({free}, o.done) else {free} end from r join o on o.key = r.key and o.rn = r.rn + 1)
select {columns} from r"""


@query("a1_rate_limit", replay_sql("tenant", "created + 86400", 3))
def a1(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("done", F.col("created") + 86400)
    a = ad.admit(r, key="tenant", time="created", tie="event_id", end="done", limit=3, keep=("tenant",))
    return a.select("event_id", F.col("tenant").alias("key"), "admitted")


@query("a2_concurrency_quota", replay_sql("tenant", "created + 600 * (1 + k)", 2))
def a2(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("done", F.col("created") + 600 * (1 + F.col("k")))
    a = ad.admit(r, key="tenant", time="created", tie="event_id", end="done", limit=2, keep=("tenant",))
    return a.select("event_id", F.col("tenant").alias("key"), "admitted")


@query("a5_local_limit", replay_sql("(queue_id || user_key)", "created + 900 * (1 + k)", 2, columns="event_id, key, case when admitted then 'CONTINUE' else 'REFUSE' end as classifying, case when admitted then 'CONTINUE' else 'WAIT' end as blocking").replace("from events))", "from events))", 1).replace("o as (select event_id", "q as (select *, tenant as user_key from req), o as (select event_id", 1).replace("as rn from req)", "as rn from q)", 1))
def a5(spark, sf_dir):
    r = requests(spark, sf_dir).withColumns({"done": F.col("created") + 900 * (1 + F.col("k")), "key": F.concat("queue_id", "tenant")})
    a = ad.admit(r, key="key", time="created", tie="event_id", end="done", limit=2, keep=("key",))
    return a.select("event_id", "key", F.when(F.col("admitted"), "CONTINUE").otherwise("REFUSE").alias("classifying"), F.when(F.col("admitted"), "CONTINUE").otherwise("WAIT").alias("blocking"))


@query("a3_classify_quota", replay_sql("tenant", "created + 86400", 3, columns="event_id, case when admitted then 'reserved' else 'overflow' end as class, case when admitted then 'CONTINUE' else 'REFUSE' end as blocking, 'CONTINUE' as classifying"))
def a3(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("done", F.col("created") + 86400)
    ok = F.col("admitted")
    a = ad.admit(r, key="tenant", time="created", tie="event_id", end="done", limit=3)
    return a.select("event_id", vd.quota_class(ok).alias("class"), vd.quota_verdict(ok, True).alias("blocking"), vd.quota_verdict(ok, False).alias("classifying"))


FREE = "list_filter(r.{0}, lambda x: x > o.created)"
ROOM_A, ROOM_B = f"len({FREE.format('la')}) < 3", f"len({FREE.format('lb')}) < 2"


CHAIN_SQL = f"""with recursive {REQ}, o as (select event_id, tenant as key, created, created + 86400 as day, created + 600 * (1 + k) as done, row_number() over (partition by tenant order by created, event_id) as rn from req),
r as (select key, rn, event_id, 'CONTINUE' as verdict, cast(null as int) as refused_by, [day] as la, [done] as lb from o where rn = 1
  union all select o.key, o.rn, o.event_id, case when {ROOM_A} and {ROOM_B} then 'CONTINUE' else 'REFUSE' end, case when not ({ROOM_A}) then 0 when not ({ROOM_B}) then 1 end,
    case when {ROOM_A} and {ROOM_B} then list_append({FREE.format('la')}, o.day) else {FREE.format('la')} end, case when {ROOM_A} and {ROOM_B} then list_append({FREE.format('lb')}, o.done) else {FREE.format('lb')} end
  from r join o on o.key = r.key and o.rn = r.rn + 1)
select event_id, verdict, refused_by from r"""


@query("a8_gate_chain", CHAIN_SQL)
def a8(spark, sf_dir):
    r = requests(spark, sf_dir).withColumns({"day": F.col("created") + 86400, "done": F.col("created") + 600 * (1 + F.col("k"))})
    a = ad.admit_chain(r, key="tenant", time="created", tie="event_id", ends=["day", "done"], limits=[3, 2])
    gates = [F.when(F.col("refused_by") == i, "REFUSE").otherwise("CONTINUE") for i in range(2)]
    return a.select("event_id", vd.gate_chain(gates).alias("verdict"), "refused_by")


BUDGET = threshold_sql("has", "v", 0.1, 0)
GATE = f"gate as (select pool, tick, (tick // 3600) % 13 = 0 as failed, case when {BUDGET} > 0 then 'CONTINUE' when (tick // 3600) % 3 = 0 then 'DROP' when (tick // 3600) % 3 = 1 then 'REFUSE' else 'WAIT' end as verdict from g)"


def gate_ticks(spark, sf_dir):
    """Evaluations of each pool's gate: an exhausted one drops, refuses or waits by the hour; some fail."""
    h = F.expr("tick div 3600")
    closed = F.when(h % 3 == 0, "DROP").when(h % 3 == 1, "REFUSE").otherwise("WAIT")
    open_ = b.threshold(F.col("has"), F.col("v"), 0.1, 0) > 0
    return ticks(spark, sf_dir).select(F.col("pool").alias("queue_id"), F.col("tick").alias("created"), F.when(open_, "CONTINUE").otherwise(closed).alias("verdict"), (h % 13 == 0).alias("failed"))


@query("a13_pool_gate_wait", sql(REQ, TICKS, GATE, """x as (select r.event_id, r.class, r.created, least(case when r.deadline + 7200 > 0 then r.deadline + 7200 end, r.created + 14400) as until, a.verdict as v0, a.failed as f0, b.tick, b.verdict as v1, b.failed as f1
  from req r asof left join gate a on r.queue_id = a.pool and r.created >= a.tick asof left join (select * from gate where failed or verdict <> 'WAIT') b on r.queue_id = b.pool and r.created <= b.tick),
y as (select *, coalesce(v0 = 'WAIT' and not f0, false) as waits, coalesce(tick < until, false) as in_time from x),
z as (select *, case when created >= until then 'DEADLINE_EXCEEDED' when waits then case when not in_time then 'DEADLINE_EXCEEDED' when f1 then 'GATE_ERROR' when v1 = 'DROP' then 'result' when v1 = 'REFUSE' then 'requeue' else 'dispatch' end
  when f0 then 'GATE_ERROR' when v0 = 'DROP' then 'result' when v0 = 'REFUSE' then 'requeue' else 'dispatch' end as outcome from y)""", body="""
select event_id, outcome, case when outcome = 'GATE_ERROR' then 'error' when outcome = 'result' then 'dropped' when outcome = 'requeue' or waits then case when class = 'overflow' then 'quota_exhausted' else 'gate_closed' end end as reason,
  case when outcome <> 'DEADLINE_EXCEEDED' then case when waits then tick else created end end as at from z"""))
def a13(spark, sf_dir):
    r = requests(spark, sf_dir).select("event_id", "queue_id", "created", "class", (F.col("deadline") + 7200).alias("until"))
    return ad.pool_gate(r, gate_ticks(spark, sf_dir), "queue_id", "created", "until", 14400).select("event_id", "outcome", "reason", "at")
