"""Streaming queries: the event table as a stream of files, run until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.maps import as_text
from sluice.operators import messages as m
from sluice.operators import ordering as o
from sluice.plans import catalog
from sluice.plans.admission import CHAIN_SQL, replay_sql
from sluice.plans.catalog import query
from sluice.plans.messages import topic
from sluice.sources.tables import NOW, REQ, queues, requests, sql
from sluice.streaming import processors as pr
from sluice.streaming import rounds as rd
from sluice.streaming import stateful as st


class _Streaming:
    """A session whose `read.parquet` opens a stream, so that batch inputs serve streams unchanged."""

    def __init__(self, spark):
        self.spark, self.read = spark, self

    def parquet(self, path):
        parent, _, name = path.rpartition("/")
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{parent}/{name[:-1]}[{name[-1]}]")


def stream(spark, sf_dir):
    return requests(_Streaming(spark), sf_dir)


@query("t1_stream_rate_limit", replay_sql("tenant", "created + 86400", 3, columns="event_id, admitted"))
def t1(spark, sf_dir):
    return st.run_available(pr.rate_limit(stream(spark, sf_dir), "tenant", 86400, 3), "t1")


@query("t2_stream_concurrency", replay_sql("tenant", "created + 600 * (1 + k)", 2, columns="event_id, admitted"))
def t2(spark, sf_dir):
    ends = F.explode(F.array(F.struct(F.col("created").alias("at"), F.lit(False).alias("is_release")), F.struct((F.col("created") + 600 * (1 + F.col("k"))).alias("at"), F.lit(True).alias("is_release"))))
    events = stream(spark, sf_dir).select("tenant", "event_id", ends.alias("e")).select("tenant", "event_id", "e.*")
    return st.run_available(pr.concurrency(events, "tenant", 2, 7 * 86400), "t2")


@query("s4_stream_channel", catalog.ORACLE["s4_read_channel"])
def s4_stream(spark, sf_dir):
    r = stream(spark, sf_dir).withColumn("labels", F.create_map(F.lit("tenant"), F.col("tenant"), F.lit("class"), F.col("class")))
    r = r.join(F.broadcast(queues(spark).select("queue_id", F.col("labels").alias("channel"))), "queue_id")  # configuration
    out = m.read_channel(r, F.col("queue_id"), F.col("channel")).select("event_id", "request_queue_name", as_text(F.col("labels")).alias("labels"))
    return st.run_available(out, "s4")


@query("s5_stream_topic", f"""select msg_id, id, metadata, retry_count, null as reject from ({catalog.ORACLE["s5_read_topic"]}) union all
select event_id, null, null, null, 'not JSON' from events where event_id % 9 = 0""")
def s5_stream(spark, sf_dir):
    out = rd.run_tables(topic(stream(spark, sf_dir)), {"accepted": m.read_topic, "rejected": m.malformed_topic}, label="s5")
    accepted = out["accepted"].select("msg_id", "id", as_text(F.col("metadata")).alias("metadata"), "retry_count")
    return accepted.unionByName(out["rejected"].select("msg_id", "reject"), allowMissingColumns=True)


@query("a8_stream_chain", f"select event_id, refused_by from ({CHAIN_SQL})")
def a8_stream(spark, sf_dir):
    ends = F.array(F.col("created") + 86400, F.col("created") + 600 * (1 + F.col("k")))
    rows = stream(spark, sf_dir).select("tenant", "event_id", F.col("created").alias("at"), F.lit(False).alias("is_release"), ends.alias("ends"))
    return st.run_available(pr.chained_quotas(rows, "tenant", [3, 2], 7 * 86400), "a8s")


@query("w7_stream_dedupe", sql(REQ, body="select distinct id, token, retry_count from req"))
def w7_stream(spark, sf_dir):
    r = stream(spark, sf_dir)
    again = F.explode(F.when(F.col("retry_count") > 1, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1))))
    return st.run_available(st.dedupe(r.select("id", "token", "retry_count", again.alias("copy")), ["id", "token", "retry_count"]).drop("copy"), "w7")


@query("t3_stream_retry_timer", sql(REQ, body="select event_id, created + k as due_at from req where retry_count > 0"))
def t3(spark, sf_dir):
    r = stream(spark, sf_dir).where("retry_count > 0").withColumn("due_at", F.col("created") + F.col("k"))
    return st.run_available(pr.hold_until_due(r.select("queue_id", "event_id", "due_at"), "queue_id"), "t3").select("event_id", "due_at")


@query("t4_stream_deadline_expiry", sql(REQ, body="select event_id, deadline as due_at, 'DEADLINE_EXCEEDED' as error_code from req"))
def t4(spark, sf_dir):
    r = stream(spark, sf_dir).withColumn("due_at", F.col("deadline"))
    out = st.run_available(pr.hold_until_due(r.select("tenant", "event_id", "due_at"), "tenant"), "t4")
    return out.select("event_id", "due_at").withColumn("error_code", F.lit("DEADLINE_EXCEEDED"))


@query("t5_stream_cancellation", sql(REQ, body="select event_id, event_id % 17 = 0 as cancelled from req"))
def t5(spark, sf_dir):
    r = stream(spark, sf_dir).select("id", "token", "created", "event_id")
    kinds = F.explode(F.when(F.col("event_id") % 17 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    return st.run_available(pr.cancellation(r.withColumn("is_cancel", kinds)), "t5")


@query("t6_poll_round", sql(REQ, body=f"""
select queue_id, id, deadline, cast(rn - 10 * ((rn - 1) // 10) as int) as rn, cast((rn - 1) // 10 as int) as round from (
  select *, row_number() over (partition by queue_id order by deadline, id) as rn from req where deadline >= {NOW}) where rn <= 20"""))
def t6(spark, sf_dir):
    def pop(waiting):
        budgets = waiting.groupBy("queue_id").agg(F.lit(1.0).alias("budget"))
        return o.edf_topk(waiting, budgets, 10)

    waiting = stream(spark, sf_dir).where(F.col("deadline") >= NOW).select("event_id", "queue_id", "id", "deadline")
    popped, _, _ = rd.poll_rounds(waiting, pop, "t6", most=10, more_rounds=1, width=86400)
    return popped.select("queue_id", "id", "deadline", "rn", "round")


@query("t7_result_stream", sql(REQ, body="select id, status as status_code, queue_id as result_queue from req"))
def t7(spark, sf_dir):
    results = stream(spark, sf_dir).select("id", F.col("status").alias("status_code"), F.col("queue_id").alias("result_queue"), "created")
    return rd.run_results(results, order=["created", "id"], label="t7", flush_rows=10_000).select("id", "status_code", "result_queue")


@query("t8_stream_metrics", sql(REQ, body="""
select queue_id, created - created % 3600 as start, count(*) as n, round(sum(value), 4) as total, count(*) filter (where value <= 10) || ',' || count(*) filter (where value <= 50) || ',' || count(*) filter (where value <= 100) as buckets
from req group by 1, 2 having created - created % 3600 + 3600 <= (select max(created) from req) - 600"""))
def t8(spark, sf_dir):
    w = st.run_available(st.windowed_counts(stream(spark, sf_dir).select("queue_id", "created", "value"), ["queue_id"], "1 hour", bounds=(10, 50, 100)), "t8")
    return w.select("queue_id", F.unix_seconds("window.start").alias("start"), "n", F.round("total", 4).alias("total"), F.concat_ws(",", F.transform("buckets", lambda b: b.cast("string"))).alias("buckets"))


@query("t8_stream_rates", sql(REQ, body="""
select queue_id, start, count(*) / 7200.0::double as rate from (select queue_id, unnest([created - created % 3600, created - created % 3600 - 3600]) as start from req)
group by 1, 2 having start + 7200 <= (select max(created) from req) - 600"""))
def t8_rates(spark, sf_dir):
    w = st.run_available(st.windowed_counts(stream(spark, sf_dir).select("queue_id", "created", "value"), ["queue_id"], "2 hours", "1 hour"), "t8r")
    return w.select("queue_id", F.unix_seconds("window.start").alias("start"), (F.col("n") / F.lit(7200.0)).alias("rate"))


@query("t9_late_data", sql(REQ, body=f"select event_id, deadline, deadline >= {NOW} as in_time, sum(case when deadline < {NOW} then 1 else 0 end) over () ::bigint as expired from req"))
def t9(spark, sf_dir):
    rows = stream(spark, sf_dir).select("event_id", "deadline", (F.col("deadline") >= NOW).alias("in_time"))
    out, seen = st.run_observed(rows, "t9", {"expired": ~F.col("in_time")})
    return out.withColumn("expired", F.lit(seen["expired"]).cast("long"))


@query("j9_stream_match", sql(REQ, body="select id, status, k * 5 as latency from req"))
def j9_stream(spark, sf_dir):
    results = stream(spark, sf_dir).select(F.col("id").alias("request_id"), (F.col("created") + F.col("k") * 5).alias("finished"), "status")
    return st.run_available(st.match_results(stream(spark, sf_dir).select("id", "created"), results), "j9", prompt=True).select("id", "status", "latency")
