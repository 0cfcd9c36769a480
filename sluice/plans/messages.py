"""Queries over decoding, encoding and routing of messages (sources and sinks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.maps import as_text
from sluice.functions.scalars import request_token
from sluice.operators import messages as m
from sluice.plans.catalog import query
from sluice.sources import queues as store
from sluice.sources.tables import CFG, NOW, REQ, queues, read, requests, sql

KIND_SQL = "case event_id % 3 when 0 then 'plain' when 1 then 'redis' else 'pubsub' end"
ENV = f"""env as (select *, case event_id % 7 when 0 then 'null' when 1 then '{{"internal":{{}},"request_kind":"soap","data":{{"id":"' || id || '"}}}}' when 2 then '{{"internal":{{}},"data":{{"id":"' || id || '"}}}}'
  when 3 then '{{"internal":{{}},"request_kind":"plain","data":{{"id":' || event_id || ',"created":1,"deadline":2}}}}'
  else '{{"internal":{{"retry_count":' || retry_count || ',"queue_id":"' || queue_id || '","request_token":"' || token || '"}},"request_kind":"' || {KIND_SQL} || '","data":{{"id":"' || id || '","created":' || created || ',"deadline":' || deadline || ',"metadata":{{"userid":"' || tenant || '"}}}}}}' end as msg from req)"""


def envelopes(spark, sf_dir):
    """Envelope texts, one per request: four in seven are good."""
    kind = KIND_SQL
    good = f"""concat('{{"internal":{{"retry_count":', retry_count, ',"queue_id":"', queue_id, '","request_token":"', token, '"}},"request_kind":"', {kind}, '","data":{{"id":"', id, '","created":', created, ',"deadline":', deadline, ',"metadata":{{"userid":"', tenant, '"}}}}}}')"""
    return requests(spark, sf_dir).withColumn("value", F.expr(f"""case event_id % 7 when 0 then 'null' when 1 then concat('{{"internal":{{}},"request_kind":"soap","data":{{"id":"', id, '"}}}}')
      when 2 then concat('{{"internal":{{}},"data":{{"id":"', id, '"}}}}') when 3 then concat('{{"internal":{{}},"request_kind":"plain","data":{{"id":', event_id, ',"created":1,"deadline":2}}}}') else {good} end"""))


@query("s1_decode_envelope", sql(REQ, ENV, body="""
select event_id, nullif(json_extract_string(msg, '$.request_kind'), '') as kind, case when msg = 'null' then 'empty' when json_extract_string(msg, '$.request_kind') is null then 'missing kind'
  when json_extract_string(msg, '$.request_kind') not in ('plain', 'redis', 'pubsub') then 'unknown kind' when json_type(msg, '$.data.id') <> 'VARCHAR' then 'wrong type' end as reject,
  case when event_id % 7 > 3 then json_extract_string(msg, '$.data.id') end as id, case when event_id % 7 > 3 then cast(json_extract_string(msg, '$.data.created') as bigint) end as created,
  case when event_id % 7 > 3 then cast(json_extract_string(msg, '$.data.deadline') as bigint) end as deadline, json_extract_string(msg, '$.internal.queue_id') as queue_id,
  json_extract_string(msg, '$.internal.request_token') as token, cast(json_extract_string(msg, '$.internal.retry_count') as int) as retry_count from env"""))
def s1(spark, sf_dir):
    d = m.decode_envelope(envelopes(spark, sf_dir).select("event_id", "value"))
    return d.select("event_id", "kind", "reject", "req.id", F.col("req.created").cast("long").alias("created"), F.col("req.deadline").cast("long").alias("deadline"), "routing.queue_id", F.col("routing.request_token").alias("token"), F.col("routing.retry_count").cast("int").alias("retry_count"))


@query("s2_encode_envelope", sql(REQ, body="""
select event_id, '{"internal":{' || case when retry_count > 0 then '"retry_count":' || retry_count || ',' else '' end || '"queue_id":"' || queue_id || '"' || case when class <> '' then ',"labels":{"classification":"' || class || '"}' else '' end || '},"request_kind":"plain","data":{"id":"' || id || '","created":' || created || ',"deadline":' || deadline || '}}' as value from req"""))
def s2(spark, sf_dir):
    r = requests(spark, sf_dir)
    value = m.encode_envelope(F.lit("plain"), {"id": F.col("id"), "created": F.col("created"), "deadline": F.col("deadline")}, {"retry_count": F.col("retry_count"), "queue_id": F.col("queue_id"), "labels": m.classify(F.create_map().cast("map<string,string>"), F.col("class"))})
    return r.select("event_id", value.alias("value"))


@query("s3_read_pending", sql(REQ, body="select queue_id, id, deadline, cast(deadline as double) as score from req"))
def s3(spark, sf_dir):
    path = store.shared_dir(spark, "pending")
    store.append_requests(requests(spark, sf_dir).withColumns({"request_queue": F.col("queue_id"), "reject": F.lit(None).cast("string")}), path)
    return store.pending(spark, path).select(F.col("request_queue").alias("queue_id"), "id", "deadline", "score")


@query("s4_read_channel", sql(REQ, CFG, body="""
select event_id, req.queue_id as request_queue_name, 'class=' || class || case when team <> '' then ';team=' || team else '' end || ';tenant=' || case when tenant_label <> '' then tenant_label else tenant end as labels from req join cfg using (queue_id)"""))
def s4(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("message", F.create_map(F.lit("tenant"), F.col("tenant"), F.lit("class"), F.col("class")))
    j = r.join(queues(spark), "queue_id").withColumnsRenamed({"labels": "channel", "message": "labels"})
    return m.read_channel(j, F.col("queue_id"), F.col("channel")).select("event_id", "request_queue_name", as_text(F.col("labels")).alias("labels"))


def topic(r):
    """Requests as topic messages; every ninth body is malformed."""
    data = F.expr("""case when event_id % 9 = 0 then '{bad' else concat('{"id":"', id, '","created":', created, ',"deadline":', deadline, ',"metadata":{"userid":"', tenant, '","src":"body"}}') end""")
    return r.select(F.col("event_id").alias("msg_id"), data.alias("data"), F.create_map(F.lit("src"), F.lit("attr"), F.lit("n"), F.col("event_id").cast("string")).alias("attributes"), F.nullif(F.col("event_id") % 4, F.lit(0)).alias("delivery_attempt"))


@query("s5_read_topic", sql(REQ, body="""
select event_id as msg_id, id, created, deadline, 'n=' || event_id || ';src=attr;userid=' || tenant as metadata, cast(case when event_id % 4 = 0 then 0 else event_id % 4 - 1 end as int) as retry_count from req where event_id % 9 <> 0"""))
def s5(spark, sf_dir):
    return m.read_topic(topic(requests(spark, sf_dir))).withColumn("metadata", as_text(F.col("metadata")))


@query("s6_submit", sql(REQ, body=f"""
select event_id, case when event_id % 11 = 0 then 'id required' when event_id % 13 = 0 then 'deadline required' when deadline < {NOW} then 'deadline past' end as reject,
  case when event_id % 2 = 0 then 'requests' else queue_id end as request_queue, 'results' as result_queue, md5(id || '|' || created || '|s') as token from req"""))
def s6(spark, sf_dir):
    r = requests(spark, sf_dir).withColumns({"true_id": F.col("id"), "id": F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("id")), "deadline": F.when((F.col("event_id") % 13 == 0), 0).otherwise(F.col("deadline")), "request_queue": F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("queue_id")), "result_queue": F.lit("")})
    out = m.submit(r, NOW, "requests", "results")
    return out.select("event_id", "reject", "request_queue", "result_queue", request_token(F.col("true_id"), F.col("created"), "s").alias("token"))


@query("s7_normalize_kind", sql(REQ, body=f"""
select event_id, {KIND_SQL} as kind, case when {KIND_SQL} = 'redis' and event_id % 2 = 0 then 'own-queue' else queue_id end as request_queue, case when {KIND_SQL} = 'redis' and event_id % 4 = 0 then 'own-results' else 'results' end as result_queue,
  case when {KIND_SQL} = 'pubsub' then 'msg-' || event_id end as correlation from req"""))
def s7(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("kind", F.expr(KIND_SQL))
    message = {"request_queue_name": F.when(F.col("event_id") % 2 == 0, "own-queue").otherwise(""), "result_queue_name": F.when(F.col("event_id") % 4 == 0, "own-results"), "pubsub_id": F.concat(F.lit("msg-"), "event_id")}
    n = m.normalize_kind(F.col("kind"), message, {"request_queue_name": F.col("queue_id"), "result_queue_name": F.lit("results"), "transport_correlation_id": F.lit(None).cast("string")})
    return r.select("event_id", "kind", n["request_queue_name"].alias("request_queue"), n["result_queue_name"].alias("result_queue"), n["transport_correlation_id"].alias("correlation"))


ROUTED = "coalesce(nullif(result_queue, ''), case when event_id % 2 = 0 then 'own-results' end, 'results')"


@query("s8_write_results", sql(REQ, CFG, body=f"select {ROUTED} as result_queue, count(*) as n, sum(event_id)::bigint as ids, min(created) as first_at from req left join cfg using (queue_id) group by 1"))
def s8(spark, sf_dir):
    j = requests(spark, sf_dir).join(queues(spark), "queue_id", "left")
    routed = j.withColumn("result_queue", m.result_queue(F.col("result_queue"), F.when(F.col("event_id") % 2 == 0, "own-results"), "results"))
    path = store.shared_dir(spark, "results")
    store.append_results(routed.select("result_queue", "id", "event_id", "created"), path, time="created", flush_rows=100_000, parts_per_queue=int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = spark.read.schema("id string, event_id long, created long, result_queue string").json(path)
    return written.groupBy("result_queue").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.min("created").alias("first_at"))


@query("s9_marshal_result", sql(REQ, body="""
select event_id, '{"id":"' || id || '"' || case when status > 0 then ',"status_code":' || status else '' end || ',"payload":"p' || k || '"' || case when status = 0 then ',"error_code":"INFERENCE_ERROR","error_message":"no response"' else '' end || '}' as value from req"""))
def s9(spark, sf_dir):
    r = requests(spark, sf_dir)
    failed = F.col("status") == 0
    value = m.marshal_result(F.col("id"), F.col("status"), F.concat(F.lit("p"), "k"), F.when(failed, "INFERENCE_ERROR"), F.when(failed, "no response"))
    return r.select("event_id", value.alias("value"))


@query("s10_read_results", sql(REQ, body="""
select event_id, case when event_id % 8 = 0 then null else id end as id, case when event_id % 8 = 0 then null else status end as status_code, event_id % 8 = 0 as reject from req"""))
def s10(spark, sf_dir):
    value = F.expr("""case when event_id % 16 = 0 then '{"status_code":200' when event_id % 8 = 0 then '{"id":"","payload":""}' else concat('{"id":"', id, '","status_code":', status, '}') end""")
    p = m.parse_result(requests(spark, sf_dir).select("event_id", value.alias("value")), "value")
    return p.select("event_id", m.blank_to_null("id").alias("id"), "status_code", "reject")


@query("s11_parse_exposition", sql(REQ, body="""
select 'f' || event_id % 50 as file, case event_id % 4 when 0 then 'queue_size' when 1 then 'pods_ready' else 'plain' end as metric, 'n=' || event_id || ';pool=' || queue_id as labels, round(value, 6) as value from req where event_id % 4 <> 3"""))
def s11(spark, sf_dir):
    e = requests(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), F.col("event_id") % 50))
    name = F.expr("case event_id % 4 when 0 then 'queue_size' when 1 then 'pods_ready' when 2 then 'plain' else 'lat_bucket' end")
    line = F.concat(name, F.lit('{pool="'), "queue_id", F.lit('",n="'), F.col("event_id").cast("string"), F.lit('"} '), F.col("value").cast("string"))
    heads = e.select("file").distinct().select("file", F.explode(F.array(F.lit("# TYPE queue_size gauge"), F.lit("# TYPE pods_ready counter"), F.lit("# TYPE lat histogram"), F.lit("# HELP lat how long"), F.lit(""))).alias("line"))
    found = m.parse_exposition(e.select("file", line.alias("line")).unionByName(heads))
    return found.select("file", "metric", as_text(F.col("labels")).alias("labels"), F.round("value", 6).alias("value"))


@query("s12_load_dim_config", """
select 'pool-' || s_suppkey // 2 as id, case when s_suppkey % 5 = 0 then 64 else cast(s_suppkey % 5 as int) end as workers, case when s_suppkey % 3 = 0 then 'constant' else 'redis' end as gate_type,
  count(*) over (partition by s_suppkey // 2) > 1 as duplicate_id, s_suppkey % 7 = 0 as missing_url from supplier""")
def s12(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    text = F.expr("""concat('{"id":"pool-', s_suppkey div 2, '"', case when s_suppkey % 5 = 0 then '' else concat(',"workers":', s_suppkey % 5) end, case when s_suppkey % 3 = 0 then '' else ',"gate_type":"redis"' end, case when s_suppkey % 7 = 0 then '' else ',"base":"http://x"' end, '}')""")
    path = store.shared_dir(spark, "config")
    files = s.groupBy(F.col("s_suppkey") % 4).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit("]")).alias("value"))  # four configuration files
    files.select("value").repartition(4).write.option("maxRecordsPerFile", 1).text(path)
    c = store.load_config(spark, path, "id string, workers int, gate_type string, base string", required=("base",), defaults={"workers": 64, "gate_type": "constant"}, fail=False)
    return c.select("id", "workers", "gate_type", (F.col("problem") == "id given twice").alias("duplicate_id"), m.blank_to_null("base").isNull().alias("missing_url")).withColumn("duplicate_id", F.coalesce("duplicate_id", F.lit(False)))


@query("s13_queue_depths", sql(REQ, body=f"select queue_id, count(*) filter (where deadline >= {NOW}) as pending, count(*) filter (where deadline < {NOW}) as unread from req group by 1"))
def s13(spark, sf_dir):
    return requests(spark, sf_dir).groupBy("queue_id").agg(F.count_if(F.col("deadline") >= NOW).alias("pending"), F.count_if(F.col("deadline") < NOW).alias("unread"))
