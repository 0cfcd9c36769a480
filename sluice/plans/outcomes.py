"""Queries over attempt outcomes, retries and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import scalars as sc
from sluice.functions.maps import as_text, overlay
from sluice.operators import outcome as oc
from sluice.operators import transforms as tr
from sluice.plans.catalog import query
from sluice.operators import lookups as lk
from sluice.operators import requests as rq
from sluice.sources.tables import CFG, NOW, POOL, POOLS, REQ, queues, read, requests, sql

CAT = "case when status = 0 then 'UNKNOWN' when event_id % 41 = 5 then 'SERVER_ERROR' when status = 429 then 'RATE_LIMIT' when status between 400 and 499 then 'INVALID_REQ' when status >= 500 then 'SERVER_ERROR' end"
C = f"c as (select *, {CAT} as category, created + 60 * (1 + k % 10) - (created + k * 5) as seconds_left from req)"


def attempts(spark, sf_dir):
    r = requests(spark, sf_dir)
    c = oc.classify_http(F.col("status"), F.col("status") == 0, F.col("event_id") % 41 == 5)
    return r.withColumns({"category": c, "seconds_left": F.col("deadline") - (F.col("created") + F.col("k") * 5)})


@query("o1_classify_http", sql(REQ, C, body="select event_id, status, category from c"))
def o1(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", "status", "category")


@query("o2_fatal_sheddable", sql(REQ, C, body="select event_id, category is not null and category not in ('RATE_LIMIT', 'SERVER_ERROR') as fatal, coalesce(category = 'RATE_LIMIT', false) as sheddable from c"))
def o2(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", oc.fatal(F.col("category")).alias("fatal"), oc.sheddable(F.col("category")).alias("sheddable"))


OUT = "case when category is null then 'result' when category in ('RATE_LIMIT', 'SERVER_ERROR') then 'retry' when status > 0 then 'result' else 'error' end"


@query("o3_attempt_outcome", sql(REQ, C, body=f"select event_id, {OUT} as outcome, category = 'RATE_LIMIT' and category is not null as shed from c"))
def o3(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", oc.attempt_outcome(F.col("category"), F.col("status")).alias("outcome"), oc.sheddable(F.col("category")).alias("shed"))


def retry_after_text():
    date = F.concat(F.lit("Tue, "), F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"), F.lit(" Jan 2024 00:00:30 GMT"))
    dashed = F.concat(F.lit("Tuesday, "), F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"), F.lit("-Jan-24 00:00:30 GMT"))
    plain = F.concat(F.lit("Tue Jan "), F.lpad((F.col("k") % 28 + 1).cast("string"), 2, " "), F.lit(" 00:00:30 2024"))
    return F.when(F.col("event_id") % 5 == 0, F.col("k").cast("string")).when(F.col("event_id") % 5 == 1, "-5").when(F.col("event_id") % 5 == 2, plain).when(F.col("event_id") % 5 == 3, dashed).otherwise(date)


HINT = f"case when status = 429 or status >= 500 or event_id % 41 = 5 then case when event_id % 5 = 0 then k when event_id % 5 > 1 then greatest(0, 1704067200 + (k % 28) * 86400 + 30 - {NOW}) end end"


@query("o4_parse_retry_after", sql(REQ, C, body=f"select event_id, cast({HINT} as bigint) as hint from c"))
def o4(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", oc.parse_retry_after(retry_after_text(), NOW, F.col("status"), F.col("event_id") % 41 == 5).alias("hint"))


CEIL = "greatest(0.0::double, least(60.0::double, seconds_left::double, 2 * pow(2.0::double, retry_count + 1)))"
WAIT = f"({CEIL} / 2 + {CEIL} / 2 * {sc.JITTER_SQL.format(key='id', salt='retry_count')})"


@query("o5_backoff", sql(REQ, C, body=f"select event_id, round({WAIT}, 6) as wait from c"))
def o5(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", F.round(oc.backoff(F.col("seconds_left"), F.col("retry_count"), F.col("id")), 6).alias("wait"))


CLAMP = f"case when k > {WAIT} then greatest({WAIT}, least(k::double, seconds_left / 2.0::double) * (1 + {sc.JITTER_SQL.format(key='(id || chr(35))', salt='retry_count')} / 4)) else {WAIT} end"


@query("o6_retry_after_clamp", sql(REQ, C, body=f"select event_id, round({CLAMP}, 6) as wait from c"))
def o6(spark, sf_dir):
    a = attempts(spark, sf_dir)
    wait = oc.backoff(F.col("seconds_left"), F.col("retry_count"), F.col("id"))
    return a.select("event_id", F.round(oc.with_retry_after(wait, F.col("k"), F.col("seconds_left"), F.col("id"), F.col("retry_count")), 6).alias("wait"))


@query("o7_retry_or_exhaust", sql(REQ, C, body=f"select event_id, case when {OUT} <> 'retry' then {OUT} when seconds_left > 0 then 'retry' when status > 0 then 'result' else 'DEADLINE_EXCEEDED' end as next, cast(case when {OUT} = 'retry' and seconds_left > 0 then retry_count + 1 end as int) as retry_count from c"))
def o7(spark, sf_dir):
    a = attempts(spark, sf_dir)
    nxt = oc.retry_or_exhaust(oc.attempt_outcome(F.col("category"), F.col("status")), F.col("seconds_left"), F.col("status"))
    return a.select("event_id", nxt.alias("next"), F.when(nxt == "retry", F.col("retry_count") + 1).cast("int").alias("retry_count"))


@query("o8_retry_due_time", sql(REQ, C, body=f"select event_id, round(created + {WAIT}, 3) as due_at from c"))
def o8(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", F.round(F.col("created") + oc.backoff(F.col("seconds_left"), F.col("retry_count"), F.col("id")), 3).alias("due_at"))


@query("o9_error_result", sql(REQ, body="""select event_id, '{"id":"' || id || '","payload":"{\\"error\\":\\"lost ' || k || '\\"}","error_code":"INFERENCE_ERROR","error_message":"lost ' || k || '"}' as value from req where status = 0"""))
def o9(spark, sf_dir):
    r = requests(spark, sf_dir).where("status = 0")
    return r.select("event_id", oc.error_result(F.col("id"), F.lit("INFERENCE_ERROR"), F.concat(F.lit("lost "), "k")).alias("value"))


@query("o10_cancelled_result", sql(REQ, body="select event_id, case when event_id % 17 = 0 then 'CANCELLED' when event_id % 29 = 0 then 'requeue' end as outcome, case when event_id % 17 <> 0 and event_id % 29 = 0 then created + 1 end as due_at from req"))
def o10(spark, sf_dir):
    r = requests(spark, sf_dir)
    marks = r.where("event_id % 17 = 0").select("id", "token")
    return rq.cancelled_outcome(r, marks, F.col("event_id") % 29 == 0, F.col("created")).select("event_id", "outcome", "due_at")


@query("o11_dropped_reason", sql(REQ, body=f"select event_id, {CAT} || ': status ' || status || case when event_id % 2 = 0 then ' (dropped: ' || queue_id || '-full)' else '' end || case when event_id % 3 = 0 then ' (caused by: EOF)' else '' end as error_message from req where status >= 400"))
def o11(spark, sf_dir):
    r = attempts(spark, sf_dir).where("status >= 400")
    headers = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x-dropped-reason"), F.concat("queue_id", F.lit("-full")))).otherwise(F.create_map().cast("map<string,string>"))
    reason = F.try_element_at(headers, F.lit("x-dropped-reason"))
    cause = F.when(F.col("event_id") % 3 == 0, "EOF")
    return r.select("event_id", oc.error_text(F.col("category"), F.concat(F.lit("status "), "status"), reason, cause).alias("error_message"))


def echo_client(frames):
    """Stand-in for an HTTP client: answers every request with 200 and the length of its id."""
    for f in frames:
        yield f.assign(status=200, body=f["id"].str.len().astype("int64"))[["event_id", "status", "body"]]


@query("o12_dispatch", sql(REQ, CFG, POOL, body=f"""
select event_id, 200::bigint as status, length(id) as body from req join cfg using (queue_id) where pool = 'pool-a' and deadline > {NOW}"""))
def o12(spark, sf_dir):
    workers = next(p[1] for p in POOLS if p[0] == "pool-a")
    r = lk.join_queue_config(requests(spark, sf_dir), queues(spark)).where("pool = 'pool-a'")
    return oc.dispatch(r.select("event_id", "id", "deadline"), workers, echo_client, "event_id long, status long, body long", deadline="deadline", now=NOW)


@query("o13_topic_redelivery", sql(REQ, body="select event_id, case event_id % 3 when 0 then created + 10 when 1 then created end as due_at, case when event_id % 3 < 2 then retry_count + 1 end as delivery_attempt from req"))
def o13(spark, sf_dir):
    m = F.col("event_id") % 3
    due, attempt = oc.redelivery(F.when(m == 0, "refused").when(m == 1, "retry").otherwise("done"), F.col("created"), F.col("retry_count"))
    return requests(spark, sf_dir).select("event_id", due.alias("due_at"), attempt.cast("int").alias("delivery_attempt"))


# Scalar and JSON functions.
@query("f1_payload_to_json", """select conv_id, cast(max(turn) as bigint) as last_turn, '{"model":"m","n":' || count(*) || ',"roles":["' || string_agg(role, '","' order by turn, role) || '"]}' as body from conversations where role is not null group by 1""")
def f1(spark, sf_dir):
    return rq.conversation_body(read(spark, sf_dir, "conversations"), "m")


SIGNED = """s as (select page_id, url || case when position('?' in url) > 0 then '&' else '?' end || case page_id % 5 when 0 then 'X-Goog-Date=20260618T110000Z&X-Goog-Expires=' || page_id when 1 then 'Expires=' || (1780000000 + page_id)
  when 2 then 'X-Goog-Date=bad&X-Goog-Expires=10&Expires=5' when 3 then 'X-Goog-Date=20260618T110000Z&X-Goog-Expires=x' else 'a=b' end as signed, case page_id % 5 when 0 then 1781780400 + page_id when 1 then 1780000000 + page_id end as expiry from (select page_id, replace(url, '#', '?x') as url from pages))"""


def signed(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("#"), F.lit("?x")).alias("url"))
    tail = F.expr("case page_id % 5 when 0 then concat('X-Goog-Date=20260618T110000Z&X-Goog-Expires=', page_id) when 1 then concat('Expires=', 1780000000 + page_id) when 2 then 'X-Goog-Date=bad&X-Goog-Expires=10&Expires=5' when 3 then 'X-Goog-Date=20260618T110000Z&X-Goog-Expires=x' else 'a=b' end")
    return p.withColumn("signed", F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), tail))


@query("f2_signed_url_expiry", sql(SIGNED, body="select page_id, cast(expiry as bigint) as expiry from s"))
def f2(spark, sf_dir):
    return signed(spark, sf_dir).select("page_id", sc.signed_url_expiry(F.col("signed")).alias("expiry"))


@query("f3_preflight_expiry", sql(SIGNED, body="select page_id, expiry is not null and expiry <= 1780000500 and page_id % 4 <> 0 as fatal from s"))
def f3(spark, sf_dir):
    s = signed(spark, sf_dir)
    return s.select("page_id", tr.preflight(F.when(F.col("page_id") % 4 != 0, F.col("signed")), F.lit(1780000500)).alias("fatal"))


@query("f4_form_fields", sql(REQ, body="select event_id, event_id % 6 = 0 as reject, case when event_id % 6 <> 0 then 'n=' || k || ';ok=true;url=gs://b/' || id end as fields from req"))
def f4(spark, sf_dir):
    payload = F.expr("""concat('{"gcs_uri":"gs://b/', id, '","n":', k, ',"ok":true', if(event_id % 6 = 0, ',"file_base64":"xx"', ',"file_base64":""'), '}')""")
    fields, reject = tr.form_fields(payload)
    return requests(spark, sf_dir).select("event_id", reject.alias("reject"), as_text(fields).alias("fields"))


@query("f5_transform_chain", sql(REQ, body="select event_id, case when event_id % 4 = 0 then 'first:' || id when event_id % 6 = 0 then 'second' else id end as body from req"))
def f5(spark, sf_dir):
    r = requests(spark, sf_dir)
    tr.register_transform("first", lambda body, row: F.when(row["event_id"] % 4 == 0, F.concat(F.lit("first:"), body)))
    tr.register_transform("second", lambda body, row: F.when(row["event_id"] % 6 == 0, F.lit("second")))
    return r.select("event_id", tr.chain(["first", "second"], F.col("id"), {"event_id": F.col("event_id")}).alias("body"))


@query("f6_normalize_path", sql(REQ, body="select event_id, case event_id % 3 when 0 then '/' when 1 then '/' || queue_id else '/x/' || queue_id end as path from req"))
def f6(spark, sf_dir):
    p = F.expr("case event_id % 3 when 0 then '' when 1 then queue_id else concat('/x/', queue_id) end")
    return requests(spark, sf_dir).select("event_id", sc.normalize_path(p).alias("path"))


@query("f7_normalize_base", sql(REQ, body="select event_id, case event_id % 3 when 0 then '' else 'http://' || queue_id end as base from req"))
def f7(spark, sf_dir):
    b = F.expr("case event_id % 3 when 0 then '///' when 1 then concat('http://', queue_id, '//') else concat('http://', queue_id) end")
    return requests(spark, sf_dir).select("event_id", sc.normalize_base(b).alias("base"))


@query("f8_clamp", sql(REQ, body="select event_id, case when event_id % 7 <> 0 then least(50.0::double, greatest(5.0::double, value)) end as v from req"))
def f8(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    return requests(spark, sf_dir).select("event_id", sc.clamp(v, 5, 50).alias("v"))


@query("f9_typed_param", sql(REQ, body="select event_id, case when event_id % 4 = 3 then 1.5::double else k::double end as v from req"))
def f9(spark, sf_dir):
    text = F.expr("""case event_id % 4 when 0 then cast(k as string) when 1 then concat('"', k, '"') when 2 then concat('{"value":', k, '}') else 'none' end""")
    return requests(spark, sf_dir).select("event_id", tr.typed_number(text, 1.5).alias("v"))


@query("f10_request_token", sql(REQ, body="select event_id, md5(id || '|' || created || '|seed') as token from req"))
def f10(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", sc.request_token(F.col("id"), F.col("created"), "seed").alias("token"))


@query("f11_trace_parent", sql(REQ, body="select event_id, case when event_id % 3 <> 0 then token end as trace_id, case when event_id % 3 <> 0 then substr(token, 1, 16) end as span_id, case when event_id % 3 <> 0 then '01' end as flags from req"))
def f11(spark, sf_dir):
    metadata = overlay(F.create_map(F.lit("a"), F.lit("b")), F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("traceparent"), F.concat(F.lit("00-"), "token", F.lit("-"), F.substring("token", 1, 16), F.lit("-01")))))
    trace, span, flags = rq.trace_parent(metadata)
    return requests(spark, sf_dir).select("event_id", trace.alias("trace_id"), span.alias("span_id"), flags.alias("flags"))


@query("f12_selector_text", sql(REQ, body="""select event_id, 'm{class="' || class || '",queue="' || queue_id || '",tier="' || tier || '"}' as selector from req"""))
def f12(spark, sf_dir):
    labels = F.create_map(F.lit("tier"), F.col("tier"), F.lit("class"), F.col("class"), F.lit("queue"), F.col("queue_id"))
    return requests(spark, sf_dir).select("event_id", tr.selector("m", labels).alias("selector"))
