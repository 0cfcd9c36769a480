"""Decoding, encoding and routing of queued messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.maps import blank_to_null, overlay, without

KINDS = ("plain", "redis", "pubsub")
BODY = "id string, created string, deadline string, payload string, metadata map<string,string>, headers map<string,string>, endpoint string, request_queue_name string, result_queue_name string, pubsub_id string"
INTERNAL = "retry_count string, queue_id string, request_token string, request_queue_name string, result_queue_name string, transport_correlation_id string, labels map<string,string>"


def _struct(fields: str) -> str:
    return f"struct<{', '.join(': '.join(f.split(' ', 1)) for f in fields.split(', '))}>"


def _kind(parsed: Column, path: str) -> Column:
    """JSON type of a member as Spark names it, or null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))


def decode_envelope(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds kind, req (struct), routing (struct) and reject: the reason why a message is no request, null if it is one.

    A null or `null` message carries no request. Members of a wrong JSON type reject the whole message.
    """
    v, parsed = F.col(value), F.col("_parsed")
    df = df.withColumn("_parsed", F.try_parse_json(v))  # the text is parsed once
    at = lambda path, kind: F.try_variant_get(parsed, path, kind)
    kind = blank_to_null(at("$.request_kind", "string"))
    empty = v.isNull() | (F.trim(v) == "") | (F.trim(v) == "null")
    bad_type = (_kind(parsed, "$.data.id") != "STRING") | (_kind(parsed, "$.data.created") != "BIGINT") | (_kind(parsed, "$.data.deadline") != "BIGINT")
    df = df.withColumns({"_kind": kind, "_data": _kind(parsed, "$.data"), "_bad": F.coalesce(bad_type, F.lit(False)), "_req": at("$.data", _struct(BODY)), "routing": at("$.internal", _struct(INTERNAL))})
    reject = (
        F.when(empty, "empty").when(parsed.isNull(), "malformed").when(F.col("_kind").isNull(), "missing kind").when(~F.col("_kind").isin(*KINDS), "unknown kind")
        .when(F.coalesce(F.col("_data") == "VOID", F.lit(True)), "empty data").when(F.col("_bad") | F.col("_req").isNull(), "wrong type")
    )
    return df.withColumns({"kind": F.col("_kind"), "reject": reject, "req": F.when(reject.isNull(), F.col("_req"))}).drop("_parsed", "_kind", "_data", "_bad", "_req")


def encode_envelope(kind: Column, request: dict[str, Column], routing: dict[str, Column]) -> Column:
    """Envelope JSON. Nulls are left out, and of the routing also a retry count of 0 and maps without entries."""
    keep = lambda cols: F.struct(*(c.alias(n) for n, c in cols.items()))
    if "retry_count" in routing:
        routing = routing | {"retry_count": F.nullif(routing["retry_count"], F.lit(0))}
    if "labels" in routing:
        routing = routing | {"labels": F.when(F.size(routing["labels"]) > 0, routing["labels"])}
    return F.to_json(F.struct(keep(routing).alias("internal"), kind.alias("request_kind"), keep(request).alias("data")))


def classify(labels: Column, cls: Column) -> Column:
    """A message's labels with its quota class among them; without a class the label goes."""
    rest = without(labels, F.lit("classification"))
    return overlay(rest, F.when(blank_to_null(cls).isNotNull(), F.create_map(F.lit("classification"), cls)))


def read_channel(df: DataFrame, queue: Column, labels: Column) -> DataFrame:
    """A channel's messages: the queue name is overwritten, the channel's labels overlay the message's."""
    return df.withColumns({"request_queue_name": queue, "labels": overlay(F.col("labels"), labels)})


def read_topic(df: DataFrame) -> DataFrame:
    """Topic messages (msg_id, data, attributes, delivery_attempt): body, attributes over metadata; malformed bodies are dropped."""
    body = F.from_json("data", "id string, created long, deadline long, metadata map<string,string>")
    df = df.withColumn("b", body).where(F.try_parse_json("data").isNotNull() & F.col("b.id").isNotNull())
    return df.select("msg_id", "b.id", "b.created", "b.deadline", overlay(F.col("b.metadata"), F.col("attributes")).alias("metadata"), F.coalesce(F.col("delivery_attempt") - 1, F.lit(0)).cast("int").alias("retry_count"))


def malformed_topic(df: DataFrame) -> DataFrame:
    """The topic messages that `read_topic` drops, with `reject`, why."""
    body = F.from_json("data", "id string")
    reject = F.when(F.try_parse_json("data").isNull(), "not JSON").when(body["id"].isNull(), "no id")
    return df.select("msg_id", "data", reject.alias("reject")).where("reject is not null")


def submit(df: DataFrame, now: int, default_queue: str, default_result: str) -> DataFrame:
    """Producer checks: `reject` is the reason, queue names are filled in."""
    reject = F.when(blank_to_null("id").isNull(), "id required").when(F.coalesce(F.col("deadline"), F.lit(0)) <= 0, "deadline required").when(F.col("deadline") < now, "deadline past")
    return df.withColumns({
        "reject": reject, "request_queue": F.coalesce(blank_to_null("request_queue"), F.lit(default_queue)), "result_queue": F.coalesce(blank_to_null("result_queue"), F.lit(default_result)),
    })


def normalize_kind(kind: Column, message: dict[str, Column], routing: dict[str, Column]) -> dict[str, Column]:
    """Routing of a message by its kind: queue messages' own queues win over the routing's, topic messages' id becomes the correlation
    id and plain ones keep what they have. message: request_queue_name, result_queue_name, pubsub_id; routing: the first two and
    transport_correlation_id.
    """
    out = {n: F.when(kind == "redis", F.coalesce(blank_to_null(message[n]), routing[n])).otherwise(routing[n]) for n in ("request_queue_name", "result_queue_name")}
    known = routing["transport_correlation_id"]
    return out | {"transport_correlation_id": F.when(kind == "pubsub", F.coalesce(blank_to_null(message["pubsub_id"]), known)).otherwise(known)}


def result_queue(config: Column, message: Column, default: str) -> Column:
    """Queue configuration, then the message, then the flow's default."""
    return F.coalesce(blank_to_null(config), blank_to_null(message), F.lit(default))


def marshal_result(id_: Column, status: Column, payload: Column, code: Column, message: Column) -> Column:
    """Result JSON; a status of 0 (no response) is left out. The fallback for unencodable bodies isn't needed, strings always encode."""
    return F.to_json(F.struct(id_.alias("id"), F.nullif(status, F.lit(0)).alias("status_code"), payload.alias("payload"), blank_to_null(code).alias("error_code"), blank_to_null(message).alias("error_message")))


def parse_result(df: DataFrame, value: str) -> DataFrame:
    """Result JSON to columns; rows without an id are marked in `reject`."""
    r = F.from_json(value, "id string, status_code int, payload string, error_code string, error_message string")
    out = df.withColumn("r", r).select(*df.columns, "r.*")
    return out.withColumn("reject", blank_to_null("id").isNull())


def parse_exposition(df: DataFrame, line: str = "line", file: str = "file") -> DataFrame:
    """Lines of metrics text to (file, metric, labels, value); only gauges, counters and untyped families."""
    text = F.col(line)
    types = df.where(text.startswith("# TYPE ")).select(F.col(file).alias("file"), F.regexp_extract(text, r"^# TYPE (\S+) (\S+)", 1).alias("metric"), F.regexp_extract(text, r"^# TYPE (\S+) (\S+)", 2).alias("family")).distinct()
    rows = df.where(~text.startswith("#") & (F.trim(text) != "")).select(
        F.col(file).alias("file"), F.regexp_extract(text, r"^([A-Za-z_:][\w:]*)", 1).alias("metric"), F.regexp_extract(text, r"^[\w:]+\{(.*)\}", 1).alias("inside"), F.regexp_extract(text, r"(?:\}|^[\w:]+)\s+(\S+)", 1).try_cast("double").alias("value")
    )
    entries = F.transform(F.regexp_extract_all("inside", F.lit(r'(\w+)="([^"]*)"'), F.lit(0)), lambda e: F.struct(F.regexp_extract(e, r"^(\w+)", 1), F.regexp_extract(e, r'="([^"]*)"', 1)))
    known = rows.join(types, ["file", "metric"], "left").where(F.coalesce("family", F.lit("untyped")).isin("gauge", "counter", "untyped"))
    base = F.regexp_replace("metric", "_(bucket|sum|count)$", "")
    skip = types.where(F.col("family").isin("histogram", "summary")).select("file", F.col("metric").alias("base"))
    return known.withColumn("base", base).join(skip, ["file", "base"], "left_anti").where("value is not null").select("file", "metric", F.map_from_entries(entries).alias("labels"), "value")
