"""Engine inputs derived from the star-schema and event tables.

`events` stands in for queued requests and metric samples, `orders` for a large batch. All columns are
functions of the row, so every query grows with its table. Times are whole Unix seconds and never depend on the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference time of queries over stored data, 2024-01-16 00:00:00.
NOW = 1705363200
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def seconds(col: str) -> Column:
    """Unix seconds of a zone-free timestamp."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, cast({col} as timestamp_ntz))")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event: id, times, queue, tenant, tier, outcome of its attempt, size."""
    e = read(spark, sf_dir, "events")
    k = F.coalesce(F.expr("try_cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as bigint)"), F.lit(0))
    e = e.withColumn("k", k).withColumn("created", seconds("ts"))
    tier = F.when(F.col("event_type") == "purchase", "interactive").when(F.col("event_type").isin("click", "view"), "async").otherwise("batch")
    m, c = F.col("event_id") % 20, F.col("event_id") % 3
    status = F.when(m == 0, 429).when(m == 1, 503).when(m == 2, 400).when(m == 3, 0).otherwise(200)
    return e.select(
        "event_id", F.concat(F.lit("req-"), "event_id").alias("id"), "created", (F.col("created") + 60 * (1 + F.col("k") % 10)).alias("deadline"), F.col("event_type").alias("queue_id"),
        F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("tenant"), tier.alias("tier"), F.when(c == 0, "reserved").when(c == 1, "overflow").otherwise("").alias("class"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"), status.alias("status"), F.md5(F.col("event_id").cast("string")).alias("token"), "value", "k", "ts",
    )


#: The same as DuckDB SQL, to go after `with`.
REQ = """req as (select event_id, 'req-' || event_id as id, created, created + 60 * (1 + k % 10) as deadline, event_type as queue_id, coalesce(cast(user_id as varchar), '') as tenant,
  case when event_type = 'purchase' then 'interactive' when event_type in ('click', 'view') then 'async' else 'batch' end as tier,
  case event_id % 3 when 0 then 'reserved' when 1 then 'overflow' else '' end as class, cast(event_id % 4 as int) as retry_count,
  case event_id % 20 when 0 then 429 when 1 then 503 when 2 then 400 when 3 then 0 else 200 end as status, md5(cast(event_id as varchar)) as token, value, k, ts
  from (select *, coalesce(try_cast(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') as bigint), 0) as k, cast(floor(epoch(ts)) as bigint) as created from events))"""

#: Queue configuration: id, result queue, pool, objective, path, base, labels. `error` is not configured.
QUEUES = (
    ("click", "res-click", "pool-a", "fast", "/v1/completions", "http://gw-a/", {"team": "web", "tenant": "from-config"}),
    ("view", "", "pool-a", "", "v1/completions", "http://gw-a", {"team": "web"}),
    ("purchase", "res-buy", "pool-b", "paid", "/v1/chat", "http://gw-b/api", {}),
    ("signup", "", "", "", "/v1/chat", "http://gw-b/api/", {"team": "growth"}),
)
QUEUE_DDL = "queue_id string, result_queue string, pool string, objective string, path string, base string, labels map<string,string>"
#: Pools: id, workers (0: the default), pods ready, most requests per pod.
POOLS = (("default", 0, 3, 100), ("pool-a", 8, 4, 25), ("pool-b", 0, 0, 50))
POOL_DDL = "pool string, workers int, ready int, most int"


def queues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*QUEUES], QUEUE_DDL)


def pools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*POOLS], POOL_DDL)


def _values(rows, names: str) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"(select * from (values {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) t({names}))"


CFG = f"cfg as {_values([(*q[:6], q[6].get('team', ''), q[6].get('tenant', '')) for q in QUEUES], 'queue_id, result_queue, pool, objective, path, base, team, tenant_label')}"
POOL = f"pools as {_values(POOLS, 'pool, workers, ready, most')}"


def sql(*ctes: str, body: str) -> str:
    """A DuckDB query with common table expressions."""
    return f"with {', '.join(ctes)}\n{body}"
