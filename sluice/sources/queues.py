"""Persisted queues, results and configuration: folders of JSON lines that batches and streams read and append to.

Requests lie in one sub-folder per queue (`request_queue=<name>`), results in one per result queue.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING_DDL = "id string, created long, deadline long, payload string, metadata map<string,string>, token string, retry_count int, request_queue string"
#: Defaults of configuration entries.
QUEUE_DEFAULTS = {"workers": 64, "gate_type": "constant", "path": "/v1/completions"}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the cluster shares. Only a local master may do without `spark.checkpoint.dir`."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="sluice-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def pending(spark: SparkSession, path: str, *, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """One row per pending request with its score, the deadline. stream: requests appended later come in later batches."""
    reader = (spark.readStream if stream else spark.read).schema(PENDING_DDL)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumn("score", F.col("deadline").cast("double"))


TOPIC_DDL = "msg_id string, data string, attributes map<string,string>, publish_time timestamp, delivery_attempt int, queue_id string"


def messages(spark: SparkSession, path: str, *, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Messages of topics and channels as brokers deliver them, from a folder to which JSON lines are added. stream: a query's checkpoint has the offsets, so it goes on where it ended."""
    reader = (spark.readStream if stream else spark.read).schema(TOPIC_DDL)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def append_requests(submitted: DataFrame, path: str) -> None:
    """Append the rows of `messages.submit` that carry no reject reason to their queues' folders."""
    columns = [f.split()[0] for f in PENDING_DDL.replace("map<string,string>", "map").split(", ")]
    rows = submitted.where("reject is null")
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns)).write.mode("append").partitionBy("request_queue").json(path)


def without_stale_markers(cancels: DataFrame, submitted: DataFrame) -> DataFrame:
    """Cancel markers that stay once requests are submitted: a new submission of an id clears what was left of its older generations."""
    return cancels.join(submitted.where("reject is null and id <> ''").select("id").distinct(), "id", "left_anti")


def append_results(results: DataFrame, path: str, *, time: str, flush_rows: int = 0, parts_per_queue: int = 1) -> None:
    """Append results to their queues' folders, first in first out within each file. flush_rows: most results per file, 0 for no bound.

    A queue's results go to `parts_per_queue` tasks, so a hot queue is split.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(parts_per_queue))
    rows = results.repartition("result_queue", part).sortWithinPartitions("result_queue", time, "id")
    rows.write.mode("append").option("maxRecordsPerFile", flush_rows).partitionBy("result_queue").json(path)


def clear(spark: SparkSession, path: str, column: str, name: str) -> bool:
    """Delete all that one queue's folder holds; whether there was any."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}={name}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def load_config(spark: SparkSession, path: str, schema: str, *, key: str = "id", required: tuple[str, ...] = (), defaults: dict | None = None, fail: bool = True) -> DataFrame:
    """Configuration entries of JSON files (arrays or single objects) with defaults filled in and `problem`, null where an entry is sound.

    Problems: no key, a key given twice, a required field missing or empty. With `fail`, any problem raises ValueError that names them.
    """
    entries = spark.read.schema(schema).option("multiLine", True).json(path)
    many = entries.groupBy(key).agg(F.count("*").alias("_n"))
    entries = entries.join(many, entries[key].eqNullSafe(many[key])).drop(many[key])
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    problem = F.when(empty(key), f"no {key}").when(F.col("_n") > 1, f"{key} given twice")
    for c in required:
        problem = problem.when(empty(c), f"no {c}")
    filled = {c: F.when(empty(c), F.lit(v)).otherwise(F.col(c)) for c, v in (defaults or {}).items()}
    out = entries.withColumn("problem", problem).withColumns(filled).drop("_n")
    if fail:
        bad = [f"{r[0]}: {r[1]}" for r in out.where("problem is not null").select(key, "problem").distinct().orderBy(key).limit(20).collect()]
        if bad:
            raise ValueError("; ".join(bad))
    return out
