"""Windowed streams, stream joins, deduplication, and running streams into files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.sources.queues import shared_dir
from sluice.streaming.processors import with_state_store


def event_time(df: DataFrame, seconds: str = "created", delay: str = "10 minutes", name: str = "event_at") -> DataFrame:
    """Adds event time from Unix seconds, with a watermark."""
    return df.withColumn(name, F.timestamp_seconds(seconds)).withWatermark(name, delay)


def windowed_counts(rows: DataFrame, keys: list[str], width: str, slide: str | None = None, bounds: tuple = (), delay: str = "10 minutes") -> DataFrame:
    """Live counters and histogram (cumulative `buckets`, one per bound) of `value` per window: tumbling, or sliding for rates at a step.

    The watermark bounds state: rows that come more than `delay` after the newest are not counted, and are reported as `numRowsDroppedByWatermark` of the query's progress.
    """
    window = F.window("event_at", width, slide) if slide else F.window("event_at", width)
    bars = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    out = event_time(rows, delay=delay).groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), *bars)
    return out.withColumn("buckets", F.array(*(f"b{i}" for i in range(len(bounds))))).drop(*(f"b{i}" for i in range(len(bounds)))) if bounds else out


def match_results(requests: DataFrame, results: DataFrame, within: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Each result with its request, and the seconds between them. requests: (id, created, ..); results: (request_id, finished, ..), up to `within` later.

    State of either side is kept while a match can still come, given that rows come at most `delay` late.
    """
    a, b = event_time(requests, delay=delay), event_time(results, "finished", delay, "result_at")
    near = F.expr(f"id = request_id and result_at >= event_at and result_at <= event_at + interval {within}")
    return a.join(b, near).withColumn("latency", F.col("finished") - F.col("created")).drop("event_at", "result_at", "request_id")


def dedupe(rows: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Each key once, however often it comes within that time of arrival; arrival times never lie behind the watermark, so no first row is lost. State goes after `within`."""
    seen = rows.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", within)
    return seen.dropDuplicatesWithinWatermark(keys).drop("arrived_at")


#: For streams that give out nothing but what came in with the batch, like inner joins: no last batch without input, which would only
#: clear state (the next batch with input does so), and no reads of state just to count its rows.
PROMPT = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def run_available(stream: DataFrame, label: str, path: str | None = None, prompt: bool = False) -> DataFrame:
    """Run a stream over all that its sources hold now, into files, and read them. A stream that runs again with the same `path` goes on where it ended.

    prompt: no row waits for the watermark to come out, so that no batch must follow the last input.
    """
    return run_observed(stream, label, path=path, settings=PROMPT if prompt else None)[0]


def run_observed(stream: DataFrame, label: str, counts: dict[str, Column] | None = None, path: str | None = None, settings: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """As `run_available`, with counts over the rows that reach the sink, added up over all batches, `late`: rows that stateful operators dropped, and `state_rows`: those held at the end."""
    spark = stream.sparkSession
    path = path or shared_dir(spark, label)
    seen = stream.observe("seen", *(F.count_if(c).alias(n) for n, c in counts.items())) if counts else stream
    with with_state_store(spark, settings):
        q = seen.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    total = dict.fromkeys([*(counts or {}), "late", "state_rows"], 0)
    for p in q.recentProgress:
        total["state_rows"] = sum(o.numRowsTotal for o in p.stateOperators)
        total["late"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        for n in counts or {}:
            total[n] += p.observedMetrics["seen"][n] if "seen" in p.observedMetrics else 0
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), total
