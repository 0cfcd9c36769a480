"""Rounds of micro-batches: a transactional result sink, and a backlog that is popped earliest deadline first.

A folder is published by one rename, which Hadoop file systems and local disks do as a whole. What a failed batch leaves staged is never read, and a batch that is
repeated after its rename finds its folder and writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.queues import shared_dir
from sluice.streaming.processors import with_state_store


class Folder:
    """A folder on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def publish(self, staged: str, name: str) -> None:
        """Give a staged folder its name, if none has it yet."""
        self.fs.mkdirs(self._at(name).getParent())
        if self.exists(name) or not self.fs.rename(self._at(staged), self._at(name)):
            if not self.exists(name):
                raise OSError(f"{self.path}/{staged} could not be renamed to {name}")
            self.delete(staged)


def write_results(results: DataFrame, path: str, batch_id: int, *, query: str = "results", queue: str = "result_queue", order: list[Column | str], flush_rows: int = 32, parts_per_queue: int = 1, before_commit: Callable | None = None) -> bool:
    """Write one batch of results exactly once by (query, batch id), and say whether this call did.

    Files hold at most `flush_rows` rows of one queue, in `order` within a file; a queue's rows go to `parts_per_queue` tasks, so a hot queue is split. before_commit is called
    between write and commit (tests fail there).
    """
    folder = Folder(results.sparkSession, path)
    name, staged = f"out/query={query}/batch={batch_id}", f"staged/{uuid.uuid4().hex}"
    if folder.exists(name):
        return False
    part = F.pmod(F.xxhash64(F.struct(*results.columns)), F.lit(parts_per_queue))
    rows = results.repartition(queue, part).sortWithinPartitions(queue, *order)
    rows.write.option("maxRecordsPerFile", flush_rows).partitionBy(queue).parquet(f"{folder.path}/{staged}")
    if before_commit:
        before_commit(batch_id)
    folder.publish(staged, name)
    return True


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Committed results of all queries and batches, with both."""
    return spark.read.schema(f"{schema}, query string, batch long").parquet(f"{path.rstrip('/')}/out")


def run_results(stream: DataFrame, path: str | None = None, *, query: str = "results", order: list[Column | str], label: str = "results", **options) -> DataFrame:
    """Run a stream of results over all that its sources hold now, through the transactional sink; a path that has run before goes on where it ended."""
    spark = stream.sparkSession
    path = path or shared_dir(spark, label)
    with with_state_store(spark):
        q = (
            stream.writeStream.foreachBatch(lambda batch, batch_id: write_results(batch, path, batch_id, query=query, order=order, **options) and None)
            .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        )
    q.awaitTermination()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return read_results(spark, path, ddl)


def run_tables(stream: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], path: str | None = None, label: str = "tables") -> dict[str, DataFrame]:
    """Run a stream into several tables, each a function of the micro-batch; all of a batch's tables are published together, once by batch id."""
    spark = stream.sparkSession
    path = path or shared_dir(spark, label)
    folder = Folder(spark, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        name, staged = f"out/batch={batch_id}", f"staged/{uuid.uuid4().hex}"
        if folder.exists(name):
            return
        batch = batch.persist()  # read once for all tables; recomputed where an executor is lost
        for table, f in tables.items():
            f(batch).write.parquet(f"{path}/{staged}/{table}")
        batch.unpersist()
        folder.publish(staged, name)

    with with_state_store(spark):
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    return {t: spark.read.schema(f(empty).schema).parquet(f"{path}/out/*/{t}") if folder.exists("out") else f(empty) for t, f in tables.items()}


class Backlog:
    """Waiting rows in slices of their deadline, of which a round reads and rewrites only those that it pops from.

    A slice is `width` seconds of deadlines (rows without one come first). Its rows lie in one folder for each version that added to it; a manifest per round has the
    versions and rows of every (slice, queue), and names a slice's versions anew once the round has popped from it. Everything is named by its round, and a manifest is published last:
    a round that is repeated begins from the manifest before it.
    """

    def __init__(self, spark: SparkSession, path: str, schema, *, queue: str = "queue_id", deadline: str = "deadline", key: str = "event_id", width: int = 3600):
        self.spark, self.folder, self.schema = spark, Folder(spark, path), spark.createDataFrame([], schema).schema
        self.queue, self.deadline, self.key, self.width = queue, deadline, key, width
        self.touched: dict[int, int] = {}

    def _slice(self) -> Column:
        return F.coalesce(F.floor(F.col(self.deadline) / self.width), F.lit(-(1 << 40)))

    def manifest(self, round_: int) -> DataFrame:
        """(slice, version, queue, n) after a round; empty before the first."""
        ddl = "slice long, version string, queue string, n long"
        name = f"manifest/{round_}"
        return self.spark.read.schema(ddl).parquet(f"{self.folder.path}/{name}") if self.folder.exists(name) else self.spark.createDataFrame([], ddl)

    def _store(self, rows: DataFrame, version: str) -> DataFrame:
        """Write rows as a version of their slices; its part of the manifest."""
        path = f"{self.folder.path}/rows/version={version}"
        rows.withColumn("slice", self._slice()).write.mode("overwrite").partitionBy("slice").parquet(path)
        back = self.spark.read.schema(self.schema).parquet(path) if self._any(path) else self.spark.createDataFrame([], self.schema)
        return back.groupBy(self._slice().alias("slice"), F.col(self.queue).cast("string").alias("queue")).agg(F.count("*").alias("n")).select("slice", F.lit(version).alias("version"), "queue", "n")

    def _any(self, path: str) -> bool:
        return any(s.getPath().getName().startswith("slice=") for s in self.folder.fs.listStatus(self.folder.jvm.org.apache.hadoop.fs.Path(path)))

    def rows(self, versions: list[tuple[str, int]]) -> DataFrame:
        """The rows of some slices' versions."""
        paths = [f"{self.folder.path}/rows/version={v}/slice={s}" for v, s in versions]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def left(self, round_: int) -> DataFrame:
        """All rows that wait after a round."""
        return self.rows([tuple(r) for r in self.manifest(round_).select("version", "slice").distinct().collect()])

    def play(self, new: DataFrame, round_: int, pop: Callable[[DataFrame], DataFrame], most: int) -> None:
        """One round: `new` joins the backlog, and `pop` takes at most the `most` rows of earliest deadline of each queue, told apart by `key`."""
        if self.folder.exists(f"manifest/{round_}"):
            return
        before = self.manifest(round_ - 1)
        held = before.unionByName(self._store(new.select(*self.schema.names), f"{round_}-in"))
        # Slices up to that at which a queue has `most` rows. What comes here is bounded by the slices of one round's pop.
        by_slice = held.groupBy("queue", "slice").agg(F.sum("n").alias("n"))
        ahead = F.sum("n").over(_ordered("queue", "slice"))
        needed = by_slice.withColumn("ahead", ahead - F.col("n")).where(F.col("ahead") < most).select("slice").distinct()
        versions = [(v, s) for v, s in held.join(needed, "slice").select("version", "slice").distinct().collect()]
        waiting = self.rows(versions)
        out, touched = f"popped/round={round_}", sorted({s for _, s in versions})
        self.touched[round_] = len(touched)
        pop(waiting).write.mode("overwrite").parquet(f"{self.folder.path}/{out}")
        taken = self.spark.read.parquet(f"{self.folder.path}/{out}").select(self.key)
        rest = self._store(waiting.join(taken, self.key, "left_anti").select(*self.schema.names), f"{round_}-rest")
        after = held.where(~F.col("slice").isin(touched)) if touched else held
        staged = f"staged/{uuid.uuid4().hex}"
        after.unionByName(rest).coalesce(1).write.parquet(f"{self.folder.path}/{staged}")
        self.folder.publish(staged, f"manifest/{round_}")
        if round_ > 1:  # what the round before no longer named
            old = self.manifest(round_ - 2).select("version", "slice").distinct().exceptAll(before.select("version", "slice").distinct())
            for v, s in old.collect():
                self.folder.delete(f"rows/version={v}/slice={s}")
            self.folder.delete(f"manifest/{round_ - 2}")


def _ordered(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def poll_rounds(stream: DataFrame, pop: Callable[[DataFrame], DataFrame], label: str, *, most: int, more_rounds: int = 0, width: int = 3600, path: str | None = None) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Rounds that carry over what they don't pop: (popped rows with their round, rows still waiting, slices that each round touched).

    Each micro-batch joins what earlier ones left; `pop(waiting)` gives the rows of `waiting` that the round takes, with any added columns: of each queue some of the `most` of earliest deadline.
    `more_rounds` follow without new rows.
    """
    spark = stream.sparkSession
    path = path or shared_dir(spark, label)
    backlog = Backlog(spark, path, stream.schema, width=width)
    with with_state_store(spark):
        q = (
            stream.writeStream.foreachBatch(lambda batch, batch_id: backlog.play(batch, batch_id, pop, most)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        )
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else -1
    for round_ in range(last + 1, last + 1 + more_rounds):
        backlog.play(spark.createDataFrame([], stream.schema), round_, pop, most)
    last += more_rounds
    popped = spark.read.option("basePath", f"{path}/popped").parquet(f"{path}/popped/*") if last >= 0 else pop(spark.createDataFrame([], stream.schema)).withColumn("round", F.lit(0))
    return popped, backlog.left(last), backlog.touched
