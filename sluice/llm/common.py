"""What the operators share: table reading, shared scratch tables and connected components."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.queues import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the user sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Intermediate tables as Parquet files in the folder that the cluster shares.

    A written table cuts the lineage: a lost executor costs the running stage only. Shuffle files of its query go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_dir(spark, label)
        self.count = 0

    def save(self, df: DataFrame, name: str = "t", batch: int | None = None) -> DataFrame:
        """Write a table and read it back. batch: most rows that JVM and Python hand each other at once, for rows that are large."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        size, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(size), self.spark.conf.get(clean)
        self.spark.conf.set(size, min(int(before[0]), batch) if batch and int(before[0]) > 0 else batch or before[0])
        self.spark.conf.set(clean, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(size, before[0])
            self.spark.conf.set(clean, before[1])
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Let the driver forget plans that are no longer used, so that executors delete their shuffle files.

        The end of the last query reaches the driver's listeners a moment later; until then it is in use.
        """
        time.sleep(0.5)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of at most three numbers that are broadcast.
BROADCAST = 300_000


def small(df: DataFrame) -> DataFrame:
    """A saved table of a few numbers a row, to be broadcast while it has at most BROADCAST rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def smallest(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The `rows` rows of smallest hash of `keys`: a bounded sample that is the same on every run.

    Rows that can't be among them are left out where they are, by a bound on the hash from the number of rows, so that what comes together doesn't grow with the table.
    """
    total = df.count()
    of, near = F.xxhash64(*keys), df
    if total > 4 * rows:
        bound = int(2.0**64 * 2 * rows / total) - 2**63
        near = df.where(of < bound)
        if near.limit(rows).count() < rows:  # very many equal keys
            near = df
    return near.orderBy(of, *keys).limit(rows)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each round links nodes to the smallest neighbour
    they know, in O(log n) rounds. A round is two groupings with map-side minima and two joins,
    written to scratch; nothing but a checksum comes to the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, last = scratch.save(e, "links"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.save(small.union(low.select("u", "m")).distinct(), "links")
        sums = nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
        scratch.drop(e)
        e = nxt
        if tuple(sums) == last:
            break
        last = tuple(sums)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def worker_cache(name: str, build):
    """An object that a Python worker keeps across its tasks, such as a loaded vocabulary."""
    import sys
    import types

    kept = sys.modules.setdefault("_sluice_kept", types.ModuleType("_sluice_kept"))
    if not hasattr(kept, name):
        setattr(kept, name, build())
    return getattr(kept, name)


def by_size(column, most: int, rows: int = 50_000):
    """Parts of an Arrow column of texts by size: (first row, row after the last, texts as bytes)."""
    import pyarrow as pa

    lo = 0
    while lo < len(column):
        size = 0
        texts = []
        for cell in column[lo : lo + rows].cast(pa.binary()):
            text = cell.as_py()
            texts.append(text)
            size += len(text or b"")
            if size >= most:
                break
        yield lo, lo + len(texts), texts
        lo += len(texts)


def lean(run):
    """A task function over Arrow batches whose worker gives freed memory back at once, so that idle workers stay small."""

    def held(batches):
        import ctypes

        import pyarrow as pa

        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # arrays of 1 MB and more are mapped, and unmapped when freed
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return held
