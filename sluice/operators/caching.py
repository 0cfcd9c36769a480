"""Reads through a cache of fixed lifetime.

A read refreshes the cache if none of the reads before it did so less than `ttl` seconds ago, so each refresh depends on the one before. A row loop isn't needed: every read
time points to the first one at or after `ttl` seconds later, and the refreshes are what is reached by these pointers from reads that follow a pause of `ttl` (refreshes whatever came before).
Pointers are followed by doubling: within a slice of time over arrays, and from slice to slice by joins, in as many rounds as the longest chain of slices without a pause has binary digits. A hot key
is as many tasks as it has slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import windows
from sluice.sources.queues import shared_dir

NEVER = 2**63 - 1


def _doubled(part: pd.DataFrame):
    """A slice's rows by time, and ever further pointers between them; a row whose pointer leaves the slice points to itself."""
    part = part.sort_values("_t", kind="stable", ignore_index=True)
    t = part["_t"].to_numpy()
    to = np.searchsorted(t, part["_to"].to_numpy())
    to = np.where(to < len(t), to, np.arange(len(t)))

    def further():
        at = to
        for _ in range(len(t).bit_length()):
            yield at
            at = at[at]
        yield at

    return part, further


def _exits(part: pd.DataFrame) -> pd.DataFrame:
    """Where each row's chain goes on after its slice."""
    part, further = _doubled(part)
    *_, last = further()
    part["_out"] = part["_to"].to_numpy()[last]
    return part


def _marks(part: pd.DataFrame) -> pd.DataFrame:
    """The rows reached from a slice's starts."""
    part, further = _doubled(part)
    reached = part["_start"].to_numpy(bool).copy()
    for at in further():
        reached[at[reached]] = True
    return part[reached]


def refreshes(reads: DataFrame, keys: list[str], time: str, ttl: int, *, width: int | None = None) -> DataFrame:
    """(keys, time) of the reads that refresh the cache of their key; times are whole seconds. Null keys are one key; reads without a time refresh nothing."""
    spark = reads.sparkSession
    root, saved = shared_dir(spark, "cache"), 0

    def save(df: DataFrame) -> DataFrame:
        nonlocal saved
        saved += 1
        path = f"{root}/{saved:03d}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    times = save(reads.select(*keys, F.col(time).cast("long").alias("_t")).where("_t is not null").distinct())
    width = width or windows.width_for(times, keys, "_t")
    ahead = windows.asof(times.select(*keys, F.col("_t").alias("_from"), (F.col("_t") + ttl).alias("_t")), times, keys, "_t", [], forward=True, width=width)
    rows = windows.previous(ahead.select(*keys, F.col("_from").alias("_t"), F.coalesce("at", F.lit(NEVER)).alias("_to")), keys, "_t", [], {"_before": "_t"}, width=width)
    start = F.col("_before").isNull() | (F.col("_t") - F.col("_before") >= ttl)
    rows = rows.select(*keys, "_t", "_to", start.alias("_start"), F.floor(F.col("_t") / width).alias("_slice"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = save(rows.groupBy(*keys, "_slice").applyInPandas(_exits, f"{fields}, _out long"))
    node = lambda t: F.struct(*keys, F.col(t).alias("_t"))  # noqa: E731  a struct is never null, so null keys join
    # From slice to slice: only rows to which a pointer from another slice leads.
    crossing = rows.where((F.col("_to") < NEVER) & (F.floor(F.col("_to") / width) > F.col("_slice"))).select(node("_to").alias("a")).distinct()
    step = save(rows.where((F.col("_out") < NEVER) & ~F.col("_start")).select(node("_t").alias("a"), node("_out").alias("b")).join(crossing, "a", "left_semi"))
    found = save(rows.where((F.col("_out") < NEVER) & F.col("_start")).select(node("_out").alias("a")).distinct())
    while not step.isEmpty():
        more = save(step.join(found, "a", "left_semi").select(F.col("b").alias("a")).join(found, "a", "left_anti").distinct())
        if more.isEmpty():
            break
        found = save(found.unionByName(more))
        step = save(step.alias("x").join(step.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b"))
    entered = rows.select("*", node("_t").alias("a")).join(found.withColumn("_entry", F.lit(True)), "a", "left").drop("a", "_out")
    entered = entered.withColumn("_start", F.col("_start") | F.coalesce("_entry", F.lit(False))).drop("_entry")
    return entered.groupBy(*keys, "_slice").applyInPandas(_marks, fields).select(*keys, F.col("_t").alias(time))


def cached_asof(reads: DataFrame, samples: DataFrame, keys: list[str], time: str, columns: list[str], ttl: int, *, width: int | None = None) -> DataFrame:
    """Each read with `refreshed_at`, the last refresh of its key's cache, and the sample of the cache: the last one at or before that refresh, with its time `at`.

    A refresh that finds no sample caches that there is none. samples: times distinct within a key.
    """
    width = width or windows.width_for(reads, keys, time)
    filled = windows.asof(refreshes(reads, keys, time, ttl, width=width), samples, keys, time, columns, width=width)
    found = windows.asof(reads, filled.withColumnRenamed("at", "_sampled"), keys, time, ["_sampled", *columns], width=width)
    return found.withColumnsRenamed({"at": "refreshed_at", "_sampled": "at"})
