"""Ordered computations over keys that may hold most of the rows.

A plain window puts all rows of a key into one task. These operators cut time into slices of `width`, compute within
(key, slice), and carry sums, ranks or last rows from slice to slice through a small table with one row per key and slice. Unless a width is given, a slice
is a day or, where the fullest key has more than a million rows a day, as much less as brings its slices down to that (`width_of`).

Keys and times may be null: null keys are one key, null times come first. Rows are brought to their slice's row by one column, the
struct of keys and slice, which is never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def width_for(df: DataFrame, keys: list[str], time: str, rows: int = 1_000_000) -> int:
    """Width at which an evenly filled slice of the fullest key holds about `rows` rows; at most the whole time of the key."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(time) - F.min(time) + 1).alias("span"))
    found = per.agg(F.min(F.greatest(F.lit(1).cast("double"), F.col("span") * F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n"))))).first()[0]
    return int(found) if found is not None else DAY


def width_of(df: DataFrame, keys: list[str], time: str, width: int | None, rows: int = 1_000_000) -> int:
    """The width given, else a day, or less where the fullest key's slices would hold more than `rows` rows. A table of fewer rows than that is only counted."""
    if width is not None:
        return width
    return DAY if df.count() <= rows else min(DAY, width_for(df, keys, time, rows))


def sliced(df: DataFrame, keys: list[str], time: str | Column, width: int) -> DataFrame:
    """Adds _g: keys and slice."""
    at = F.col(time) if isinstance(time, str) else time
    return df.withColumn("_g", F.struct(*keys, F.floor(at / width).alias("_slice")))


def before(keys: list[str]) -> object:
    """The earlier slices of a key, over one row per slice."""
    return Window.partitionBy(*(F.col(f"_g.{k}") for k in keys)).orderBy("_g._slice").rowsBetween(Window.unboundedPreceding, -1)


def within(*order: str) -> object:
    """A slice's rows in order."""
    return Window.partitionBy("_g").orderBy(*order)


def running(df: DataFrame, keys: list[str], time: str, ties: list[str], *, width: int | None = None, upto: float | None = None, **sums: Column) -> DataFrame:
    """Adds running sums (inclusive) over each key in the order of time and `ties`.

    upto: of the first sum, whose summands are not negative, only rows at which it is at most that are wanted; slices beyond it are left out before they are ordered.
    """
    df = sliced(df, keys, time, width_of(df, keys, time, width))
    named = {f"_v_{n}": c for n, c in sums.items()}
    df = df.withColumns(named)
    part = df.groupBy("_g").agg(*(F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums))
    part = part.select("_g", *(F.coalesce(F.sum(f"_p_{n}").over(before(keys)), F.lit(0)).alias(f"_b_{n}") for n in sums))
    if upto is not None:
        part = part.where(F.col(f"_b_{next(iter(sums))}") <= upto)
    inner = within(time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(part, "_g").withColumns({n: F.sum(f"_v_{n}").over(inner) + F.col(f"_b_{n}") for n in sums})
    if upto is not None:
        out = out.where(F.col(next(iter(sums))) <= upto)
    return out.drop("_g", *named, *(f"_b_{n}" for n in sums))


def ranked(df: DataFrame, keys: list[str], time: str, ties: list[str], name: str = "rn", width: int | None = None) -> DataFrame:
    """Adds the row number within each key in the order of time and `ties`."""
    return running(df, keys, time, ties, width=width, **{name: F.lit(1).cast("long")})


def previous(df: DataFrame, keys: list[str], time: str, ties: list[str], columns: dict[str, str], width: int | None = None) -> DataFrame:
    """Adds the values of the row before, by key: {new name: column}."""
    df = sliced(df, keys, time, width_of(df, keys, time, width))
    row = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    last = df.groupBy("_g").agg(F.max_by(row, F.struct(time, *ties)).alias("_last"))
    last = last.select("_g", F.last("_last", ignorenulls=True).over(before(keys)).alias("_carry"))
    out = df.join(last, "_g").withColumn("_prev", F.coalesce(F.lag(row).over(within(time, *ties)), F.col("_carry")))
    return out.withColumns({n: F.col(f"_prev.{n}") for n in columns}).drop("_g", "_carry", "_prev")


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], *, forward: bool = False, width: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before its time (forward: the first at or after), and that row's time as `at`.

    Right times are distinct within a key; right rows without a time match nothing, nor do left rows without one.
    """
    sign = -1 if forward else 1
    names = left.columns
    row = F.struct(F.col(time).alias("at"), *columns)
    right = right.where(F.col(time).isNotNull())
    both = left.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None)).unionByName(right.select(*keys, time, F.lit(0).alias("_side"), row.alias("_r")), allowMissingColumns=True)
    both = both.withColumn("_t", sign * F.col(time))
    both = sliced(both, keys, "_t", width_of(both, keys, "_t", width))
    last = both.groupBy("_g").agg(F.max_by(F.when(F.col("_side") == 0, F.col("_r")), F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    last = last.select("_g", F.last("_last", ignorenulls=True).over(before(keys)).alias("_carry"))
    inner = within("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.join(last, "_g").withColumn("_m", F.coalesce(F.last("_r", ignorenulls=True).over(inner), F.col("_carry"))).where("_side = 1")
    return out.select(*names, "_m.at", *(f"_m.{c}" for c in columns))


def running_max(df: DataFrame, keys: list[str], time: str, column: str, name: str, width: int | None = None) -> DataFrame:
    """Adds the running maximum (inclusive) of a column by key."""
    df = sliced(df, keys, time, width_of(df, keys, time, width))
    part = df.groupBy("_g").agg(F.max(column).alias("_m"))
    part = part.select("_g", F.max("_m").over(before(keys)).alias("_carry"))
    inner = within(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(part, "_g").withColumn(name, F.greatest(F.max(column).over(inner), F.col("_carry"))).drop("_g", "_carry")
