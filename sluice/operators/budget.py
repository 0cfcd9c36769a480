"""Capacity budgets in [0, 1] from metric samples, and what they let through.

A sample that is missing and one that is not a number differ: a cascade skips the first and accepts the second.
Every operator takes `has` (whether there is a sample) beside the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITE = float("inf")


def unit(v: Column) -> Column:
    """v within [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def is_number(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INFINITE)


def threshold(has: Column, v: Column, least: float, fallback: float) -> Column:
    """v - least within [0, 1], 0 up to `least`; the fallback where there is no sample or no finite number."""
    return F.when(~(has & is_number(v)), unit(F.lit(float(fallback)))).when(v <= least, 0.0).otherwise(unit(v - least))


def saturation(has: Column, sat: Column, most: float = 0.8, fallback_sat: float = 0.0) -> Column:
    """Budget from a saturation: closed from `most` on; by default open where the sample fails."""
    return threshold(has, 1 - sat, 1 - most, 1 - fallback_sat)


def headroom(load: Column, ready: Column, most: Column) -> Column:
    """1 - load / (ready * most); null (a sample without a number) with no pods ready."""
    return 1 - F.try_divide(load, ready * most)


def pod_queue(samples: DataFrame, keys: list[str], size: str, most: float) -> DataFrame:
    """1 - average queue size over the pods of each group / most. samples: one row per pod with a name; a group without any has no row."""
    return samples.where(F.col(size).isNotNull()).groupBy(*keys).agg((1 - F.avg(size) / F.lit(float(most))).alias("value"))


def cascade(sources: list[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """(has, value, index) of the first source that has a sample."""
    has = value = index = None
    for i, (h, v) in enumerate(sources):
        has = h if has is None else has | h
        value = F.when(h, v) if value is None else value.when(h, v)
        index = F.when(h, i) if index is None else index.when(h, i)
    return has, value, index.cast("int")


def scraped(value: Column, most: Column, baseline: float, has: Column, fallback: float = 0.0) -> Column:
    """Budget from a scraped gauge: saturation is value / most, or the value itself where most is 0."""
    sat = F.when(most == 0, value).otherwise(F.try_divide(value, most))
    return threshold(has, 1 - unit(sat), baseline, fallback)


def binary(has: Column, v: Column) -> Column:
    """Open at 0 and where there is no sample, closed otherwise."""
    return F.when(has & (v != 0), 0.0).otherwise(1.0)


def external(text: Column, failed: Column) -> Column:
    """Externally written budget: open if missing or no number, closed if it can't be read."""
    v = text.try_cast("double")
    return F.when(failed, 0.0).when(v.isNull() | F.isnan(v), 1.0).otherwise(unit(v))


def composite(budgets: list[Column]) -> Column:
    """The smallest inner budget; 1 with none."""
    return F.least(F.lit(1.0), *budgets) if budgets else F.lit(1.0)


def local(inflight: Column, limit: int) -> Column:
    return F.greatest(F.lit(0.0), (limit - inflight) / F.lit(float(limit)))


def dispatch_count(batch: int, budget: Column) -> Column:
    """Whole number of requests that a round may take."""
    return F.greatest(F.lit(0), F.floor(F.lit(float(batch)) * budget)).cast("long")


#: Registered budget expressions by name; an unknown name is the constant 1.
GATES = {"constant": lambda: F.lit(1.0)}


def register_gate(name: str, expression) -> None:
    """Make a budget expression (a function of no arguments that gives a Column) available by name."""
    GATES[name] = expression


def gate(name: str) -> Column:
    return GATES.get(name, GATES["constant"])()


def with_budget(df: DataFrame, expression: str) -> DataFrame:
    """Budget from a user's Spark SQL expression, threshold 0."""
    v = F.expr(expression).cast("double")
    return df.withColumn("budget", threshold(v.isNotNull(), v, 0.0, 0.0))
