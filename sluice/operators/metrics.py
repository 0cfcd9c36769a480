"""Counters, histograms, gauges, rates, quantiles and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import windows
from sluice.sources.queues import shared_dir

# Bucket bounds in milliseconds of calls, of waiting in process, and from publishing to success.
INFERENCE_MS = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 120000)
RESIDENCE_MS = (500, 1000, 2000, 5000, 10000, 30000, 60000, 120000, 300000, 600000, 1800000, 3600000, 7200000, 21600000, 43200000, 86400000)
LATENCY_MS = (100, 1000, 5000, 10000, 20000, 50000, 100000, 200000, 500000, 1000000)
# Alert rules with the share of requests that a rule compares, its threshold and how long it must hold, in seconds.
ALERT_RULES = (("high retry rate", "retries", ">", 0.5, 900), ("high deadline exceeded rate", "deadline", ">", 0.1, 600), ("low success rate", "success", "<", 0.9, 600), ("high shed rate", "shed", ">", 0.1, 600))
REASONS = ("gate_closed", "quota_exhausted", "dropped", "error")


def histogram(df: DataFrame, keys: list[str], value: str, bounds) -> DataFrame:
    """Cumulative buckets per key: (le, n), with sum and count; le is null for the last, unbounded bucket."""
    named = {f"b{i}": F.count_if(F.col(value) <= b) for i, b in enumerate(bounds)}
    agg = df.groupBy(*keys).agg(*(c.alias(n) for n, c in named.items()), F.sum(value).alias("total"), F.count(value).alias("count"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("le"), F.col("count").alias("n")))
    return agg.select(*keys, "total", "count", F.inline(rows))


def quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation within the bucket of rank q * count; the last finite bound beyond it, null without observations."""
    order = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    b = buckets.withColumns({"low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(order), F.lit(0)), "rank": F.col("count") * q})
    hit = b.where((F.col("n") >= F.col("rank")) & (F.col("count") > 0)).groupBy(*keys).agg(F.min_by(F.struct("le", "low", "n", "below", "rank"), F.coalesce("le", F.lit(float("inf")))).alias("h"))
    inside = F.col("h.low") + (F.col("h.le") - F.col("h.low")) * F.try_divide(F.col("h.rank") - F.col("h.below"), F.col("h.n") - F.col("h.below"))
    return hit.select(*keys, F.when(F.col("h.le").isNull(), F.col("h.low")).otherwise(F.coalesce(inside, F.col("h.low"))).alias("value"))


def gauge(df: DataFrame, keys: list[str], up: str, down: str, width: int) -> DataFrame:
    """Running gauge per tick from intervals: +1 at `up`, -1 at `down`."""
    steps = df.select(*keys, F.inline(F.array(F.struct(F.col(up).alias("at"), F.lit(1).alias("d")), F.struct(F.col(down).alias("at"), F.lit(-1).alias("d")))))
    per = steps.groupBy(*keys, (F.col("at") - F.col("at") % width).alias("tick")).agg(F.sum("d").alias("d"))
    return windows.running(per, keys, "tick", [], level=F.col("d")).select(*keys, "tick", "level")


def rate(df: DataFrame, keys: list[str], time: str, value: str, width: int) -> DataFrame:
    """Increase per second of a counter in each window of `width` seconds; a fall is a reset to 0.

    Increases count where they are seen, without extrapolation to the window's edges.
    """
    d = windows.previous(df, keys, time, [], {"_v": value})
    step = F.when(F.col("_v").isNull(), 0.0).when(F.col(value) >= F.col("_v"), F.col(value) - F.col("_v")).otherwise(F.col(value)).cast("double")
    return d.groupBy(*keys, (F.col(time) - F.col(time) % width).alias("start")).agg((F.sum(step) / width).alias("rate"))


def alert(df: DataFrame, keys: list[str], time: str, condition: Column, hold: int) -> DataFrame:
    """Adds session (time at which the condition came to hold without a break) and firing (it has held for `hold` seconds)."""
    d = windows.previous(df.withColumn("_c", F.coalesce(condition, F.lit(False))), keys, time, [], {"_p": "_c"})
    d = d.withColumn("_start", F.when(F.col("_c") & ~F.coalesce("_p", F.lit(False)), F.col(time)))
    d = windows.running_max(d, keys, time, "_start", "session")
    return d.withColumns({"session": F.when(F.col("_c"), F.col("session")), "firing": F.col("_c") & (F.col(time) - F.col("session") >= hold)}).drop("_c", "_p", "_start")


def _kept(df: DataFrame) -> DataFrame:
    """A table of few rows, such as one per window, written and read back: what it is made from is computed once, however often it is asked."""
    path = shared_dir(df.sparkSession, "metrics")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rate_ratios(rates: DataFrame, keys: list[str], counter: str, base: str) -> DataFrame:
    """Each counter's rate over that of `base` in the same window, null where that is 0. rates: (keys, counter, start, rate)."""
    rates = _kept(rates)
    of = rates.where(F.col(counter) == base).select(*keys, "start", F.col("rate").alias("_base"))
    return rates.where(F.col(counter) != base).join(of, [*keys, "start"]).select(*keys, counter, "start", F.try_divide("rate", "_base").alias("ratio"))


def alerts(ratios: DataFrame, keys: list[str], time: str, counter: str, ratio: str, rules=ALERT_RULES) -> DataFrame:
    """Sessions and firing state of every rule (name, counter, comparison, threshold, seconds to hold) per key. A ratio that is null meets no condition."""
    ratios = _kept(ratios)
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(c).alias("of"), F.lit(op == ">").alias("above"), F.lit(float(v)).alias("least"), F.lit(hold).alias("hold")) for n, c, op, v, hold in rules))
    x = ratios.select(*keys, time, F.col(counter).alias("_counter"), F.col(ratio).alias("_ratio"), F.explode(each).alias("_rule")).where("_rule.of = _counter")
    x = x.select(*keys, time, "_ratio", "_rule.*")
    met = F.when(F.col("above"), F.col("_ratio") > F.col("least")).otherwise(F.col("_ratio") < F.col("least"))
    out = alert(x.withColumn("met", met), [*keys, "rule"], time, F.col("met"), 0)
    firing = F.coalesce(F.col("firing") & (F.col(time) - F.col("session") >= F.col("hold")), F.lit(False))
    return out.select(*keys, "rule", time, "session", firing.alias("firing"))


def gate_gauges(evaluations: DataFrame, keys: list[str], time: str, has: str, value: str, budget: str, threshold: float) -> DataFrame:
    """Last budget, last usable value, threshold and availability of each owner's gate, with the time of its last evaluation."""
    usable = F.col(has) & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return evaluations.groupBy(*keys).agg(
        F.max_by(budget, time).alias("budget"), F.max_by(F.when(usable, F.col(value)), F.when(usable, F.col(time))).alias("value"), F.lit(float(threshold)).alias("threshold"),
        F.max_by(usable, time).alias("available"), F.max(time).alias("seen"),
    )


def source_health(log: DataFrame, keys: list[str], now: int, fresh: int = 30) -> DataFrame:
    """unhealthy: last error newer than the last success and fresh; healthy: a fresh success; else unknown. log: (keys, at, ok)."""
    agg = log.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("good"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("bad"))
    bad = F.col("bad").isNotNull() & (F.col("good").isNull() | (F.col("bad") > F.col("good"))) & (now - F.col("bad") < fresh)
    return agg.select(*keys, F.when(bad, "unhealthy").when(F.col("good").isNotNull() & (now - F.col("good") < fresh), "healthy").otherwise("unknown").alias("health"))
