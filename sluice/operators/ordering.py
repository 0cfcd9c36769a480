"""Earliest deadline first, priority lanes and fair interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import windows

#: Registered orders of ready requests by name: functions of a DataFrame that give sort columns.
POLICIES = {"random-robin": lambda df: [F.md5(F.concat(F.lit("0"), df["id"]))], "edf": lambda df: [df["deadline"], df["id"]]}


def register_merge_policy(name: str, order) -> None:
    """Make an order (a function of a DataFrame that gives sort columns) available by name."""
    POLICIES[name] = order


def merge(queues: list[DataFrame], pools: list[str], policy: str = "random-robin", pool: str = "pool", take: int | None = None) -> DataFrame:
    """The requests of several queues as one table per pool, in the order of a registered policy.

    Queues without a pool belong to `default`; one of a pool that isn't in `pools` fails. Adds `turn`, the place within the pool, for the
    first `take` requests of each pool (a literal bound that prunes each partition before the shuffle); without it all rows, sorted by pool
    and order over ranges, so that no pool is one task, and no turn.
    """
    rows = queues[0]
    for q in queues[1:]:
        rows = rows.unionByName(q, allowMissingColumns=True)
    name = F.coalesce(F.nullif(pool, F.lit("")), F.lit("default"))
    rows = rows.withColumn(pool, F.when(name.isin(pools), name).otherwise(F.raise_error(F.concat(F.lit("unknown pool "), name))))
    order = POLICIES[policy](rows)
    if take is None:
        return rows.orderBy(pool, *order)
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(pool).orderBy(*order))).where(F.col("turn") <= take)


def edf_topk(df: DataFrame, budgets: DataFrame, batch: int, queue: str = "queue_id") -> DataFrame:
    """Up to floor(batch * budget) requests per queue, earliest deadline first, ties by id.

    The literal bound prunes each partition to `batch` rows per queue before the shuffle. A queue without a budget row is open.
    """
    top = df.withColumn("rn", F.row_number().over(Window.partitionBy(queue).orderBy("deadline", "id"))).where(F.col("rn") <= batch)
    allowed = F.floor(F.lit(float(batch)) * F.coalesce("budget", F.lit(1.0)))
    return top.join(budgets, queue, "left").where(F.col("rn") <= allowed).drop("budget")


def lane(cls: Column, tier: Column) -> Column:
    """0 to 5: reserved before overflow, then interactive, async, batch."""
    return (F.when(cls == "reserved", 0).otherwise(3) + F.when(tier == "interactive", 0).when(tier == "async", 1).otherwise(2)).cast("int")


def lane_round_robin(df: DataFrame, pool: str, lane_col: str, channel: str, time: str, tie: str) -> DataFrame:
    """Adds rr (turn within lane and channel) and first_seen (of the channel in the lane).

    The order is (lane, rr, first_seen, channel); sort by range on it rather than by one window per pool.
    """
    out = windows.ranked(df, [pool, lane_col, channel], time, [tie], "rr")
    seen = df.groupBy(pool, lane_col, channel).agg(F.min(F.struct(time, tie)).alias("first_seen"))
    return out.join(seen, [pool, lane_col, channel])


def random_robin(df: DataFrame, seed: str, id_col: str = "id") -> DataFrame:
    """Adds the sort key of a reproducible random pick among ready requests."""
    return df.withColumn("pick", F.md5(F.concat(F.lit(seed), id_col)))


def byte_cap(capacity: float, budget: float, baseline: float) -> float:
    """Size that a round may take: the system's capacity times what the budget leaves above its baseline."""
    return capacity * max(0.0, budget - baseline)


def byte_budget_prefix(df: DataFrame, queue: str, time: str, tie: str, size: str, cap: float) -> DataFrame:
    """The prefix of each queue whose sizes (not negative) add up to at most `cap`, with the sum in `upto`. A request that doesn't fit ends it."""
    return windows.running(df, [queue], time, [tie], upto=cap, total=F.coalesce(F.col(size), F.lit(0))).withColumnRenamed("total", "upto")
