"""Headers, labels and the engine's lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.maps import overlay, without


# Fixed value: name of the header that carries a queue's objective.
OBJECTIVE_HEADER = "x-gateway-inference-objective"


def build_headers(objective: Column, caller: Column) -> Column:
    """Content type, then the objective if there is one, then the caller's headers, which win."""
    base = F.create_map(F.lit("Content-Type"), F.lit("application/json"))
    own = F.when(objective != "", F.create_map(F.lit(OBJECTIVE_HEADER), objective))
    return overlay(overlay(base, own), caller)


def stamp_fairness(headers: Column, attribute: Column, name: str, most: int = 256) -> Column:
    """The attribute as a header in place of every case variant; untouched where it is empty, long or not legal in a header."""
    legal = attribute.isNotNull() & (attribute != "") & (F.octet_length(attribute) <= most) & ~attribute.rlike(r"[\x00-\x08\x0A-\x1F\x7F]")
    return F.when(legal, overlay(without(headers, F.lit(name)), F.create_map(F.lit(name), attribute))).otherwise(headers)


def label_match(labels: Column, wanted: Column) -> Column:
    """Whether all wanted pairs hold; a missing label equals ''."""
    return F.forall(F.map_entries(wanted), lambda e: F.coalesce(labels[e["key"]], F.lit("")) == e["value"])


def join_queue_config(df: DataFrame, cfg: DataFrame) -> DataFrame:
    """Configuration of each row's queue; an unknown queue has an empty pool. Spark broadcasts the configuration if its size allows it."""
    return df.join(cfg, "queue_id", "left").withColumn("pool", F.coalesce("pool", F.lit("")))


def join_pool_config(df: DataFrame, pools: DataFrame, names: list[str]) -> DataFrame:
    """Pool settings; raises where a row names a pool that isn't configured."""
    known = F.when(F.col("pool").isin(names), F.col("pool")).otherwise(F.raise_error(F.concat(F.lit("unknown pool "), "pool")))
    return df.withColumn("pool", known).join(pools, "pool")


def not_cancelled(df: DataFrame, cancels: DataFrame) -> DataFrame:
    """Rows without a cancel marker of their id and token; empty ids and tokens are never cancelled."""
    marks = cancels.where("id <> '' and token <> ''").select("id", "token")
    return df.join(marks, ["id", "token"], "left_anti")


def latest_generation(df: DataFrame) -> DataFrame:
    """Active token of each id: that of its last submission."""
    return df.where("id <> ''").groupBy("id").agg(F.max_by("token", F.struct("created", "event_id")).alias("token"))


def mark_cancelled(commands: DataFrame, submissions: DataFrame) -> DataFrame:
    """Markers (id, token) that cancel commands bind to: the active token only; unknown and empty ids do nothing."""
    return latest_generation(submissions).join(commands.where("id <> ''").select("id"), "id", "left_semi")


def ticks(requests: DataFrame, width: int = 3600) -> DataFrame:
    """Metric samples per pool and tick."""
    return requests.groupBy(F.col("queue_id").alias("pool"), (F.col("created") - F.col("created") % width).alias("tick")).agg(
        F.sum("value").alias("queue_size"), F.avg("value").alias("avg_size"), F.sum("k").alias("running"), F.count("*").alias("n")
    )


def join_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join of two tables with one row per key each; raises if the right one has more."""
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in right.columns if c not in keys))
    checked = one.withColumn("_n", F.when(F.col("_n") == 1, 1).otherwise(F.raise_error(F.lit("more than one row for a key"))))
    return left.join(checked.where("_n = 1").drop("_n"), keys)
