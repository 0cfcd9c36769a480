"""Verdicts on single messages: CONTINUE, REFUSE, WAIT or DROP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: body of the result of a dropped interactive request.
DROP_BODY = '{"error": "Too Many Requests", "code": 429}'


def quota_class(admitted: Column) -> Column:
    return F.when(admitted, "reserved").otherwise("overflow")


def quota_verdict(admitted: Column, blocking: bool) -> Column:
    """A blocking quota refuses overflow; a classifying one only tags it."""
    return F.when(~admitted, "REFUSE").otherwise("CONTINUE") if blocking else F.lit("CONTINUE")


def quota_key(labels: Column, prefix: str, attribute: str) -> Column:
    """Key of a message's quota, null if the attribute is absent; a present but empty one is a key."""
    return F.when(F.map_contains_key(labels, attribute), F.concat(F.lit(f"{prefix}{attribute}:"), labels[attribute]))


def tier_admission(inner: Column, cls: Column, tier: Column) -> Column:
    """Only a refusal of the inner gate counts as saturated; then reserved waits, interactive overflow is dropped, the rest is refused."""
    return F.when(inner != "REFUSE", "CONTINUE").when(cls == "reserved", "WAIT").when((cls == "overflow") & (tier == "interactive"), "DROP").otherwise("REFUSE")


def wait_on_refuse(inner: Column) -> Column:
    return F.when(inner == "REFUSE", "WAIT").otherwise(inner)


def gate_chain(verdicts: list[Column]) -> Column:
    """The first verdict that isn't CONTINUE. Gates with state go through `admission.admit_chain`, which takes no slot of an earlier gate where a later one refuses."""
    return F.coalesce(*(F.nullif(v, F.lit("CONTINUE")) for v in verdicts), F.lit("CONTINUE"))


def budget_verdict(budget: Column) -> Column:
    return F.when(budget <= 0, "REFUSE").otherwise("CONTINUE")


def route(verdict: Column, level: str) -> Column:
    """What becomes of a message. At queue level WAIT goes on to dispatch; only the pool parks it."""
    wait = "park" if level == "pool" else "dispatch"
    return F.when(verdict == "REFUSE", "requeue").when(verdict == "DROP", "result").when(verdict == "WAIT", wait).otherwise("dispatch")


def decision_reason(verdict: Column, cls: Column, failed: Column) -> Column:
    return F.when(failed, "error").when(verdict == "DROP", "dropped").when(verdict == "REFUSE", F.when(cls == "overflow", "quota_exhausted").otherwise("gate_closed"))


def closed_rounds(rounds: DataFrame, backlog: DataFrame, queue: str) -> DataFrame:
    """The rounds without a budget, with `counted`: whether they count as closed by the gate. Rounds of a topic always do, those of a queue if it holds requests.

    rounds: (queue, budget, topic); backlog: (queue, backlog), one row per queue that has any.
    """
    closed = rounds.where(F.col("budget") <= 0).join(backlog, queue, "left")
    return closed.withColumn("counted", F.col("topic") | (F.coalesce("backlog", F.lit(0)) > 0))
