"""Admission that depends on earlier admissions: sliding-window and concurrency quotas.

A request is admitted while fewer than `limit` admitted ones of its key are live; refused ones take no slot, so no window function
gives the answer: requests are replayed. Rows stream through a task in order of (key, time), with at most `limit` live ends in memory, after one shuffle.

Only the rows of keys of more than `replay_rows` rows are cut before. The answer restarts wherever no earlier request of the key can still be live. Those points are found by a running
maximum over time slices, and the chunks between them are replayed independently: a hot key is as many groups as it has pauses.

A chunk of more than `replay_rows` rows is cut further. A request at which fewer than `limit` earlier ones are live, admitted or not, is sure to be
admitted; a running count of starts and ends finds these without a replay. Only stretches of the others are replayed, each from a time at which no unsure request is live: what is live then are
sure ones, fewer than the slots, and they go along. So only a key that stays at its limit without a break passes one task, in bounded memory.

Null keys are one key. Rows without a time come first; rows without an end hold no slot.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import windows
from sluice.sources.queues import shared_dir


def chunked(df: DataFrame, key: str, time: str, tie: str, end: str, width: int | None = None) -> DataFrame:
    """Adds `chunk`, the (time, tie) of the row at which the key's history last restarted."""
    order = [time, tie]
    df, before = windows.sliced(df, [key], time, windows.width_of(df, [key], time, width)), windows.before([key])
    ends = df.groupBy("_g").agg(F.max(end).alias("_e"))
    ends = ends.select("_g", F.max("_e").over(before).alias("_carry"))
    inner = windows.within(*order)
    seen = F.greatest(F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    df = df.join(ends, "_g").withColumn("_start", F.when(seen.isNull() | (seen <= F.col(time)), F.struct(*order)))
    lasts = df.groupBy("_g").agg(F.max("_start").alias("_l"))
    lasts = lasts.select("_g", F.max("_l").over(before).alias("_from"))
    here = F.max("_start").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return df.join(lasts, "_g").withColumn("chunk", F.coalesce(here, F.col("_from"))).drop("_g", "_carry", "_start", "_from")


def stretches(rows: DataFrame, limits: list[int]) -> DataFrame:
    """Rows of long chunks (chunk_key, t, row_id, e0, ..), cut into stretches: with sure, and copies of sure rows for every stretch at which they are live.

    Adds to chunk_key the number of the stretch, and own: whether the row's verdict comes from this copy. Rows that no stretch needs keep their own copy.
    """
    gates, key = range(len(limits)), ["chunk_key"]
    holds = [F.coalesce(F.col(f"e{i}") > F.col("t"), F.lit(False)).cast("long") for i in gates]
    starts = rows.select("chunk_key", "t", F.lit(1).alias("kind"), "row_id", *(h.alias(f"d{i}") for i, h in zip(gates, holds, strict=True)), *(h.alias(f"h{i}") for i, h in zip(gates, holds, strict=True)))
    events = starts
    for i in gates:
        zero = lambda n: [F.lit(-1 if j == i and n == "d" else 0).cast("long").alias(f"{n}{j}") for j in gates]  # noqa: B023, E731
        events = events.unionByName(rows.where(holds[i] == 1).select("chunk_key", F.col(f"e{i}").alias("t"), F.lit(0).alias("kind"), "row_id", *zero("d"), *zero("h")))
    width = windows.width_for(rows, key, "t")
    live = windows.running(events, key, "t", ["kind", "row_id"], width=width, **{f"n{i}": F.col(f"d{i}") for i in gates}).where("kind = 1")
    sure = F.lit(True)
    for i, limit in zip(gates, limits, strict=True):
        sure &= F.col(f"n{i}") - F.col(f"h{i}") < limit
    rows = rows.withColumn("end", F.greatest(*(F.col(f"e{i}") for i in gates)) if len(limits) > 1 else F.col("e0")).join(live.select("chunk_key", "row_id", "t", sure.alias("sure")), ["chunk_key", "row_id", "t"])
    # A stretch begins at the time of an unsure row at which none from before is live.
    at = rows.groupBy("chunk_key", "t").agg(F.max(F.when(~F.col("sure"), F.col("end"))).alias("dirty"), F.max(~F.col("sure")).alias("some"))
    at = windows.previous(windows.running_max(at, key, "t", "dirty", "until", width=width), key, "t", [], {"before": "until"}, width=width)
    begins = at.where(F.col("some") & (F.col("before").isNull() | (F.col("before") <= F.col("t")))).select("chunk_key", "t")
    begins = windows.ranked(begins, key, "t", [], name="stretch", width=width)
    found = windows.asof(rows, begins, key, "t", ["stretch"], width=width).withColumnsRenamed({"stretch": "here", "t": "began", "at": "_"}).drop("_")
    found = windows.asof(found.withColumn("t", F.coalesce("end", "began")), begins, key, "t", ["stretch"], width=width)
    last = F.when(F.col("at") == F.col("end"), F.col("stretch") - 1).otherwise(F.col("stretch"))
    first = F.coalesce("here", F.lit(0).cast("long"))
    span = F.when(F.col("sure") & F.col("end").isNotNull(), F.sequence(first, F.greatest(first, F.coalesce(last, first)))).otherwise(F.array(first))
    found = found.select("chunk_key", F.col("began").alias("t"), "row_id", *(f"e{i}" for i in gates), first.alias("first"), F.explode(span).alias("stretch"))
    return found.select(F.concat_ws("/", "chunk_key", "stretch").alias("chunk_key"), "t", "row_id", *(f"e{i}" for i in gates), (F.col("stretch") == F.col("first")).alias("own"))


def _replay(limits: list[int]):
    """Batches of chunk_key, t, row_id, own, the gates' ends, and columns that go along."""

    def run(batches):
        chunk, live = object(), []
        for b in batches:
            refused = []
            for c, t, *ends in zip(*(b.column(n).to_pylist() for n in ("chunk_key", "t", *(f"e{i}" for i in range(len(limits))))), strict=True):
                if c != chunk:
                    chunk, live = c, [[] for _ in limits]
                by = None
                for i, (slots, limit) in enumerate(zip(live, limits, strict=True)):
                    while slots and t is not None and slots[0] <= t:
                        heapq.heappop(slots)
                    if by is None and len(slots) >= limit:
                        by = i
                if by is None:  # slots are taken only where no gate refuses, so there is nothing to roll back
                    for slots, e in zip(live, ends, strict=True):
                        if e is not None and e == e:
                            heapq.heappush(slots, e)
                refused.append(by)
            more = b.schema.names[4 + len(limits) :]
            out = pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(refused, pa.int32()), *(b.column(n) for n in more)], names=["row_id", "refused_by", *more])
            yield out.filter(b.column("own"))

    return run


def admit_chain(df: DataFrame, *, key: str, time: str, tie: str, ends: list[str], limits: list[int], keep: tuple[str, ...] = (), replay_rows: int = 1_000_000) -> DataFrame:
    """(tie, refused_by) of each row before a chain of quotas of one key, asked in order; refused_by is the first that refuses, null if none does. Columns to `keep` go along.

    Gate i gives `limits[i]` slots, each held from `time` until `ends[i]`. A refused request holds no slot of any gate. A key of at most `replay_rows` rows is replayed as it is; a longer one is cut into chunks, and
    a chunk of more rows than that into stretches.
    """
    spark, along = df.sparkSession, [f"k{i}" for i in range(len(keep))]
    held = [F.col(time).alias("t"), F.col(tie).cast("long").alias("row_id"), F.lit(True).alias("own"), *(F.col(e).alias(f"e{i}") for i, e in enumerate(ends)), *(F.col(c).alias(n) for c, n in zip(keep, along, strict=True))]
    short = lambda rows: rows.select(F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).alias("chunk_key"), *held)
    rows, hot = short(df), None
    if df.count() > replay_rows:  # else no key has that many
        path = shared_dir(spark, "admission")
        df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > replay_rows).select("_key").write.parquet(f"{path}/long")
        hot = spark.read.schema(df.select(F.col(key).alias("_key")).schema).parquet(f"{path}/long")
    if hot is not None and not hot.isEmpty():
        among = F.col(key).eqNullSafe(F.col("_key"))
        long_ = df.join(hot, among, "left_semi").withColumn("_end", F.greatest(*ends) if len(ends) > 1 else F.col(ends[0]))
        c = chunked(long_.select(*dict.fromkeys([key, time, tie, *ends, *keep]), "_end"), key, time, tie, "_end")
        c = c.select(F.sha2(F.to_json(F.struct(key, "chunk")), 256).alias("chunk_key"), *held)
        c.write.parquet(f"{path}/chunks")
        c = spark.read.schema(c.schema).parquet(f"{path}/chunks")
        over = c.groupBy("chunk_key").agg(F.count("*").alias("n"), F.count("t").alias("timed")).where((F.col("n") > replay_rows) & (F.col("n") == F.col("timed"))).select("chunk_key")
        cut = c.join(over, "chunk_key", "left_semi")
        pieces = stretches(cut.drop("own", *along), limits)
        if keep:
            pieces = pieces.join(cut.select("row_id", *along), "row_id")
        rows = short(df.join(hot, among, "left_anti")).unionByName(c.join(over, "chunk_key", "left_anti")).unionByName(pieces)
    ordered = rows.repartition("chunk_key").sortWithinPartitions("chunk_key", "t", "row_id")
    types = "".join(f", {n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, along, strict=True))
    found = ordered.mapInArrow(_replay(limits), f"row_id long, refused_by int{types}")
    return found.select(F.col("row_id").alias(tie), "refused_by", *(F.col(n).alias(c) for c, n in zip(keep, along, strict=True)))


def admit(df: DataFrame, *, key: str, time: str, tie: str, end: str, limit: int, keep: tuple[str, ...] = (), replay_rows: int = 1_000_000) -> DataFrame:
    """(tie, admitted) of each row, with the columns to `keep`; a slot is held from `time` until `end`, and is free at `end`.

    A sliding window of w seconds is the case end = time + w.
    """
    found = admit_chain(df, key=key, time=time, tie=tie, ends=[end], limits=[limit], keep=keep, replay_rows=replay_rows)
    return found.select(tie, *keep, F.col("refused_by").isNull().alias("admitted"))


def pool_gate(requests: DataFrame, ticks: DataFrame, key: str, time: str, deadline: str, timeout: int) -> DataFrame:
    """Adds outcome, reason and at of each request that waits before a pool's gate.

    ticks: (key, time, verdict, failed), one row per evaluation of the gate. A request asks at its arrival (the gate's last evaluation
    up to then; a gate not yet evaluated is open) and, while the verdict is WAIT, at each later evaluation, until one differs or its effective deadline (its own,
    and at most `timeout` after arrival) passes. outcome: dispatch, result (dropped), requeue (refused, without back-off), or the error
    codes GATE_ERROR and DEADLINE_EXCEEDED; reason is the decision counted for it; at is the time of the deciding evaluation.
    """
    gate = ticks.select(key, time, F.col("verdict").alias("_verdict"), F.coalesce("failed", F.lit(False)).alias("_failed"))
    now = windows.asof(requests, gate, [key], time, ["_verdict", "_failed"]).withColumnsRenamed({"at": "_at", "_verdict": "_now", "_failed": "_now_failed"})
    later = gate.where("_failed or _verdict <> 'WAIT'")
    found = windows.asof(now, later, [key], time, ["_verdict", "_failed"], forward=True)
    waits = (F.col("_now") == "WAIT") & ~F.col("_now_failed")
    until = F.least(F.when(F.col(deadline) > 0, F.col(deadline)), F.col(time) + timeout)
    in_time = F.coalesce(F.col("at") < until, F.lit(False))
    verdict = F.when(F.coalesce(waits, F.lit(False)), F.when(in_time, F.col("_verdict"))).otherwise(F.coalesce("_now", F.lit("CONTINUE")))
    failed = F.coalesce(F.when(waits, in_time & F.col("_failed")).otherwise(F.col("_now_failed")), F.lit(False))
    outcome = (
        F.when(F.col(time) >= until, "DEADLINE_EXCEEDED").when(failed, "GATE_ERROR").when(verdict.isNull(), "DEADLINE_EXCEEDED")
        .when(verdict == "DROP", "result").when(verdict == "REFUSE", "requeue").otherwise("dispatch")
    )
    at = F.when(outcome != "DEADLINE_EXCEEDED", F.when(waits, F.col("at")).otherwise(F.col(time)))
    closed = F.when(F.col("class") == "overflow", "quota_exhausted").otherwise("gate_closed") if "class" in requests.columns else F.lit("gate_closed")
    reason = F.when(outcome == "GATE_ERROR", "error").when(outcome == "result", "dropped").when((outcome == "requeue") | F.coalesce(waits, F.lit(False)), closed)
    return found.select(*requests.columns, outcome.alias("outcome"), reason.alias("reason"), at.alias("at"))


def wait_for_open(requests: DataFrame, ticks: DataFrame, key: str, time: str, deadline: str) -> DataFrame:
    """Adds open_at: the first open tick of the key in [time, deadline), null if the deadline passes first.

    ticks: (key, time, open), far fewer than the requests.
    """
    found = windows.asof(requests, ticks.where("open").select(key, time), [key], time, [], forward=True)
    return found.withColumn("open_at", F.when(F.col("at") < F.col(deadline), F.col("at"))).drop("at")
