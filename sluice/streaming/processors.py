"""State that streams keep by key: quotas, held rows and cancel markers.

All are arbitrary stateful processors over RocksDB state, which a batch changes only where something happened: a quota's slots taken
or freed, rows appended to the list of their due second, a list taken when its timer fires, a marker set. With changelog checkpoints (`with_state_store`) that is also what is written.

Time. No watermark lies on the rows' own time, because an operator with one drops rows that come later than it: here every row gets an
answer, however late. The watermark is on the time of arrival, so no row is ever behind it, and timers fire by it: as soon as a later batch (or the batch without data that
follows it) begins. A stream that must fire timers while nothing arrives sets `live`; it then runs on processing time, and never ends by itself.
Rows of a micro-batch are taken in the order of their own time; what came in an earlier batch was decided then.
"""

from __future__ import annotations

import heapq
import json
from contextlib import contextmanager
from itertools import chain, groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def with_state_store(spark: SparkSession, more: dict[str, str] | None = None):
    """The session's settings, and `more` of them, while a query starts, which takes a copy of them."""
    settings = STORE | (more or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, live: bool) -> DataFrame:
    """A processor over each key's rows."""
    rows = rows.withColumn("arrived_at", F.current_timestamp())
    if not live:
        rows = rows.withWatermark("arrived_at", "0 seconds")
    return rows.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "ProcessingTime" if live else "EventTime")


def _now(timer_values) -> int:
    return max(timer_values.getCurrentProcessingTimeInMs(), timer_values.getCurrentWatermarkInMs())


class _Alarm:
    """One timer of a key, moved instead of added."""

    def __init__(self, handle):
        self.handle, self.at = handle, handle.getValueState("alarm", "at long")

    def set(self, at: int) -> None:
        if self.at.exists():
            self.handle.deleteTimer(self.at.get()[0])
        self.handle.registerTimer(at)
        self.at.update((at,))

    def clear(self) -> None:
        if self.at.exists():
            self.handle.deleteTimer(self.at.get()[0])
        self.at.clear()


class Quotas(StatefulProcessor):
    """A chain of quotas of each key of one bucket, asked in order: gate i gives `limits[i]` slots.

    Rows: key, event_id, at, is_release, ends (when each gate's slot ends by itself; null: not before its release). A request that any gate refuses holds no slot of any: what gates before it
    had granted is taken back. A release frees all slots of its request from its time on; one that comes before its request is kept for it. At equal times releases
    come first. Slots also end once `idle` seconds have passed by the rows' time since the key's last grant or release that left others.

    A key is one entry of its bucket's state, read and written once a batch; it goes once `idle` seconds have passed by the clock.
    """

    def __init__(self, limits: list[int], idle: int):
        self.limits, self.idle = limits, idle

    def init(self, handle) -> None:
        # kept, as JSON: the slots (id, end) of each gate, early releases (id, at), and when the key was last touched.
        self.keys, self.alarm = handle.getMapState("keys", "key string", "kept string, gone long"), _Alarm(handle)

    def handleInputRows(self, key, rows, timerValues):
        parts = [list(zip(p["key"].tolist(), p["at"].tolist(), (~p["is_release"].astype(bool)).tolist(), p["event_id"].tolist(), p["ends"].tolist(), strict=True)) for p in rows]
        known, gone, out = self.keys.exists(), _now(timerValues) + self.idle * 1000, []
        for name, group in groupby(sorted(chain.from_iterable(parts), key=lambda r: r[:4]), key=lambda r: r[0]):
            found = self.keys.getValue((name,)) if known else None
            self.keys.updateValue((name,), (json.dumps(self._decide(list(group), json.loads(found[0]) if found else None, out)), gone))
        if not self.alarm.at.exists():
            self.alarm.set(gone)
        yield pd.DataFrame({"event_id": [i for i, _ in out], "refused_by": pd.array([b for _, b in out], "Int32")})

    def _decide(self, group: list[tuple], kept: list | None, out: list) -> list:
        """What is kept of a key after its rows of a batch; answers are added to `out`."""
        slots, early, touched = kept or ([[] for _ in self.limits], [], None)
        held, early = [{i: end for i, end in s} for s in slots], {i: at for i, at in early}
        due = [[(end, id_) for id_, end in h.items() if end is not None] for h in held]
        for d in due:
            heapq.heapify(d)
        for _, at, release, id_, ends in group:
            if not release:
                mine = [(h, d) for h, d in zip(held, due, strict=True) if id_ in h]
                for h, d in mine:  # its slots are free from now on, but not for rows of earlier times that are yet to come
                    if h[id_] is None or h[id_] > at:
                        h[id_] = at
                        heapq.heappush(d, (at, id_))
                if not mine:
                    early[id_] = at
                elif any(end is None or end > at for h in held for end in h.values()):
                    touched = at if touched is None else max(touched, at)
                continue
            # Releases don't move the clock: they may lie ahead of requests that are yet to come.
            if touched is not None and touched + self.idle <= at:
                held, due = [{} for _ in self.limits], [[] for _ in self.limits]
            for h, d in zip(held, due, strict=True):
                while d and d[0][0] <= at:
                    end, other = heapq.heappop(d)
                    if h.get(other) == end:
                        del h[other]
            by = next((i for i, h in enumerate(held) if len(h) >= self.limits[i]), -1)
            if by < 0:
                touched, freed = at if touched is None else max(touched, at), early.pop(id_, None)
                if freed is not None and freed <= at:  # of an older attempt
                    freed = None
                for h, d, end in zip(held, due, ends, strict=True):
                    end = None if end is None or end != end else int(end)
                    end = freed if end is None else end if freed is None else min(end, freed)
                    if end is None or end > at:
                        h[id_] = end
                        if end is not None:
                            heapq.heappush(d, (end, id_))
            else:
                early.pop(id_, None)
            out.append((id_, None if by < 0 else by))
        newest = max(r[1] for r in group)
        return [[list(h.items()) for h in held], [(i, at) for i, at in early.items() if at + self.idle > newest], touched]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _expire(self.keys, self.alarm, _now(timerValues), self.idle * 1000)
        yield pd.DataFrame({"event_id": pd.array([], "int64"), "refused_by": pd.array([], "Int32")})

    def close(self) -> None:
        pass


def _expire(entries, alarm: _Alarm, now: int, life: int) -> None:
    """Remove a bucket's entries whose last field, the time at which they go, is past, and set the alarm for the rest."""
    rest = []
    for name, value in list(entries.iterator()):
        if value[-1] <= now:
            entries.removeKey(name)
        else:
            rest.append(value[-1])
    alarm.at.clear()
    if rest:  # entries of nearly the same time go together
        alarm.set(max(min(rest), now + life // 64))


def chained_quotas(rows: DataFrame, key: str, limits: list[int], idle: int, *, buckets: int = 512, live: bool = False) -> DataFrame:
    """(event_id, refused_by) of each request before a chain of quotas of one key; refused_by is the first gate that refuses, null if none does.

    rows: key, event_id, at, is_release, ends. Releases give no row. Keys are dealt over `buckets`, which must stay the same when a stream goes on. A key's requests are decided one after another, and a task holds one bucket's rows of one micro-batch: set `maxFilesPerTrigger` to bound that.
    """
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))
    rows = rows.select(F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket"), name.alias("key"), "event_id", "at", "is_release", "ends")
    return keyed(rows, ["bucket"], Quotas(limits, idle), "event_id long, refused_by int", live)


def concurrency(events: DataFrame, key: str, limit: int, idle: int, *, live: bool = False) -> DataFrame:
    """(event_id, admitted) of acquires and releases (key, event_id, at, is_release) before a concurrency quota."""
    rows = events.withColumn("ends", F.array(F.lit(None).cast("long")))
    return chained_quotas(rows, key, [limit], idle, live=live).select("event_id", F.col("refused_by").isNull().alias("admitted"))


def rate_limit(requests: DataFrame, key: str, window: int, limit: int, *, live: bool = False) -> DataFrame:
    """(event_id, admitted) of requests (key, event_id, created) before a sliding-window quota; a key's log goes after two windows without requests."""
    rows = requests.select(key, "event_id", F.col("created").alias("at"), F.lit(False).alias("is_release"), F.array(F.col("created") + window).alias("ends"))
    return chained_quotas(rows, key, [limit], 2 * window, live=live).select("event_id", F.col("refused_by").isNull().alias("admitted"))


class Held(StatefulProcessor):
    """Rows of one due second, in a list that is only appended to until its timer takes it."""

    def init(self, handle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "row string")

    def handleInputRows(self, key, rows, timerValues):
        due = key[1] * 1000
        for part in rows:
            if due <= _now(timerValues):
                yield part[["row"]]
                continue
            if not self.rows.exists():
                self.handle.registerTimer(due)
            self.rows.appendList([(r,) for r in part["row"]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        batch = []
        for (row,) in self.rows.get():
            batch.append(row)
            if len(batch) == 10_000:
                yield pd.DataFrame({"row": batch})
                batch = []
        self.rows.clear()
        yield pd.DataFrame({"row": batch})

    def close(self) -> None:
        pass


def hold_until_due(rows: DataFrame, key: str, due: str = "due_at", buckets: int = 16, *, live: bool = False) -> DataFrame:
    """Hold rows (retries, or requests until their deadline) and emit each as it came once the clock has passed its due second; rows already due at once.

    State is keyed by (key, due second, bucket): what fires is read and removed, all else is left as it is, however much a hot key holds. A due second's rows are dealt over `buckets`. Rows
    without a due time are emitted at once. Rows travel as JSON.
    """
    # What is due already needs no key of its own.
    late = F.coalesce(F.col(due) <= F.unix_seconds(F.current_timestamp()), F.lit(True))
    dealt = rows.select(F.when(~late, F.col(key).cast("string")).alias("key"), F.when(late, 0).otherwise(F.col(due).cast("long")).alias("due"), F.to_json(F.struct(*rows.columns)).alias("row"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    out = keyed(dealt, ["key", "due", "bucket"], Held(), "row string", live)
    return out.select(F.from_json("row", rows.schema).alias("row")).select("row.*")


class Markers(StatefulProcessor):
    """Cancel markers of the generations (id, token) of one bucket, each looked up by itself."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle) -> None:
        self.marks, self.alarm = handle.getMapState("marks", "id string, token string", "until long, gone long"), _Alarm(handle)

    def _look_up(self, seen: dict) -> None:
        """Fill in the markers of the names. A lookup costs as much as reading many entries in a row, so up to 20 entries a name are read first; only if there are more is each name looked up."""
        if not self.marks.exists():
            return
        few, read = 20 * len(seen), 0
        for name, (until, _) in islice(self.marks.iterator(), few):
            read += 1
            if tuple(name) in seen:
                seen[tuple(name)] = until
        if read == few:
            for name in seen:
                found = self.marks.getValue(name) if seen[name] is None and all(name) else None
                seen[name] = found[0] if found else seen[name]

    def handleInputRows(self, key, rows, timerValues):
        part = pd.concat(list(rows), ignore_index=True)
        names = list(zip(part["id"], part["token"], strict=True))
        time, cancel, ids = part["created"].to_numpy(), part["is_cancel"].to_numpy(bool), part["event_id"].to_numpy()
        seen: dict[tuple, int | None] = dict.fromkeys(names)
        self._look_up(seen)
        marked, out = set(), []
        for i in np.lexsort((~cancel, time)):
            name = names[i]
            if not cancel[i]:
                out.append((ids[i], seen[name] is not None and bool(time[i] < seen[name])))
            elif all(name):
                seen[name] = max(seen[name] or 0, int(time[i]) + self.life)
                marked.add(name)
        gone = _now(timerValues) + self.life * 1000
        for name in marked:
            self.marks.updateValue(name, (seen[name], gone))
        if marked and not self.alarm.at.exists():
            self.alarm.set(gone)
        yield pd.DataFrame(out, columns=["event_id", "cancelled"]).astype({"event_id": "int64", "cancelled": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _expire(self.marks, self.alarm, _now(timerValues), self.life * 1000)
        yield pd.DataFrame({"event_id": pd.array([], "int64"), "cancelled": pd.array([], "bool")})

    def close(self) -> None:
        pass


def cancellation(both: DataFrame, *, life: int = 7 * 86400, buckets: int = 256, live: bool = False) -> DataFrame:
    """(event_id, cancelled) of each request. both: requests and cancel commands (id, token, created, event_id, is_cancel).

    A marker cancels requests of its id and token for `life` seconds, each marker by itself, and is one entry of its bucket's state, so an id of many
    generations is spread over the buckets; entries go `life` seconds (and at most a 64th of that more) after they came. Null and empty ids and tokens are never cancelled.
    """
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    named = (F.coalesce(F.col("id"), F.lit("")) != "") & (F.coalesce(F.col("token"), F.lit("")) != "")
    bucket = F.pmod(F.when(named, F.xxhash64("id", "token")).otherwise(F.xxhash64("event_id")), F.lit(buckets)).cast("int")
    rows = both.select(bucket.alias("bucket"), name("id"), name("token"), "created", "event_id", "is_cancel")
    return keyed(rows, ["bucket"], Markers(life), "event_id long, cancelled boolean", live)
