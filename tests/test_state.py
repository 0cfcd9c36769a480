"""State of streams over several files: quotas, timers, markers, the sliced backlog and the transactional sink."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.operators import admission, messages, ordering
from sluice.operators.caching import cached_asof, refreshes
from sluice.sources import queues
from sluice.streaming import processors as pr
from sluice.streaming import rounds as rd
from sluice.streaming import stateful as st
from tests.test_streams import files as write_files
from tests.test_streams import rows


def files(spark, path, batches, schema):
    """A stream over one file per batch, one file per micro-batch."""
    write_files(spark, str(path), batches)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


EVENTS = "tenant string, event_id long, at long, is_release boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_releases_as_events_equal_the_batch_quota(spark, tmp_path, seed):
    """Acquires and releases over four files in any order within a file, releases also in files before their acquire's."""
    rng = random.Random(seed)
    requests = [(f"t{rng.randrange(3)}", i, i * 10 + rng.randrange(5), rng.randrange(10, 400)) for i in range(200)]
    batches = [[] for _ in range(4)]
    for tenant, i, at, held in requests:
        mine = i // 50
        batches[mine].append({"tenant": tenant, "event_id": i, "at": at, "is_release": False})
        # A release is known by the file in which the first acquire after it stands, or comes early.
        due = min(3, next((j // 50 for _, j, t, _ in requests if t >= at + held), 3))
        batches[rng.randrange(0, due + 1)].append({"tenant": tenant, "event_id": i, "at": at + held, "is_release": True})
    for b in batches:
        rng.shuffle(b)
    got = rows(st.run_available(pr.concurrency(files(spark, tmp_path / "in", batches, EVENTS), "tenant", 3, 10_000), "quota"), "event_id", "admitted")
    df = spark.createDataFrame([(t, i, at, at + held) for t, i, at, held in requests], "tenant string, event_id long, created long, done long")
    assert got == rows(admission.admit(df, key="tenant", time="created", tie="event_id", end="done", limit=3), "event_id", "admitted")
    assert 20 < sum(a for _, a in got) < 180


def test_idle_time_is_counted_from_grants_and_releases(spark, tmp_path):
    acquire = lambda i, at: {"tenant": "t", "event_id": i, "at": at, "is_release": False}
    release = lambda i, at: acquire(i, at) | {"is_release": True}
    batches = [[acquire(1, 0), acquire(2, 9)], [acquire(3, 18)], [release(1, 18), acquire(4, 18), acquire(5, 18)], [acquire(6, 27)], [acquire(7, 28), acquire(8, 28), acquire(9, 28)]]
    got = rows(st.run_available(pr.concurrency(files(spark, tmp_path / "in", batches, EVENTS), "tenant", 2, 10), "idle"), "event_id", "admitted")
    # 3: slots of 0 s and 9 s still block at 18 s; 4: one was released; 7: ten seconds after the last grant all are gone, a refusal at 27 s doesn't count.
    assert got == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, True), (8, True), (9, False)]


def test_a_release_of_an_older_attempt_frees_no_later_slot(spark, tmp_path):
    batches = [[{"tenant": "t", "event_id": 1, "at": 5, "is_release": True}], [{"tenant": "t", "event_id": 1, "at": 9, "is_release": False}, {"tenant": "t", "event_id": 2, "at": 10, "is_release": False}], [{"tenant": "t", "event_id": 3, "at": 10, "is_release": False}]]
    got = rows(st.run_available(pr.concurrency(files(spark, tmp_path / "in", batches, EVENTS), "tenant", 2, 100), "old"), "event_id", "admitted")
    assert got == [(1, True), (2, True), (3, False)]


def test_chain_over_files_equals_the_batch_chain(spark, tmp_path):
    """Where the second gate refuses, the first one's slot is given back."""
    rng = random.Random(5)
    requests = [(f"t{rng.randrange(2)}", i, i * 7, i * 7 + 120, i * 7 + rng.randrange(1, 90)) for i in range(150)]
    batches = [[{"tenant": t, "event_id": i, "at": at, "a": a, "b": b} for t, i, at, a, b in requests[k : k + 50]] for k in (0, 50, 100)]
    stream = files(spark, tmp_path / "in", batches, "tenant string, event_id long, at long, a long, b long").selectExpr("tenant", "event_id", "at", "false as is_release", "array(a, b) as ends")
    got = sorted((r.event_id, r.refused_by) for r in st.run_available(pr.chained_quotas(stream, "tenant", [6, 3], 10_000), "chain").collect())
    df = spark.createDataFrame(requests, "tenant string, event_id long, created long, a long, b long")
    want = admission.admit_chain(df, key="tenant", time="created", tie="event_id", ends=["a", "b"], limits=[6, 3])
    assert got == sorted((r.event_id, r.refused_by) for r in want.collect())
    assert {r for _, r in got} == {None, 0, 1}


def test_held_rows_fire_after_a_restart_and_the_others_stay_untouched(spark, tmp_path):
    """A hot key holds 100,000 rows for later; a restart fires the few that are due and writes little more than them."""
    path, schema = str(tmp_path / "query"), "event_id long, queue_id string, due_at long, note string"
    now = int(time.time())
    held = spark.range(100_000).selectExpr("id as event_id", "'hot' as queue_id", f"{now} + 100000 + id % 50 as due_at", "cast(null as string) as note")
    soon = spark.createDataFrame([(10**6 + i, "hot", now + 15, "soon") for i in range(20)], schema)
    held.unionByName(soon).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = lambda: pr.hold_until_due(spark.readStream.schema(schema).json(str(tmp_path / "in")), "queue_id")
    out, seen = st.run_observed(stream(), "hold", path=path)
    assert out.count() == 0 and seen["state_rows"] > 0
    state = lambda: {f: f.stat().st_size for f in Path(path, "state", "state").rglob("*") if f.is_file() and not f.name.startswith(".")}
    before = state()
    time.sleep(max(0, now + 17 - time.time()))
    spark.createDataFrame([(5, "cold", now - 9, "late"), (6, None, None, "none")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    out = st.run_available(stream(), "hold", path=path)
    assert sorted(tuple(r) for r in out.collect()) == sorted([(5, "cold", now - 9, "late"), (6, None, None, "none"), *((10**6 + i, "hot", now + 15, "soon") for i in range(20))], key=lambda r: r[0])
    changed = [size for f, size in state().items() if f not in before and f.suffix == ".changelog"]
    assert changed and sum(changed) < sum(before.values()) / 20


def test_a_marker_goes_while_a_newer_one_of_its_id_lives(spark, tmp_path):
    path, schema = str(tmp_path / "query"), "id string, token string, created long, event_id long, is_cancel boolean"
    row = lambda token, at, number, cancel=False, id_="a": (id_, token, at, number, cancel)

    def feed(*batch):
        spark.createDataFrame(list(batch), schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        return st.run_observed(pr.cancellation(spark.readStream.schema(schema).json(str(tmp_path / "in")), life=10, buckets=2), "marks", path=path)

    out, seen = feed(row("old", 100, 0, True), row("old", 105, 1), row("new", 105, 2), row("", 105, 3), row("old", 105, 4, id_=None), row("", 1, 0, True), row("old", 99, 5))
    first = seen["state_rows"]
    assert rows(out, "event_id", "cancelled") == [(1, True), (2, False), (3, False), (4, False), (5, False)] and first > 0
    out, seen = feed(row("new", 107, 0, True), row("old", 109, 6), row("old", 110, 7), row("new", 110, 8))  # by the rows' time, 10 s each
    assert rows(out.where("event_id > 5"), "event_id", "cancelled") == [(6, True), (7, False), (8, True)]
    time.sleep(12)
    for number in (9, 10):  # by the clock, both are gone after the batch that follows
        out, seen = feed(row("new", 110, number))
    assert rows(out.where("event_id = 10"), "event_id", "cancelled") == [(10, False)] and seen["state_rows"] == 0


def test_repeats_of_a_stream_come_once_and_state_is_bounded(spark, tmp_path):
    schema = "id string, token string, retry_count int"
    batches = [[{"id": f"{i}", "token": "t", "retry_count": k % 2} for i in range(30) for k in range(k0, k0 + 2)] for k0 in (0, 1, 0)]
    out, seen = st.run_observed(st.dedupe(files(spark, tmp_path / "in", batches, schema), ["id", "token", "retry_count"], "1 millisecond"), "dedupe")
    assert out.where("retry_count = 0").count() >= 30 and seen["late"] == 0
    assert seen["state_rows"] <= 60  # what came before the last batch has gone
    out, seen = st.run_observed(st.dedupe(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), ["id", "token", "retry_count"]), "dedupe")
    assert rows(out, "id", "retry_count") == sorted((f"{i}", k) for i in range(30) for k in (0, 1)) and seen["late"] == 0


WAITING = "event_id long, queue_id string, id string, deadline long"


def test_a_round_touches_only_the_slices_that_it_pops_from(spark, tmp_path):
    """3,000 rows in 100 slices, 10 popped a round: equal to the whole backlog in order, with one or two slices read."""
    rng = random.Random(2)
    deadlines = rng.sample(range(10_000), 2999)
    waiting = [{"event_id": i, "queue_id": "ab"[i % 2], "id": f"{i:05}", "deadline": d} for i, d in enumerate(deadlines)] + [{"event_id": 2999, "queue_id": "a", "id": "none"}]
    budgets = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "queue_id string, budget double")
    pop = lambda df: ordering.edf_topk(df, budgets, 10).select("event_id", "queue_id", "deadline")
    batches = [waiting[:1500] + waiting[2999:], waiting[1500:2999]]
    popped, left, touched = rd.poll_rounds(files(spark, tmp_path / "in", batches, WAITING), pop, "slices", most=10, more_rounds=2, width=100)
    pool, want = [], {}
    for round_ in range(4):
        pool += batches[round_] if round_ < 2 else []
        for q, n in (("a", 10), ("b", 5)):
            mine = sorted((r for r in pool if r["queue_id"] == q), key=lambda r: (r.get("deadline", -1), r["id"]))[:n]
            want.setdefault(round_, []).extend(r["event_id"] for r in mine)
            pool = [r for r in pool if r not in mine]
    got = {}
    for r in popped.collect():
        got.setdefault(r["round"], []).append(r.event_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(r.event_id for r in left.collect()) == sorted(r["event_id"] for r in pool)
    assert max(touched.values()) <= 3 and len(touched) == 4


def test_a_repeated_round_changes_nothing(spark, tmp_path):
    backlog = rd.Backlog(spark, str(tmp_path / "q"), "event_id long, queue_id string, deadline long")
    new = spark.createDataFrame([(i, "q", i) for i in range(20)], backlog.schema)
    pop = lambda df: df.orderBy("deadline").limit(5).select("event_id")
    backlog.play(new, 0, pop, 5)
    publish = backlog.folder.publish
    backlog.folder.publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))  # the driver goes before the manifest is there
    with pytest.raises(RuntimeError, match="lost"):
        backlog.play(new.limit(0), 1, pop, 5)
    backlog.folder.publish = publish
    backlog.play(new.limit(0), 1, pop, 5)
    backlog.play(new.limit(0), 1, pop, 5)
    assert rows(backlog.left(1), "event_id") == [(i,) for i in range(10, 20)]


def test_results_are_committed_once(spark, tmp_path):
    """A crash between write and commit, and a batch that comes again after its commit."""
    schema, path = "id string, result_queue string, created long", str(tmp_path / "out")
    batches = [[{"id": f"{b}-{i:03}", "result_queue": f"q{i % 2}", "created": 100 - i} for i in range(100)] for b in range(2)]
    files(spark, tmp_path / "in", batches, schema)

    def fails(batch_id):
        if batch_id == 1:
            raise RuntimeError("lost")

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        rd.run_results(stream(), path, order=["created", "id"], before_commit=fails)
    assert rd.read_results(spark, path, schema).count() == 100 and list(Path(path, "staged").glob("*/*"))
    got = rd.run_results(stream(), path, order=["created", "id"])
    assert got.count() == 200 and got.select("id").distinct().count() == 200
    assert not rd.write_results(got.drop("query", "batch"), path, 1, order=["created"]) and rd.read_results(spark, path, schema).count() == 200
    for f in Path(path, "out").rglob("*.parquet"):
        part = spark.read.parquet(str(f)).collect()
        assert len(part) <= 32 and [r.created for r in part] == sorted(r.created for r in part)


def test_topic_messages_resume_and_bad_ones_are_kept(spark, tmp_path):
    def feed(name, *messages_):
        Path(tmp_path, "in").mkdir(exist_ok=True)
        Path(tmp_path, "in", name).write_text("\n".join(messages_))

    def run():
        stream = queues.messages(spark, str(tmp_path / "in"), stream=True, files_per_batch=1)
        return rd.run_tables(stream, {"good": messages.read_topic, "bad": messages.malformed_topic}, str(tmp_path / "q"))

    feed("a.json", '{"msg_id": "1", "data": "{\\"id\\": \\"x\\", \\"metadata\\": {\\"k\\": \\"body\\"}}", "attributes": {"k": "attr"}, "delivery_attempt": 3}', '{"msg_id": "2", "data": "{bad"}')
    out = run()
    assert [(r.msg_id, r.id, r.metadata, r.retry_count) for r in out["good"].collect()] == [("1", "x", {"k": "attr"}, 2)]
    feed("b.json", '{"msg_id": "3", "data": "{\\"created\\": 1}"}', '{"msg_id": "4", "data": "{\\"id\\": \\"y\\"}"}', '{"msg_id": "5"}')
    out = run()
    assert rows(out["good"], "msg_id", "retry_count") == [("1", 2), ("4", 0)]
    assert rows(out["bad"], "msg_id", "reject") == [("2", "not JSON"), ("3", "no id"), ("5", "not JSON")]


@pytest.mark.parametrize("width", [None, 40, 7])
def test_cached_samples_equal_a_row_loop(spark, width):
    """A hot pool without pauses, one with pauses, a null one; slices shorter and longer than the cache's life."""
    rng = random.Random(8)
    reads = [(i, rng.choice(["hot", "hot", "hot", "calm", None]), rng.randrange(600) * (1 if i % 2 else 2)) for i in range(500)] + [(1000, "hot", None)]
    samples = [(p, t, float(rng.randrange(100))) for p in ("hot", "calm", None) for t in rng.sample(range(1200), 60)]
    r = spark.createDataFrame(reads, "event_id long, pool string, created long")
    s = spark.createDataFrame(samples, "pool string, created long, value double")
    want = {}
    for pool in ("hot", "calm", None):
        expiry = at = found = None
        for t, i in sorted((t, i) for i, p, t in reads if p == pool and t is not None):
            if expiry is None or t >= expiry:
                expiry, at = t + 25, t
                found = max(((u, v) for p, u, v in samples if p == pool and u <= t), default=(None, None))
            want[i] = (at, *found)
    got = {x.event_id: (x.refreshed_at, x.at, x.value) for x in cached_asof(r, s, ["pool"], "created", ["value"], 25, width=width).collect()}
    assert got.pop(1000) == (None, None, None) and got == want
    assert refreshes(r.limit(0), ["pool"], "created", 25).count() == 0


@pytest.mark.parametrize(("limits", "seed"), [([4], 1), ([9], 2), ([6, 3], 3)])
def test_a_key_without_pauses_is_replayed_in_stretches(spark, limits, seed):
    """Load swings around the limit, so that there is always a live request: many stretches, the answers of one replay."""
    rng = random.Random(seed)
    at, requests = 0, []
    for i in range(1500):
        at += rng.choice([0, 1, 1, 2, 9] if (i // 100) % 2 else [5, 9, 12])
        requests.append((None if seed == 2 else "hot", i, at, at + rng.randrange(0, 60), None if i % 50 == 7 else at + rng.randrange(1, 40)))
    df = spark.createDataFrame(requests, "tenant string, event_id long, created long, a long, b long")
    ends = ["a", "b"][: len(limits)]
    run = lambda n: {r.event_id: r.refused_by for r in admission.admit_chain(df, key="tenant", time="created", tie="event_id", ends=ends, limits=limits, replay_rows=n).collect()}
    want = run(10**6)
    assert run(100) == want and len(want) == 1500 and 30 < sum(v is not None for v in want.values()) < 1470
    rows_ = df.select(F.lit("c").alias("chunk_key"), F.col("created").alias("t"), F.col("event_id").alias("row_id"), *(F.col(e).alias(f"e{i}") for i, e in enumerate(ends)))
    cut = admission.stretches(rows_, limits).groupBy("chunk_key").count().collect()
    assert len(cut) > 5 and max(r["count"] for r in cut) < 800


def test_slices_narrow_for_a_hot_key(spark, monkeypatch):
    """The width follows the fullest key's rows; sums carry over whatever it is."""
    from sluice.operators import windows

    df = spark.range(2000).selectExpr("if(id % 10 = 0, 'calm', 'hot') as k", "id * 43 % 86400 as t", "id")
    assert windows.width_of(df, ["k"], "t", None) == windows.DAY and windows.width_of(df, ["k"], "t", 60) == 60
    width = windows.width_of(df, ["k"], "t", None, rows=100)
    assert width < windows.DAY / 10
    per = windows.sliced(df, ["k"], "t", width).groupBy("_g").count().agg(F.max("count")).first()[0]
    assert per < 200
    run = lambda w: rows(windows.running(df, ["k"], "t", ["id"], width=w, n=F.col("id")), "k", "id", "n")
    assert run(width) == run(None)


@pytest.mark.parametrize("replay_rows", [100, 1_000_000])
def test_quotas_shuffle_short_keys_once_and_keep_columns(spark, replay_rows):
    """Keys of few rows are replayed after one shuffle and no join; null keys, a long key and columns that go along come out right."""
    rows_ = [(None if i % 7 == 0 else "hot" if i % 7 < 4 else f"k{i % 50}", i // 3, i, i // 3 + 5 + i % 4, f"note {i}") for i in range(700)]
    df = spark.createDataFrame(rows_, "k string, t long, i long, e long, note string")
    found = admission.admit(df, key="k", time="t", tie="i", end="e", limit=2, keep=("k", "note"), replay_rows=replay_rows)
    live, want = {}, {}
    for k, t, i, e, _ in rows_:
        held = live[k] = [x for x in live.get(k, []) if x > t]
        want[i] = len(held) < 2
        if want[i]:
            held.append(e)
    got = found.collect()
    assert {r.i: r.admitted for r in got} == want and len(got) == 700
    assert all((r.k, r.note) == (rows_[r.i][0], f"note {r.i}") for r in got)
    if replay_rows > 700:
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange ") == 1 and "Join" not in plan and "Window" not in plan


class FakeMap:
    """Map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._call(bool(self.held))

    def getValue(self, k):
        return self._call(self.held.get(k))

    def updateValue(self, k, v):
        self._call(self.held.__setitem__(k, v))

    def iterator(self):
        return self._call(iter(list(self.held.items())))


class FakeAlarm:
    def __init__(self):
        self.at = self

    def exists(self):
        return True


class FakeTime:
    def getCurrentProcessingTimeInMs(self):
        return 0

    getCurrentWatermarkInMs = getCurrentProcessingTimeInMs


def test_streams_ask_their_state_once_a_key_or_bucket():
    """Calls for state, each of which goes to the JVM, don't grow with the slots of a key or the requests of a bucket."""
    import pandas as pd

    quotas = pr.Quotas([50], 1000)
    quotas.keys, quotas.alarm = FakeMap(), FakeAlarm()
    part = pd.DataFrame({"key": "k", "at": range(100), "is_release": False, "event_id": range(100), "ends": [[None]] * 100})
    for _ in range(2):
        (out,) = quotas.handleInputRows(None, iter([part[:50], part[50:]]), FakeTime())
    assert len(out) == 100 and quotas.keys.calls <= 6
    marks = pr.Markers(1000)
    marks.marks, marks.alarm = FakeMap(), FakeAlarm()
    part = pd.DataFrame({"id": [str(i) for i in range(100)], "token": "t", "created": range(100), "event_id": range(100), "is_cancel": [i == 7 for i in range(100)]})
    (out,) = marks.handleInputRows(None, iter([part]), FakeTime())
    (again,) = marks.handleInputRows(None, iter([part.assign(is_cancel=False)]), FakeTime())
    assert marks.marks.calls <= 5 and len(out) == 99 and again["cancelled"].tolist() == [i == 7 for i in range(100)]
