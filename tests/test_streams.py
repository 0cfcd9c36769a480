"""Streams against the batch operators on the same rows."""

from pathlib import Path

from sluice.operators import ordering
from sluice.plans import catalog
from sluice.sources import queues
from sluice.streaming import processors as pr
from sluice.streaming import rounds as rd
from sluice.streaming import stateful as st
from tests.conftest import SMALL


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_stream_equals_batch_quota(spark):
    q = catalog.queries()
    assert rows(q["t1_stream_rate_limit"](spark, SMALL), "event_id", "admitted") == rows(q["a1_rate_limit"](spark, SMALL), "event_id", "admitted")


SCHEMA = "event_id long, tenant string, queue_id string, id string, created long, deadline long"


def files(spark, path, batches):
    """A stream over one file per batch, in that order, one file per micro-batch."""
    import json
    import os

    os.makedirs(path)
    for i, rows in enumerate(batches):
        name = f"{path}/{i}.json"
        Path(name).write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(path))


def test_late_rows_get_an_answer(spark, tmp_path):
    """Five files, the last one hours behind the others: a quota answers all rows, and its state lasts over files."""
    times = [1000, 50_000, 100_000, 150_000, 10]
    batches = [[{"event_id": 10 * i + j, "tenant": f"t{j % 2}", "created": t + j} for j in range(10)] for i, t in enumerate(times)]
    got = {r.event_id: r.admitted for r in st.run_available(pr.rate_limit(files(spark, tmp_path / "in", batches), "tenant", 86400, 3), "late").collect()}
    assert len(got) == 50
    assert [got[i] for i in range(10)] == [True] * 6 + [False] * 4  # three of each tenant
    assert not any(got[i] for i in range(10, 20)) and sum(got[i] for i in range(20, 30)) == 6
    held = pr.cancellation(files(spark, tmp_path / "in2", [[{"event_id": 1, "id": "a", "tenant": "tok", "created": 5}], [{"event_id": 2, "id": "a", "tenant": "tok", "created": 9}, {"event_id": 3, "id": "a", "tenant": "new", "created": 1}]]).selectExpr("id", "tenant as token", "created", "event_id", "event_id = 1 as is_cancel"))
    assert rows(st.run_available(held, "cancel"), "event_id", "cancelled") == [(2, True), (3, False)]


def test_rows_are_held_until_they_are_due(spark, tmp_path):
    import time

    now = int(time.time())
    batch = [{"event_id": i, "queue_id": "q", "created": 0, "deadline": now - 5 if i % 2 else now + 10_000} for i in range(40)]
    got = rows(st.run_available(pr.hold_until_due(files(spark, tmp_path / "in", [batch[:20], batch[20:]]), "queue_id", "deadline", buckets=3), "hold"), "event_id")
    assert got == [(i,) for i in range(1, 40, 2)]


def test_poll_rounds_carry_over(spark, tmp_path):
    batches = [[{"event_id": 100 * b + i, "queue_id": "q", "id": f"{100 * b + i}", "created": 0, "deadline": 1000 - 100 * b + i} for i in range(8)] for b in range(3)]

    def pop(waiting):
        return ordering.edf_topk(waiting, spark.createDataFrame([("q", 1.0)], "queue_id string, budget double"), 5).select("event_id", "rn")

    popped, left, _ = rd.poll_rounds(files(spark, tmp_path / "in", batches), pop, "poll", most=5, more_rounds=1, width=50)
    got = {}
    for r in popped.collect():
        got.setdefault(r["round"], []).append(r.event_id)
    assert sorted(got[0]) == [0, 1, 2, 3, 4] and sorted(got[1]) == [100, 101, 102, 103, 104] and sorted(got[2]) == [200, 201, 202, 203, 204]
    assert sorted(got[3]) == [105, 106, 205, 206, 207]
    assert sorted(r.event_id for r in left.collect()) == [5, 6, 7, 107]


def test_windows_report_rows_that_come_too_late(spark, tmp_path):
    batches = [[{"event_id": i, "queue_id": "q", "created": t}] for i, t in enumerate((7200, 90_000, 10, 200_000, 200_010))]
    counts = st.windowed_counts(files(spark, tmp_path / "in", batches).selectExpr("queue_id", "created", "cast(event_id as double) as value"), ["queue_id"], "1 hour", bounds=(0, 1))
    out, seen = st.run_observed(counts, "windows")
    assert sum(r.n for r in out.collect()) == 2 and seen["late"] == 1


def test_match_results_of_two_streams(spark, tmp_path):
    a = files(spark, tmp_path / "a", [[{"id": "x", "created": 100}], [{"id": "y", "created": 200}]]).select("id", "created")
    b = files(spark, tmp_path / "b", [[{"id": "y", "created": 260}], [{"id": "x", "created": 130}]]).selectExpr("id as request_id", "created as finished")
    assert rows(st.run_available(st.match_results(a, b), "match"), "id", "latency") == [("x", 30), ("y", 60)]


def test_prompt_match_makes_no_batch_after_the_input_and_goes_on_from_its_state(spark, tmp_path):
    import json

    a = files(spark, tmp_path / "a", [[{"id": "x", "created": 100}, {"id": "y", "created": 500}, {"id": "z", "created": 90_000_000}]]).select("id", "created")
    b = files(spark, tmp_path / "b", [[{"id": "y", "created": 560}]]).selectExpr("id as request_id", "created as finished")
    commits = lambda: len(list((tmp_path / "m" / "state" / "commits").glob("[0-9]*")))
    out = st.run_available(st.match_results(a, b), "match", path=str(tmp_path / "m"), prompt=True)
    assert rows(out, "id", "latency") == [("y", 60)] and commits() == 1
    (tmp_path / "b" / "1.json").write_text(json.dumps({"id": "z", "created": 90_000_040}) + "\n" + json.dumps({"id": "x", "created": 130}))
    out = st.run_available(st.match_results(a, b), "match", path=str(tmp_path / "m"), prompt=True)
    assert rows(out, "id", "latency") == [("x", 30), ("y", 60), ("z", 40)] and commits() == 2


def test_persisted_queues_and_configuration(spark, tmp_path):
    import pytest

    path = str(tmp_path / "queue")
    df = spark.createDataFrame([("a", 5, "q1", None), ("b", 3, "q2", None), ("", 9, "q1", "id required")], "id string, deadline long, request_queue string, reject string")
    queues.append_requests(df, path)
    queues.append_requests(df.where("id = 'a'"), path)
    assert rows(queues.pending(spark, path), "id", "score", "request_queue") == [("a", 5.0, "q1"), ("a", 5.0, "q1"), ("b", 3.0, "q2")]
    assert st.run_available(queues.pending(spark, path, stream=True, files_per_batch=1).select("id"), "pending").count() == 3
    assert queues.clear(spark, path, "request_queue", "q1") and not queues.clear(spark, path, "request_queue", "none")
    assert rows(queues.pending(spark, path), "id") == [("b",)]
    marks = spark.createDataFrame([("a", "old"), ("c", "t")], "id string, token string")
    assert rows(queues.without_stale_markers(marks, df), "id") == [("c",)]
    results = spark.createDataFrame([(f"r{i}", f"q{i % 2}", i) for i in range(10)], "id string, result_queue string, created long")
    queues.append_results(results, str(tmp_path / "results"), time="created", flush_rows=2)
    assert all(len(f.read_text().splitlines()) <= 2 for f in (tmp_path / "results").rglob("*.json")) and spark.read.json(str(tmp_path / "results")).count() == 10
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "a.json").write_text('[{"id": "p1", "url": "http://x"}, {"id": "p2", "url": "http://y", "workers": 8}]')
    cfg = queues.load_config(spark, str(tmp_path / "config"), "id string, url string, workers int", required=("url",), defaults={"workers": 64})
    assert rows(cfg, "id", "workers") == [("p1", 64), ("p2", 8)]
    (tmp_path / "config" / "b.json").write_text('{"id": "p1", "url": ""}')
    with pytest.raises(ValueError, match="p1: id given twice"):
        queues.load_config(spark, str(tmp_path / "config"), "id string, url string", required=("url",))
