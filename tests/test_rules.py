"""Operators against tables of expected values."""

import math

import pytest
from pyspark.sql import functions as F

from sluice.functions import maps, scalars
from sluice.operators import admission, budget, lookups, messages, metrics, ordering, outcome, transforms, verdicts, windows


def values(spark, column, n=1):
    return [r[0] for r in spark.range(n).select(column).collect()]


def one(spark, column):
    return values(spark, column)[0]


@pytest.mark.parametrize("sat, want", [(0.0, 0.8), (0.3, 0.5), (0.79, 0.01), (0.8, 0), (0.95, 0), (1.5, 0), (-0.5, 1)])
def test_saturation(spark, sat, want):
    assert one(spark, budget.saturation(F.lit(True), F.lit(sat))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf, None])
def test_saturation_falls_back(spark, bad):
    v = F.lit(bad).cast("double")
    assert one(spark, budget.saturation(F.lit(True), v, fallback_sat=1)) == 0
    assert one(spark, budget.saturation(F.lit(True), v, fallback_sat=0)) == 1
    assert one(spark, budget.saturation(F.lit(False), F.lit(0.3), fallback_sat=1)) == 0


@pytest.mark.parametrize("d, b, want", [(0.7, 0.1, 0.6), (0.1, 0.1, 0), (0.05, 0.1, 0), (0.5, 0, 0.5)])
def test_threshold(spark, d, b, want):
    assert one(spark, budget.threshold(F.lit(True), F.lit(d), b, 0)) == pytest.approx(want)


def test_threshold_clamps_its_fallback(spark):
    assert one(spark, budget.threshold(F.lit(False), F.lit(0.5), 0, 2)) == 1
    assert one(spark, budget.threshold(F.lit(False), F.lit(0.5), 0, -1)) == 0


def test_scraped(spark):
    assert one(spark, budget.scraped(F.lit(2.0), F.lit(10), 0, F.lit(True))) == pytest.approx(0.8)
    assert one(spark, budget.scraped(F.lit(10.0), F.lit(10), 0, F.lit(True))) == 0
    assert one(spark, budget.scraped(F.lit(6.0), F.lit(30), 0, F.lit(True))) == pytest.approx(0.8)


def test_dispatch_count_rounds_down(spark):
    assert one(spark, budget.dispatch_count(10, F.lit(0.3))) == 3
    assert one(spark, budget.dispatch_count(10, F.lit(0.05))) == 0


def test_registered_gate(spark):
    budget.register_gate("half", lambda: F.lit(0.5))
    assert one(spark, budget.gate("half")) == 0.5
    assert one(spark, budget.gate("unknown")) == 1.0


def test_edf(spark):
    df = spark.createDataFrame([("low", 1000, "q"), ("high", 100, "q"), ("urgent", 50, "q")], "id string, deadline long, queue_id string")
    budgets = spark.createDataFrame([("q", 1.0)], "queue_id string, budget double")
    got = ordering.edf_topk(df, budgets, 10).orderBy("rn").select("id").collect()
    assert [r[0] for r in got] == ["urgent", "high", "low"]
    third = spark.createDataFrame([("q", 0.3)], "queue_id string, budget double")
    ten = spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("deadline"), F.lit("q").alias("queue_id"))
    assert ordering.edf_topk(ten, third, 10).count() == 3


@pytest.mark.parametrize("c, t, want", [("reserved", "interactive", 0), ("reserved", "async", 1), ("overflow", "interactive", 3), ("overflow", "batch", 5), ("", "", 5)])
def test_lane(spark, c, t, want):
    assert one(spark, ordering.lane(F.lit(c), F.lit(t))) == want


def test_round_robin(spark):
    df = spark.createDataFrame([("a1", "a", 0), ("a2", "a", 1), ("b1", "b", 2), ("b2", "b", 3)], "id string, ch string, t long").withColumns({"pool": F.lit("p"), "lane": F.lit(0)})
    got = ordering.lane_round_robin(df, "pool", "lane", "ch", "t", "id").orderBy("lane", "rr", "first_seen").select("id").collect()
    assert [r[0] for r in got] == ["a1", "b1", "a2", "b2"]


@pytest.mark.parametrize("inner, c, t, want", [("CONTINUE", "reserved", "batch", "CONTINUE"), ("REFUSE", "reserved", "interactive", "WAIT"), ("REFUSE", "overflow", "interactive", "DROP"), ("REFUSE", "overflow", "async", "REFUSE"), ("WAIT", "overflow", "batch", "CONTINUE"), ("REFUSE", "", "interactive", "REFUSE")])
def test_tier(spark, inner, c, t, want):
    assert one(spark, verdicts.tier_admission(F.lit(inner), F.lit(c), F.lit(t))) == want


def test_gate_chain_and_route(spark):
    assert one(spark, verdicts.gate_chain([F.lit("CONTINUE"), F.lit("WAIT"), F.lit("DROP")])) == "WAIT"
    assert one(spark, verdicts.route(F.lit("WAIT"), "queue")) == "dispatch"
    assert one(spark, verdicts.route(F.lit("WAIT"), "pool")) == "park"


@pytest.mark.parametrize("base, path", [("http://gateway/", "/v1/completions"), ("http://gateway", "v1/completions")])
def test_url(spark, base, path):
    assert one(spark, scalars.build_url(F.lit(base), F.lit(""), F.lit(path))) == "http://gateway/v1/completions"
    assert one(spark, scalars.build_url(F.lit("http://gateway/api"), F.lit("own"), F.lit(path))) == "http://gateway/api/own"


@pytest.mark.parametrize("attr, want", [("u", "x=u"), ("", "X=old"), ("é" * 129, "X=old"), ("a" * 256, "x=" + "a" * 256), ("a" * 257, "X=old"), ("a\x01", "X=old"), (None, "X=old")])
def test_fairness(spark, attr, want):
    h = lookups.stamp_fairness(F.create_map(F.lit("X"), F.lit("old")), F.lit(attr).cast("string"), "x")
    assert one(spark, maps.as_text(h)) == want


@pytest.mark.parametrize("left, retry, low, high", [(300, 0, 2, 4), (300, 1, 4, 8), (300, 9, 30, 60), (3, 0, 1.5, 3), (1, 0, 0.5, 1), (0, 0, 0, 0), (-5, 0, 0, 0)])
def test_backoff(spark, left, retry, low, high):
    got = values(spark, outcome.backoff(F.lit(left), F.lit(retry), F.col("id").cast("string")), 200)
    assert all(low <= v < high or v == low == high for v in got)


@pytest.mark.parametrize("hint, left, low, high", [(30, 100, 30, 37.5), (300, 40, 20, 25), (30, 5, 2.5, 5), (1, 300, 2, 4)])
def test_retry_after(spark, hint, left, low, high):
    key = F.col("id").cast("string")
    wait = outcome.backoff(F.lit(left), F.lit(0), key)
    got = values(spark, outcome.with_retry_after(wait, F.lit(hint), F.lit(left), key, F.lit(0)), 200)
    assert all(low <= v < high for v in got)


@pytest.mark.parametrize("text, want", [("120", 120), ("0", 0), ("Tue, 02 Jan 2024 00:00:00 GMT", 0), ("Wed, 02 Jan 2030 00:00:10 GMT", 1893542410 - 1705363200), ("-5", None), ("abc", None), ("", None)])
def test_parse_retry_after(spark, text, want):
    assert one(spark, outcome.parse_retry_after(F.lit(text), 1705363200, F.lit(429), F.lit(False))) == want
    assert one(spark, outcome.parse_retry_after(F.lit(text), 1705363200, F.lit(400), F.lit(False))) is None


@pytest.mark.parametrize("query, want", [("X-Goog-Date=20260618T110000Z&X-Goog-Expires=3600", 1781784000), ("Expires=99", 99), ("a=1", None), ("X-Goog-Date=bad&X-Goog-Expires=1&Expires=5", None), ("X-Goog-Date=20260618T110000Z&X-Goog-Expires=x", None)])
def test_signed_url(spark, query, want):
    assert one(spark, scalars.signed_url_expiry(F.lit(f"https://h/o?{query}"))) == want


def test_form_fields(spark):
    fields, reject = transforms.form_fields(F.lit('{"gcs_uri":"gs://a","t":0.5,"ok":true}'))
    assert one(spark, maps.as_text(fields)) == "ok=true;t=0.5;url=gs://a"
    assert one(spark, reject) is False
    assert one(spark, transforms.form_fields(F.lit('{"file_base64":"x"}'))[1]) is True


@pytest.mark.parametrize("text, reject", [("null", "empty"), (None, "empty"), ("{", "malformed"), ('{"data":{"id":"a"}}', "missing kind"), ('{"request_kind":"x","data":{"id":"a"}}', "unknown kind"), ('{"request_kind":"plain"}', "empty data"), ('{"request_kind":"plain","data":{"id":3}}', "wrong type"), ('{"request_kind":"plain","data":{"id":"a","created":"12"}}', "wrong type"), ('{"request_kind":"plain","data":{"id":"a","created":1,"deadline":2}}', None)])
def test_decode(spark, text, reject):
    df = messages.decode_envelope(spark.createDataFrame([(text,)], "value string"))
    assert df.select("reject").first()[0] == reject


def test_overlay_never_raises(spark):
    a, b = F.create_map(F.lit("k"), F.lit("1"), F.lit("z"), F.lit("2")), F.create_map(F.lit("k"), F.lit("3"))
    assert one(spark, maps.as_text(maps.overlay(a, b))) == "k=3;z=2"
    assert one(spark, maps.as_text(maps.overlay(a, F.lit(None).cast("map<string,string>")))) == "k=1;z=2"


def test_old_result_leaves_new_generation(spark):
    subs = spark.createDataFrame([("a", "t1", 1, 1), ("a", "t2", 2, 2), ("b", "t3", 1, 3)], "id string, token string, created long, event_id long")
    cmds = spark.createDataFrame([("a",), ("x",), ("",)], "id string")
    assert [tuple(r) for r in lookups.mark_cancelled(cmds, subs).collect()] == [("a", "t2")]
    reqs = subs.select("id", "token")
    assert {r.token for r in lookups.not_cancelled(reqs, lookups.mark_cancelled(cmds, subs)).collect()} == {"t1", "t3"}


def test_join_unique_fails_loudly(spark):
    one_row = spark.createDataFrame([("p", 1)], "pool string, v int")
    with pytest.raises(Exception, match="more than one row"):
        lookups.join_unique(one_row, one_row.union(one_row).withColumnRenamed("v", "w"), ["pool"]).collect()


def test_rate_limit_sequence(spark):
    rows = [(0, "t", 0), (1, "t", 0), (2, "t", 0), (3, "t", 1), (4, "t", 2)]
    df = spark.createDataFrame(rows, "event_id long, tenant string, created long").withColumn("done", F.col("created") + 1)
    got = {r.event_id: r.admitted for r in admission.admit(df, key="tenant", time="created", tie="event_id", end="done", limit=2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_chunks_change_no_answer(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, f"t{i % 3}", t, t + rnd.randint(1, 90000)) for i, t in enumerate(sorted(rnd.randint(0, 2_000_000) for _ in range(600)))]
    df = spark.createDataFrame(rows, "event_id long, tenant string, created long, done long")
    got = {r.event_id: r.admitted for r in admission.admit(df, key="tenant", time="created", tie="event_id", end="done", limit=2).collect()}
    live = {}
    for i, k, t, e in rows:
        ends = [x for x in live.get(k, []) if x > t]
        ok = len(ends) < 2
        live[k] = ends + [e] * ok
        assert got[i] == ok


def test_windows_match_plain_ones(spark):
    from pyspark.sql import Window

    df = spark.range(500).select(F.col("id").alias("i"), (F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 400_000).alias("t"), (F.col("id") % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("t", "i")
    got = windows.ranked(windows.running(df, ["k"], "t", ["i"], s=F.col("v")), ["k"], "t", ["i"])
    got = windows.previous(got, ["k"], "t", ["i"], {"p": "v"})
    want = df.withColumns({"s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(w).cast("long"), "p": F.lag("v").over(w)})
    cols = ["i", "s", "rn", "p"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_quantile_edges(spark):
    df = spark.createDataFrame([("a", 7.0), ("a", 1e9), ("b", 3.0)], "q string, v double")
    h = metrics.histogram(df, ["q"], "v", (5, 10))
    got = dict(map(tuple, metrics.quantile(h, ["q"], 0.99).collect()))
    assert got["a"] == 10.0  # beyond the last finite bound
    assert 0 < got["b"] <= 5
    assert metrics.quantile(metrics.histogram(df.where("false"), ["q"], "v", (5, 10)), ["q"], 0.5).count() == 0


def test_histogram_is_monotone(spark):
    h = metrics.histogram(spark.range(100).select(F.lit("q").alias("q"), (F.col("id") * 37 % 101).cast("double").alias("v")), ["q"], "v", metrics.INFERENCE_MS)
    n = [r.n for r in h.orderBy(F.col("le").asc_nulls_last()).collect()]
    assert n == sorted(n) and n[-1] == 100


def test_source_health(spark):
    log = spark.createDataFrame([("a", 95, True), ("a", 99, False), ("b", 95, True), ("c", 10, True)], "s string, at long, ok boolean")
    assert dict(map(tuple, metrics.source_health(log, ["s"], 100).collect())) == {"a": "unhealthy", "b": "healthy", "c": "unknown"}


def test_fixed_values():
    assert metrics.INFERENCE_MS == (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 120000)
    assert metrics.RESIDENCE_MS == (500, 1000, 2000, 5000, 10000, 30000, 60000, 120000, 300000, 600000, 1800000, 3600000, 7200000, 21600000, 43200000, 86400000)
    assert metrics.LATENCY_MS == (100, 1000, 5000, 10000, 20000, 50000, 100000, 200000, 500000, 1000000)
    assert [(r[1], r[3], r[4]) for r in metrics.ALERT_RULES] == [("retries", 0.5, 900), ("deadline", 0.1, 600), ("success", 0.9, 600), ("shed", 0.1, 600)]
    assert verdicts.DROP_BODY == '{"error": "Too Many Requests", "code": 429}'


def test_messages_as_text(spark):
    value = messages.marshal_result(F.lit("a"), F.lit(0), F.lit("p"), F.lit("E"), F.lit("m"))
    assert one(spark, value) == '{"id":"a","payload":"p","error_code":"E","error_message":"m"}'
    assert one(spark, messages.marshal_result(F.lit("a"), F.lit(200), F.lit("p"), F.lit(""), F.lit(None).cast("string"))) == '{"id":"a","status_code":200,"payload":"p"}'
    assert one(spark, outcome.error_result(F.lit("a"), F.lit("E"), F.lit("m"))) == '{"id":"a","payload":"{\\"error\\":\\"m\\"}","error_code":"E","error_message":"m"}'
    labels = messages.classify(F.create_map(F.lit("k"), F.lit("v")), F.lit("reserved"))
    routing = {"retry_count": F.lit(0), "queue_id": F.lit("q"), "labels": labels}
    assert one(spark, messages.encode_envelope(F.lit("plain"), {"id": F.lit("a")}, routing)) == '{"internal":{"queue_id":"q","labels":{"k":"v","classification":"reserved"}},"request_kind":"plain","data":{"id":"a"}}'
    none = F.lit(None).cast("string")
    assert one(spark, outcome.error_text(F.lit("SERVER_ERROR"), F.lit("status 503"), F.lit("full"), none)) == "SERVER_ERROR: status 503 (dropped: full)"
    assert one(spark, outcome.error_text(F.lit("UNKNOWN"), F.lit("sent"), none, F.lit("EOF"))) == "UNKNOWN: sent (caused by: EOF)"
    headers = lookups.build_headers(F.lit("fast"), F.create_map(F.lit("a"), F.lit("1")))
    assert one(spark, maps.as_text(headers)) == "Content-Type=application/json;a=1;x-gateway-inference-objective=fast"


def test_normalized_routing(spark):
    message = {"request_queue_name": F.lit("own"), "result_queue_name": F.lit(""), "pubsub_id": F.lit("m1")}
    routing = {"request_queue_name": F.lit("q"), "result_queue_name": F.lit("r"), "transport_correlation_id": F.lit(None).cast("string")}
    want = {"plain": ("q", "r", None), "redis": ("own", "r", None), "pubsub": ("q", "r", "m1")}
    for kind, values_ in want.items():
        out = messages.normalize_kind(F.lit(kind), message, routing)
        assert tuple(spark.range(1).select(*out.values()).first()) == values_


@pytest.mark.parametrize("text", ["Sun, 06 Nov 2094 08:49:37 GMT", "Sun Nov  6 08:49:37 2094"])
def test_http_dates(spark, text):
    assert one(spark, outcome.parse_retry_after(F.lit(text), 3939871777 - 40, F.lit(503), F.lit(False))) == 40


@pytest.mark.parametrize("text, at", [("Tuesday, 16-Jan-24 00:00:30 GMT", 1705363230), ("Sunday, 06-Nov-94 08:49:37 GMT", 784111777), ("Sunday, 06-Now-94 08:49:37 GMT", None)])
def test_dashed_http_dates(spark, text, at):
    assert one(spark, outcome.parse_retry_after(F.lit(text), 784111700, F.lit(503), F.lit(False))) == (at and at - 784111700)


def test_null_keys_and_times_stay(spark):
    rows = [(1, "a", 5), (2, None, 3), (3, None, 400_000), (4, "a", None), (5, None, None)]
    df = spark.createDataFrame(rows, "i long, k string, t long")
    got = {r.i: (r.s, r.rn) for r in windows.ranked(windows.running(df, ["k"], "t", ["i"], s=F.lit(10)), ["k"], "t", ["i"]).collect()}
    assert got == {4: (10, 1), 1: (20, 2), 5: (10, 1), 2: (20, 2), 3: (30, 3)}
    assert {r.i: r.p for r in windows.previous(df, ["k"], "t", ["i"], {"p": "i"}).collect()} == {4: None, 1: 4, 5: None, 2: 5, 3: 2}
    assert {r.i: r.at for r in windows.asof(df, df.select("k", "t"), ["k"], "t", []).collect()} == {1: 5, 2: 3, 3: 400_000, 4: None, 5: None}
    held = df.withColumn("e", F.col("t") + 10)
    assert admission.admit(held, key="k", time="t", tie="i", end="e", limit=1).count() == 5
    assert windows.width_for(df, ["k"], "t", 1) >= 1


def test_gate_chain_takes_no_slot_where_a_later_gate_refuses(spark):
    rows = [(0, "a", 0, 100, 10), (1, "a", 1, 100, 10), (2, "a", 20, 100, 30), (3, "a", 21, 100, 40)]
    df = spark.createDataFrame(rows, "i long, k string, t long, day long, done long")
    got = {r.i: r.refused_by for r in admission.admit_chain(df, key="k", time="t", tie="i", ends=["day", "done"], limits=[2, 1]).collect()}
    assert got == {0: None, 1: 1, 2: None, 3: 0}  # the refused second request left the first gate's slot to the third


def test_pool_gate_outcomes(spark):
    ticks = spark.createDataFrame([("p", 0, "WAIT", False), ("p", 100, "WAIT", False), ("p", 200, "CONTINUE", False), ("p", 300, "WAIT", False), ("p", 400, "DROP", False), ("p", 500, "REFUSE", False), ("p", 600, "CONTINUE", True)], "k string, t long, verdict string, failed boolean")
    rows = [(1, "p", 50, 1000, ""), (2, "p", 50, 150, ""), (3, "p", 350, 1000, "overflow"), (4, "p", 450, 1000, ""), (5, "p", 550, 1000, "overflow"), (6, "p", 650, 1000, ""), (7, "none", 5, 1000, ""), (8, "p", 90, 80, ""), (9, None, 5, 0, "")]
    df = spark.createDataFrame(rows, "i long, k string, t long, d long, class string")
    got = {r.i: (r.outcome, r.reason, r.at) for r in admission.pool_gate(df, ticks, "k", "t", "d", 300).collect()}
    assert got == {
        1: ("dispatch", "gate_closed", 200), 2: ("DEADLINE_EXCEEDED", "gate_closed", None), 3: ("result", "dropped", 400), 4: ("result", "dropped", 450), 5: ("requeue", "quota_exhausted", 550),
        6: ("GATE_ERROR", "error", 650), 7: ("dispatch", None, 5), 8: ("DEADLINE_EXCEEDED", "gate_closed", None), 9: ("dispatch", None, 5),
    }


def test_merge_of_queues_by_a_registered_policy(spark):
    ordering.register_merge_policy("by-size", lambda df: [df["size"].desc(), df["id"]])
    a = spark.createDataFrame([("x", "", 1), ("y", "p", 5)], "id string, pool string, size long")
    b = spark.createDataFrame([("z", None, 9), ("w", "p", 7)], "id string, pool string, size long")
    got = ordering.merge([a, b], ["default", "p"], "by-size", take=1)
    assert sorted((r.pool, r.id, r.turn) for r in got.collect()) == [("default", "z", 1), ("p", "w", 1)]
    assert [r.id for r in ordering.merge([a, b], ["default", "p"], "by-size").collect()] == ["z", "x", "w", "y"]
    with pytest.raises(Exception, match="unknown pool p"):
        ordering.merge([a], ["default"], "by-size").collect()


def test_alerts_hold(spark):
    rows = [("q", "retries", t, r) for t, r in ((0, 0.6), (600, 0.7), (1200, 0.9), (1800, 0.1), (2400, None))] + [("q", "success", 0, 0.5), ("q", "success", 600, 0.8)]
    got = {(r.rule, r.t): (r.session, r.firing) for r in metrics.alerts(spark.createDataFrame(rows, "q string, c string, t long, r double"), ["q"], "t", "c", "r").collect()}
    assert got == {("high retry rate", 0): (0, False), ("high retry rate", 600): (0, False), ("high retry rate", 1200): (0, True), ("high retry rate", 1800): (None, False), ("high retry rate", 2400): (None, False), ("low success rate", 0): (0, False), ("low success rate", 600): (0, True)}


def test_byte_prefix_and_typed_map(spark):
    df = spark.createDataFrame([("q", 1, 600), ("q", 2, 100), ("q", 3, 5), ("r", 1, 614)], "q string, t long, s long")
    got = ordering.byte_budget_prefix(df, "q", "t", "t", "s", ordering.byte_cap(1024, 0.7, 0.1))
    assert sorted((r.q, r.t, r.upto) for r in got.collect()) == [("q", 1, 600), ("r", 1, 614)]
    for text in ('{"a": 1, "b": "x"}', '"{\\"a\\": 1, \\"b\\": \\"x\\"}"'):
        assert one(spark, maps.as_text(transforms.typed_map(F.lit(text)))) == "a=1;b=x"
    assert one(spark, transforms.typed_map(F.lit("3"))) is None


def test_registries(spark):
    transforms.register_transform("upper", lambda body, row: F.upper(body))
    assert one(spark, transforms.chain(["upper"], F.lit("a"), {})) == "A"


def test_alerts_compute_their_rates_once(spark):
    """Rates are asked for base, counters and sessions; what they are made from runs once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rates = spark.createDataFrame([("q", c, 3600 * i, float(1 + (c == "retries") * i)) for i in range(4) for c in ("requests", "retries")], "queue_id string, counter string, start long, rate double")
    ratios = metrics.rate_ratios(rates.mapInArrow(count, rates.schema), ["queue_id"], "counter", "requests")
    got = sorted((r.start, r.session, r.firing) for r in metrics.alerts(ratios, ["queue_id"], "start", "counter", "ratio").collect())
    assert got == [(0, 0, False), (3600, 0, True), (7200, 0, True), (10800, 0, True)]
    assert seen.value == 8
