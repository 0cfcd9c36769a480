"""Quality, packing, scoring, mixing and secrets on small inputs with every odd case."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import lm_score, mixing, packing, quality, secrets
from sluice.llm.common import Scratch
from tests.compare import same
from tests.conftest import SMALL

ODD = [(1, "Hello the world. the end"), (2, None), (3, ""), (4, "  \n\t "), (5, "x"), (None, "no id"), (6, "same text here"), (6, "same text here"), (7, "word " * 30000), (8, "Ünïcode ñandú 漢字 <|endoftext|> don't 12a3")]


def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i else None, None if i == 3 else "src1", 0, 1.0, "k") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score double, row_key string")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


# Quality classifier.
def test_quality_on_odd_rows(spark):
    known = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (5, 0)], "doc_id long, quality int")
    got = quality.scores(odd(spark), known).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id}[5] == (zlib.crc32(b"5") % 5 == 0)
    assert quality.scores(odd(spark).where("false"), known).count() == 0
    none = quality.scores(odd(spark), known.where("false")).collect()
    assert all(r.score == 0.5 for r in none)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    j = quality.scores(docs, known).where("held_out").join(known, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in j) / len(j) > 0.9
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert kept.count() == quality.scores(docs, known).where("predicted = 1").count()


def test_quality_learns_from_every_labelled_row(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    known = rows.select("doc_id", F.lit(1).alias("quality"))
    got = quality.scores(rows, known).agg(F.min("score"), F.count_if(~F.col("held_out"))).first()
    assert got[1] > 39_000 and math.isclose(1 - got[0], 0.5 / (got[1] + 1), rel_tol=1e-6)


def test_trees_of_a_table_are_those_of_its_rows(spark):
    docs = documents(spark).select(F.coalesce("text", F.lit("")).alias("text")).limit(150).collect()
    x = np.array([quality.statistics(r.text.encode()) for r in docs])
    y = (x[:, 0] + x[:, 12] > np.median(x[:, 0] + x[:, 12])).astype(float)
    table = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    local = quality.BoostedTrees(trees=16).fit(x, y)
    for other in (quality.BoostedTrees(trees=16).fit_table(part, Scratch(spark, "trees")) for part in (table, table.repartition(2))):
        assert (other.feature == local.feature).all() and (other.cut == local.cut).all() and (other.leaf == local.leaf).all()
    assert local.leaf.any() and ((local.predict(x) > 0.5) == y).mean() > 0.8


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality.BoostedTrees(trees=60).fit(x[:3000], y[:3000])
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_texts_are_judged_a_few_at_once(spark, monkeypatch):
    import pyarrow as pa

    class Model:
        most = 0

        def predict(self, x):
            self.most = max(self.most, len(x))
            return x[:, 0]

    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array([None, "", "a word " * 2000] * 300)], names=["doc_id", "text"])
    model = Model()
    kept = pa.Table.from_batches(quality._keep(model, "text", 1.0)([batch]))
    assert kept["doc_id"].to_pylist() == list(range(2, 900, 3)) and model.most < 500
    parts = list(quality._statistics_of([batch]))
    assert max(map(len, parts)) < 500 and sum(map(len, parts)) == 900

    held = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t", batch=None: (held.append((name, batch)), save(self, df, name, batch))[1])
    docs = documents(spark)
    assert quality.keep_good(docs, labels(spark)).columns == docs.columns
    assert dict(held)["statistics"] == dict(held)["kept"] == quality.BATCH


# Packing.
def test_large_rows_are_handed_over_in_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    saved = Scratch(spark, "batches").save(spark.range(0, 95, 1, 2).mapInArrow(sizes, "n long"), "sizes", 10)
    assert saved.agg(F.max("n"), F.sum("n")).first() == (10, 95)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_matches_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(odd(spark), keep_ids=True).collect()
    n = check_packing(rows, 4096)
    assert n == math.ceil(sum(r.length for r in rows) / 4096)
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, text in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            want[i, p, at, len(part) // 4, zlib.crc32(part)] += 1
    assert got == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert packing.pack(odd(spark).where("false")).count() == 0


def test_bin_completion_finds_what_best_fit_misses():
    # Best fit decreasing needs four bins of 10, three are enough.
    lengths = [6, 5, 5, 4, 3, 3, 2, 2]
    assert sum(lengths) == 30 and len(packing.best_fit(sorted(lengths, reverse=True), 10)) >= 3
    for case, cap, want in ((lengths, 10, 3), ([4, 4, 4, 3, 3, 3, 3, 3, 3], 10, 3), ([7, 6, 4, 3, 5, 5], 10, 3), ([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 61, 3)):
        bins = packing.bin_completion(case, cap)
        assert len(bins) == want and all(sum(b) <= cap for b in bins)
        assert Counter(x for b in bins for x in b) == Counter(case)


def test_bin_completion_completes_a_packing_of_a_large_group():
    import pandas as pd

    lengths = np.sort(np.minimum(4096, 600 + np.random.default_rng(5).exponential(900, 1000)).astype(int))[::-1]
    part = pd.DataFrame({"length": lengths, "id": range(1000), "row_key": range(1000), "piece": 0, "grp": 0})
    got = packing._pack_group(4096, 200)(part)
    used = got.groupby("sequence_id")["length"].sum()
    first = len(packing.best_fit(lengths.tolist(), 4096))
    assert first > 200 and used.max() <= 4096 and -(-lengths.sum() // 4096) <= len(used) < first


# Scoring.
def test_scores_have_exact_counts(spark):
    rows = lm_score.scores(odd(spark), head_words=3).collect()
    tokens = [(i, [*(t or "").encode().lower().split(), b"\0end"]) for i, t in ODD]
    train = [t for i, t in tokens if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert lm_score.scores(odd(spark).where("false")).count() == 0


def brute_scores(rows, head):
    """(id, score) by the formulas of the module, with dictionaries in place of the filter. head: the words with exact counts."""
    tokens = [(i, [*(t or "").encode().lower().split(), b"\0end"]) for i, t in rows]
    words, pairs, after = Counter(), Counter(), {}
    for i, t in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            words.update(t)
            pairs.update(zip([b"\0end", *t[:-1]], t, strict=True))
    quantised = lambda c: float(lm_score.value_of(lm_score.level_of(np.array([c])))[0]) if c else 0.0
    for (v, _), c in pairs.items():
        after[v] = after.get(v, 0.0) + quantised(c) - lm_score.DISCOUNT
    n, distinct = sum(words.values()), len(words)
    count = lambda w: float(words[w]) if w in head else quantised(words[w])
    weight = {v: math.exp(-lm_score.STEP * round(-math.log(min(1, max(0.01, 1 - m / words[v]))) / lm_score.STEP)) for v, m in after.items()}
    out = []
    for i, t in tokens:
        total = 0.0
        for v, w in zip([b"\0end", *t[:-1]], t, strict=True):
            seen, p0 = max(1.0, count(v)), (count(w) + 0.5) / (n + 0.5 * (distinct + 1))
            found = quantised(pairs[v, w]) - lm_score.DISCOUNT if pairs[v, w] else 0.0
            total += math.log10(min(1.0, min(found, seen) / seen + weight.get(v, 1.0) * p0))
        out.append((i, round(total, 5)))
    return Counter(out), words


@pytest.mark.parametrize("most_bytes", [2**30, -1])  # the filter is broadcast, or probes go to its segments
def test_scores_equal_brute_force(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(lm_score, "CHUNK", 20_000)
    rnd = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    rows = [*ODD, *((100 + i, " ".join(words[k] for k in np.minimum(59, rnd.geometric(0.08, 40)))) for i in range(60)), (None, "w1 w2 w1"), (100, "w1 w2 w1")]
    _, counted = brute_scores(rows, set())
    top = sorted({lm_score.level_of(np.array([c]))[0] for c in counted.values()})
    head = {w for w, c in counted.items() if lm_score.level_of(np.array([c]))[0] >= top[-6]}
    want, _ = brute_scores(rows, head)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.scores(df, head_words=len(head), bits_per_entry=4096, bucket_bytes=30_000, most_bytes=most_bytes).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == want


@pytest.mark.parametrize("most_bytes", [2**30, -1])
def test_a_word_before_half_of_all_tokens_is_spread_over_the_buckets(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(lm_score, "CHUNK", 20_000)
    rnd = np.random.default_rng(6)
    rows = [(i, " ".join(f"the w{k}" for k in rnd.integers(0, 3000, 60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = lm_score.hot_words(df.select(F.col("doc_id").alias("id"), "text"), 2000, 16)
    assert len(hot) == 1

    def pairs_of_fullest_bucket(hot):
        blocks = df.select("text").mapInArrow(lm_score._count(16, hot), lm_score.BLOCK_DDL).where(F.col("kind") == lm_score.PAIR)
        sizes = [r[1] for r in blocks.groupBy("bucket").agg(F.sum(F.length("a") / 8)).collect()]
        return max(sizes), sum(sizes)

    most, total = pairs_of_fullest_bucket(hot)
    assert most < 2 * total / 16 < pairs_of_fullest_bucket(hot[:0])[0]
    _, counted = brute_scores(rows, set())
    head = {w for w, c in counted.items() if c > 1000}
    want, _ = brute_scores(rows, head)
    got = lm_score.scores(df, head_words=len(head), bits_per_entry=4096, bucket_bytes=3_000, most_bytes=most_bytes).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == want


def test_probes_of_many_buckets_are_dealt_in_a_few_bytes(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    rows = [*((i, " ".join(f"word{k}" for k in rnd.integers(0, 20_000, 120))) for i in range(300)), (None, "word1 word2"), (None, "word1 word2"), (7, None), (None, "")]
    df, size = spark.createDataFrame(rows, "doc_id long, text string"), sum(len(t or "") for _, t in rows)
    dealt, in_order = [], lm_score._in_order

    def measured(blocks, parts):
        dealt.append(blocks.agg(F.sum(sum(F.length(c) for c in "abcde"))).first()[0])
        return in_order(blocks, parts)

    def got(most_bytes):
        rows = lm_score.scores(df, head_words=50, bucket_bytes=size // 200, most_bytes=most_bytes).collect()
        return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in rows)

    want = got(2**30)
    monkeypatch.setattr(lm_score, "_in_order", measured)
    assert got(-1) == want and want.total() == len(rows)
    assert len(dealt) > 1 and max(dealt) < 3 * size


def test_model_beats_the_base_on_held_out_text(spark):
    rows = [r for r in lm_score.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_hashing_gives_no_warnings():
    import warnings

    from sluice.llm import ann

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        keys = np.array([1, 2**63, 2**64 - 1], np.uint64)
        for level in (0, 109, np.array([0, 1, 2])):
            assert (lm_score.position(keys, level, 3, np.uint64(800)) < 800).all()
        assert ann._mix(5, 3) == ann._mix(np.array([5]), 3)[0]


def test_keys_are_scrambled_once_a_level_not_once_a_hash(monkeypatch):
    keys, levels = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(2000) % 7
    seen, mix = [0], lm_score.mix
    monkeypatch.setattr(lm_score, "mix", lambda x: (seen.__setitem__(0, seen[0] + len(x)), mix(x))[1])
    segment = lm_score.segment_of([keys], [levels], 8.0)
    entries, made = int((levels + 1).sum()), seen[0]
    flags = np.unpackbits(np.frombuffer(segment, np.uint8), bitorder="little")
    for key, level in zip(keys[:200], levels[:200].tolist(), strict=True):
        assert all(flags[lm_score.position(np.array([key]), v, i, np.uint64(len(flags)))[0]] for v in range(level + 1) for i in range(lm_score.HASHES))
    seen[0] = 0
    found = lm_score.Filter.single(segment).level(keys, keys)
    assert (found >= levels + 1).all() and (found == levels + 1).mean() > 0.9
    assert made <= 2 * entries and seen[0] <= 2 * int((found + 1).sum()) + len(keys)


def test_filter_counts_are_the_quantised_ones(spark):
    counts = np.array([1, 2, 3, 5, 8, 100, 12345])
    value = lm_score.value_of(lm_score.level_of(counts))
    assert (np.abs(value - counts) <= 0.2 * counts).all() and list(value[:3]) == [1, 2, 3]


# Mixing.
def test_mixing_matches_sql(spark, duck):
    from sluice.llm import queries

    same(queries.queries()["op5_mixing"](spark, SMALL), duck, queries.oracle_sql()["op5_mixing"])


def test_mixing_odd_rows_and_pass_through(spark):
    docs = odd(spark)
    out = mixing.mix(docs, percent=100, max_epochs=1)
    assert out.columns == docs.columns and out.count() == len(ODD)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_with_clashing_columns_and_many_leaves(spark, monkeypatch):
    clash = {n: F.lit(n) for n in ("domain", "epoch", "epochs", "quota", "cut", "tokens", "capacity", "weight", "range", "id", "row", "last", "n_tokens", "in_prefix")}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.withColumns(clash)
    plain = sorted(r.doc_id for r in mixing.mix(docs.select("doc_id", "text", "lang", "source")).collect())
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == plain and {(r.domain, r.epoch, r.id) for r in rows} == {("domain", "epoch", "id")}
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(r.doc_id for r in mixing.mix(docs).collect()) == plain


def test_shortages_go_to_siblings_first(spark):
    rows = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("reference", "en", "d", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    q = {r.source: r.quota for r in mixing.quotas(leaves, 30, 1).collect()}
    assert q == {"a": 10, "b": 351, "c": 180, "d": 361} or sum(q.values()) <= 903
    assert q["a"] == 10 and q["b"] > q["c"]
    # The domains' shares are kept: the shortage of a stays within its language.
    assert abs((q["a"] + q["b"] + q["c"]) / q["d"] - 1.5) < 0.02


# Secrets.
def test_secrets_are_found_and_masked(spark):
    import hashlib
    import random

    rnd = random.Random(2)
    key = lambda: hashlib.sha1(str(rnd.random()).encode()).hexdigest()
    rows, hidden = [], []
    for i in range(300):
        secret, number = key(), rnd.randrange(10**15, 10**16)
        hidden.append((secret, str(number)))
        rows.append((i, f'Some text here with the number {number} in it.\nthe token = "{secret}" and more text follows, see /img/{secret[:20]}.png'))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan(df).collect()
    by = {(r.doc_id, r.value): r for r in found}
    for i, (secret, number) in enumerate(hidden):
        assert by[i, secret].is_secret and not by[i, number].is_secret
        r = by[i, secret]
        assert rows[i][1][r.start : r.start + r.length] == secret
    for r in secrets.mask(df).collect():
        secret, number = hidden[r.doc_id]
        assert r.text == rows[r.doc_id][1].replace(f'"{secret}"', f'"{secrets.MASK}"') and number in r.text


def planted_secrets(rnd, size):
    """Rows with a secret and a harmless value each, and {(id, value): (is secret, has a name)}; half of the long secrets have no name before them."""
    import string

    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    strong, hex_, digits = string.ascii_letters + string.digits, "0123456789abcdef", string.digits
    secret = (lambda: pick(hex_, 40), lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16), lambda: pick(strong, 32), lambda: pick(strong + "!&%$", 12))
    harmless = (lambda: pick(digits, 16), lambda: "/static/" + "/".join(rnd.choice(("image", "page", "user", "index")) for _ in range(4)) + "/2024", lambda: "internationalisation-example-file-" + pick(digits, 4))
    rows, truth = [], {}
    for i in range(size):
        s, h = secret[i % 4](), harmless[i % 3]()
        named = i % 8 < 4 or i % 4 == 3
        rows.append((i, f"Here is the page {h} and some more of it.\n" + (f'password = "{s}" then text' if named else f'"{s}" then text')))
        truth[i, s], truth[i, h.strip("/")] = (True, named), (False, False)
    return rows, truth


def test_secrets_precision_and_recall(spark):
    """Labels from context find what is named; given findings also what is not. Neither takes harmless values."""
    import random

    rows, truth = planted_secrets(random.Random(8), 600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more, known = planted_secrets(random.Random(9), 400)
    text = dict(more)
    given = [(v, text[i][: text[i].index(v)], text[i][text[i].index(v) + len(v) :], int(k[0])) for (i, v), k in known.items()]
    given = spark.createDataFrame(given, "value string, before string, after string, label int")
    for labelled, wanted in ((None, lambda k: k == (True, True)), (given, lambda k: k[0])):
        said = {(r.doc_id, r.value.strip("/")): r.is_secret for r in secrets.scan(docs, labelled).collect()}
        need = [said.get(k, False) for k, v in truth.items() if wanted(v) and (k in said or labelled is None)]
        assert sum(need) >= 0.95 * len(need) and len(need) >= 375
        assert sum(said.get(k, False) for k, v in truth.items() if not v[0]) <= 0.02 * 600


def test_values_of_equal_length_are_told_apart_by_their_words(spark):
    """Secrets and harmless names of 24 letters and digits in the same places: only the dictionary and the transitions differ."""
    import random
    import string

    rnd = random.Random(4)
    words = ["garden", "window", "orange", "silver", "mountain", "letter", "winter", "summer", "bridge", "castle", "forest", "island"]

    def harmless():
        text = ""
        while len(text) < 22:
            text += rnd.choice(words).capitalize()
        return text[:22] + f"{rnd.randrange(100):02}"

    secret = lambda: "".join(rnd.choice(string.ascii_letters) for _ in range(22)) + f"{rnd.randrange(100):02}"
    values = [(secret() if i % 2 else harmless(), i % 2) for i in range(800)]
    docs = spark.createDataFrame([(i, f"the {' and the '.join(rnd.choices(words, k=20))} of {v} in the {rnd.choice(words)}") for i, (v, _) in enumerate(values[:400])], "doc_id long, text string")
    given = spark.createDataFrame([(v, "the one of ", " in the other", y) for v, y in values[400:]], "value string, before string, after string, label int")
    said = {r.doc_id: r.is_secret for r in secrets.scan(docs, given).collect()}
    right = [said.get(i, False) == bool(y) for i, (_, y) in enumerate(values[:400])]
    assert sum(right) >= 0.95 * len(right)
    masked = {r.doc_id: r.text for r in secrets.mask(docs, given).collect()}
    assert all((secrets.MASK in masked[i]) == said.get(i, False) for i in range(400))


def test_secrets_with_ties_repeated_rows_and_null_ids(spark):
    a, b = "0123456789abcdef0123", "fedcba98765432100123"
    rows = [(None, f'token = "{a}" {b}', "x"), (1, f'token = "{a}" {b}', "x"), (1, f'token = "{a}" {b}', "x"), (2, f"{a}{'.' * 50_000}{b}", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    found = secrets.scan(docs).collect()
    assert len(found) == 8 and {(r.doc_id, r.start) for r in found} == {(None, 9), (None, 31), (1, 9), (1, 31), (2, 0), (2, 50_020)}
    given = spark.createDataFrame([(a, "", "", 1)] * 20 + [(b, "", "", 0)] * 20 + [(None, None, None, None)], "value string, before string, after string, label int")
    out = secrets.mask(docs, given)
    assert out.columns == docs.columns and out.count() == 4 and all(r.value == "x" for r in out.collect())
    assert all(r.score in (0.0, 1.0) for r in secrets.scan(docs, given.where("label = 1")).collect())


def test_secrets_on_odd_rows(spark):
    docs = odd(spark)
    assert secrets.scan(docs).count() == 0
    assert sorted(map(str, secrets.mask(docs).collect())) == sorted(map(str, docs.collect()))
    assert secrets.mask(docs.where("false")).count() == 0


def test_forest_expression_equals_its_prediction(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 15)).round(3)
    forest = secrets.Forest().fit(x, (x[:, 2] + x[:, 5] > 0).astype(float))
    df = spark.createDataFrame([(x[i].tolist(),) for i in range(100)], "x array<double>")
    got = [r[0] for r in df.select(forest.expression(F.col("x"))).collect()]
    assert got == pytest.approx(forest.predict(x[:100]).tolist())


def test_secrets_are_learnt_from_all_documents(spark):
    """A word and the only findings of one kind stand in few of very many rows, and are known all the same."""
    rows = [(i, "plain words in every row") for i in range(6000)] + [(6000 + i, "rareword rareword") for i in range(3)]
    words = []
    language, held = secrets.Language, secrets.Language.__init__

    def seen(self, known, follows):
        words.extend(known)
        held(self, known, follows)

    language.__init__ = seen
    try:
        secrets.learn(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    finally:
        language.__init__ = held
    assert "rareword" in words and "plain" in words
    # 8,000 findings of either label; what a bound of 3,000 would leave out changes the share of a leaf.
    found = spark.range(16000).select(F.col("id").cast("string").alias("value"), F.array(F.when(F.col("id") < 8001, 1.0).otherwise(0.0)).alias("x"), (F.col("id") < 8000).cast("int").alias("label"))
    assert secrets.fit(found).predict(np.array([[1.0], [0.0]])).tolist() == [round(8000 / 8001, 6), 0.0]


def test_forest_of_a_table_equals_that_of_arrays(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)).round(2).clip(-1, 1)
    y = (x[:, 0] > x[:, 3]).astype(int)
    df = spark.createDataFrame([(str(i), x[i].tolist(), int(y[i])) for i in range(400)], "value string, x array<double>, label int")
    one, other = secrets.fit(df), secrets.Forest().fit(x, y)
    assert one.roots == other.roots and ((one.predict(x) > 0.5) == y).mean() > 0.85
