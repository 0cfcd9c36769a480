"""Importance resampling, hard negatives and token counts against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sluice.llm import hard_negatives as hn
from sluice.llm import importance as im
from sluice.llm import token_counts as tc

# --- importance resampling -------------------------------------------------------------------------------------------


def words_of(text):
    import re

    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def grams_of(text, order=3):
    w = words_of(text)
    return [b" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, percent, least, buckets=10_000):
    hashed = lambda texts: Counter(zlib.crc32(g) % buckets for t in texts for g in grams_of(t))
    s, t = hashed(x for _, x in docs), hashed(target)
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + buckets) / ((s[b] + 1.0) * (nt + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        g = grams_of(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in g)
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(r[:4], []).append(place)
    return sorted(((*r[:4], ranks[r[:4]].pop() if ranks.get(r[:4]) else None) for r in rows), key=str)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "d3lta", "é", "x-y", "Ünder", "\x00", " ", "the", "of"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "--- !!"), (None, "alpha beta " * 15), (None, None), (403, "word " * 30_000), (404, "x" * 200_000)]
    docs += [(7, "alpha of the " * 9)] * 5 + docs[:3]
    target = ["alpha beta gamma alpha", "the of the", None, ""]
    a = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, row int")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted(map(tuple, im.resample(a, b, percent=30).collect()), key=str)
    assert got == brute_resample(docs, target, 30, 20)
    assert sum(r[4] is not None for r in got) > 50
    none = im.resample(a.limit(0), b.limit(0))
    assert none.columns == ["doc_id", "n_features", "weight", "score", "rank"] and none.count() == 0
    assert im.resample(a, b.limit(0), percent=0).where("rank is not null").count() == 0


@pytest.mark.parametrize("part", [1, 7, 100, 1 << 20])
def test_crcs_of_prefixes_give_those_of_ngrams(monkeypatch, part):
    monkeypatch.setattr(im, "PART", part)
    rng = random.Random(part)
    for _ in range(100):
        text = "".join(rng.choices(["a", "B", " ", "\t ", "word", "é", "7", "-", "\x00", "x" * rng.randrange(1, 300)], k=rng.randrange(40))).encode()
        for order in (1, 3, 4):
            found = list(im.features(text, order))
            assert sum(n for n, _ in found) == len(words_of(text.decode()))
            assert sorted(c for _, grams in found for c in grams.tolist()) == sorted(map(zlib.crc32, grams_of(text.decode(), order)))


def test_shift_over_many_bytes():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000, 100_003):
        a, b = rng.bytes(9), rng.bytes(size)
        assert int(im.shift(np.array([zlib.crc32(a)]), np.array([size]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


# --- hard negatives --------------------------------------------------------------------------------------------------


def brute_negatives(rows, every, positives=5, negatives=3):
    """rows: (id, vector, label); exact integers of Python."""
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(max(-(2.0**62), min(2.0**62, 256 * x))) for x in v])
        known[i] = min(known.get(i, r), r)
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in known.items() if i != a and len(w) == len(v)}
        scores = {i: max(-hn.LONG, min(hn.LONG, s)) for i, s in scores.items()}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if known[i][0] == label][:positives]:
            fit = [i for i in order if known[i][0] != label and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]]
            out += [(a, p, k, i, scores[p], scores[i]) for k, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.4], int(rng.integers(0, 4))) for i in range(900)]
    rows += [(900 + i, [1.0] * 8, i % 3) for i in range(60)]  # ties
    rows += [(1000, None, 1), (1005, [1.0] * 8, None), (1010, [1.0, None] * 4, 1), (1015, [math.nan] * 8, 1), (1020, [math.inf] * 8, 1), (None, [1.0] * 8, 1), (1025, [0.0] * 8, 1), (1030, [], 1), (1035, [], 2), (1040, [2.0, 1.0], 0), (1041, [2.0, 1.1], 0), (1042, [1.6, 1.0], 1)]
    rows += [(1050, [1e300] * 8, 9), (1051, [1e12] * 8, 9), (1052, [7e11] * 8, 8), (1053, [-1e300] * 8, 8)]
    rows += [(5, [1.0] * 8, 0), (5, [0.5] * 8, 0), rows[10], rows[10]]
    df = spark.createDataFrame([(i, v, label, 1.0, 2) for i, v, label in rows], "vec_id long, embedding array<double>, label int, score double, block int")
    want = brute_negatives(rows, 5)
    assert len(want) > 500
    for block_bytes in (8 << 20, 64 * 100):  # one block; many blocks of rows and of anchors
        assert sorted(map(tuple, hn.mine(df, anchor="vec_id % 5 = 0", block_bytes=block_bytes).collect())) == want
    assert hn.mine(df.limit(0), anchor="vec_id % 5 = 0").count() == 0
    assert hn.mine(df, anchor="vec_id < 0").count() == 0


@pytest.mark.parametrize("bucket", [64, 2048])
def test_pruned_search_is_exact_and_leaves_most_rows_unverified(bucket):
    """Clusters of many lengths: feasible ranges leave few rows, and all of the best k are found."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 16))
    x = np.floor(256 * (centres[rng.integers(0, 200, 6000)] + rng.normal(size=(6000, 16)) * 0.05) * rng.lognormal(0, 0.7, 6000)[:, None])
    ids, labels = np.arange(6000), rng.integers(0, 3, 6000)
    q = np.arange(0, 6000, 100)
    windows = (np.arange(len(q)), np.full(len(q), -hn.LONG), np.full(len(q), hn.LONG))
    best, verified = hn.search_block((ids, labels, x), (ids[q], labels[q], x[q], windows), True, 5, bucket=bucket)
    assert verified < 0.5 * len(q) * len(ids)
    scores = (x[q] @ x.T).astype(np.int64)
    for n, a in enumerate(q):
        ok = (labels == labels[a]) & (ids != a)
        want = sorted(zip(-scores[n][ok], ids[ok], strict=True))[:5]
        assert [(-s, i) for s, i in zip(best.scores[best.at == n], best.ids[best.at == n], strict=True)] == want


# --- token counts ----------------------------------------------------------------------------------------------------


def library_counts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


BITS = ["a", "b", "'s", "'", "'ll", "  ", "\n", " ", "1", "23", ".", ",", "!?", "<|endoftext|>", "<|", "é", "中", "。", "\xa0", "　", "🙂", "​", "x" * 30, "   \n\n", "ñ", "٣", "́", "\x1f", "͸"]


@pytest.mark.parametrize(("chunk", "overlap", "huge"), [(20, 3, 0), (7, 1, 10), (40, 8, 30), (100, 16, 100_000)])
def test_counts_equal_the_library(chunk, overlap, huge):
    rng = random.Random(chunk)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(1, 120))) for _ in range(600)]
    assert tc.Counter(None, chunk, overlap, huge).counts([t.encode() for t in texts]) == library_counts(texts)


def test_texts_without_a_stable_place_are_widened_to_the_whole():
    counter = tc.Counter(None, 500, 16, 1000)
    calls, encoded = [], counter.encoded
    counter.encoded = lambda text, lo, hi: calls.append((lo, hi)) or encoded(text, lo, hi)
    texts = ["a" * 5000, "中" * 3000, " " * 4000, "ab " * 500 + "y" * 2600 + " ab" * 400]
    assert [counter.by_chunks(t) for t in texts] == library_counts(texts)
    assert (0, 5000) in calls and (0, 3000) in calls  # nothing but the whole is safe
    calls.clear()
    assert [counter.by_chunks("word, " * 4000)] == library_counts(["word, " * 4000])
    assert max(hi - lo for lo, hi in calls) <= 516  # else a chunk and its overlap


def test_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "Hello, world<|endoftext|> again"), (3, "Hello, world<|endoftext|> again"), (4, "l'été « là » ! " * 9000), (5, "tok " * 513)]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, id int, n_tokens int")
    got = sorted(map(tuple, tc.count(df).collect()), key=str)
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, library_counts(t for _, t in rows), strict=True)]
    assert got == sorted(want, key=str)
    assert tc.count(df.limit(0)).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert [tuple(r) for r in tc.count(broken).collect()] == [(1, 3, library_counts(["a�b"])[0], False)]
    with pytest.raises(ValueError, match="overlap"):
        tc.count(df, chunk=5, overlap=5)
