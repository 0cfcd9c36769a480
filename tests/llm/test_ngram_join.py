"""The n-gram Jaccard join against brute force."""

import random

from sluice.llm import ngram_join


def test_blocks_name_only_the_documents_of_their_postings():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(700)]
    ids = [rng.randrange(-(2**40), 2**40) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["id", "text"])
    got, size = [], []
    for buckets in (10, 2000):
        found, size = set(), [*size, 0]
        for out in ngram_join.shingle_blocks(5, buckets)([batch]):
            for r in out.to_pylist():
                if r["kind"] == ngram_join.POSTINGS:
                    keys = np.frombuffer(r["keys"], np.uint64)
                    found |= set(zip(ngram_join.posted(r["ids"], r["ords"], len(keys)).tolist(), keys.tolist(), strict=True))
                    size[-1] += len(r["ids"]) + len(r["ords"]) + len(r["keys"])
        got.append(found)
    words = ngram_join._WordHash()
    assert got[0] == got[1] == {(i, k) for i, t in zip(ids, texts, strict=True) for k in ngram_join.shingles(t.encode(), 5, words).tolist()}
    assert size[1] < 3 * size[0]  # blocks that all name all 700 documents get far larger


def test_blocks_count_postings_by_document():
    import pyarrow as pa

    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], names=["id", "text"])
    rows = [r for out in ngram_join.shingle_blocks(5, 10)([batch]) for r in out.to_pylist() if r["kind"] == ngram_join.POSTINGS]
    assert sum(len(r["keys"]) // 8 for r in rows) == 50 * 296
    assert sum(len(r["ords"]) for r in rows) <= 50 * 10  # a byte per document and bucket, not per posting


def test_saved_tables_leave_no_shuffle_files(spark):
    from sluice.llm.common import Scratch

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")
    before = files()
    saved = Scratch(spark, "clean").save(spark.range(1000).repartition(7, "id"))
    assert files() <= before and saved.count() == 1000


SCHEMA = "doc_id long, text string, component_id string, n long"


def brute(rows, n=5):
    """(id, set size, smallest id of the component) by comparing every pair."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                low[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def joined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, **options).collect()}


def family(rnd, size, words=60, edits=8):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(size - 1):
        t = list(base)
        for _ in range(rnd.randrange(edits)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
        out.append(t[: rnd.randint(words * 2 // 3, words)])
    return [" ".join(t) for t in out]


def test_families_passages_and_cases(spark):
    rnd = random.Random(5)
    texts = [t for size in (40, 25, 6, 3, 1, 1) for t in family(rnd, size)]
    passage = " ".join(f"p{i}" for i in range(55))
    texts += [f"{passage} " + " ".join(f"u{rnd.randrange(10**7)}" for _ in range(rnd.randint(2, 60))) for _ in range(40)]
    texts += ["", None, "  \t\n", "one two", "ONE two", "one  two", "three", texts[0], texts[0].upper(), "a b c d e " * 3000, "É é x y z", "é é x y z"]
    rows = list(enumerate(texts, 100))
    rnd.shuffle(rows)
    assert joined(spark, rows) == brute(rows)


def test_templates_recurse_to_leaves(spark, monkeypatch):
    """Documents of 5 of 16 paragraphs: large regions without any near pivot, compared pairs in proportion to the documents."""
    rnd = random.Random(3)
    paragraphs = [" ".join(f"w{p}_{k}" for k in range(30)) for p in range(16)]
    compared = []
    similar = ngram_join._similar

    def counting(pairs, sets):
        compared.append(pairs.count())
        return similar(pairs, sets)

    monkeypatch.setattr(ngram_join, "_similar", counting)
    per = {}
    for size in (150, 300):
        rows = [(i, " ".join(paragraphs[k] for k in sorted(rnd.sample(range(16), 5))) + f" own{i} tail{i}") for i in range(size)]
        compared.clear()
        assert joined(spark, rows) == brute(rows)
        per[size] = sum(compared) / size
    assert per[300] < 1.6 * per[150] and sum(compared) < 300 * 299 / 8


def test_regions_that_pivots_do_not_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    rnd = random.Random(9)
    rows = list(enumerate(t for size in (60, 30) for t in family(rnd, size, edits=14)))
    assert joined(spark, rows) == brute(rows)


def test_frequent_shingles_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 4000)
    monkeypatch.setattr(ngram_join, "LEAF", 3)
    rnd = random.Random(11)
    rows = list(enumerate(t for size in (30, 12, 5) for t in family(rnd, size)))
    assert joined(spark, rows) == brute(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert joined(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.components(df).collect()), key=str)
    assert got == sorted([(None, 1, None), (1, 1, 1), (1, 1, 1), (2, 0, 2)], key=str)
