"""The pipeline, stage by stage and as a whole."""

import corpus_pipeline
from sluice.llm import quality
from tests.conftest import SMALL
from tests.llm.test_ngram_join import brute


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    start = docs.columns
    good = corpus_pipeline.keep_quality(spark, docs, SMALL)
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    judged = quality.scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids == {r.doc_id for r in judged.where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = corpus_pipeline.drop_near_duplicates(spark, good, SMALL)
    kept = {r.doc_id for r in one.collect()}
    assert kept == {i for i, (_, low) in brute(rows).items() if i == low}
    masked = corpus_pipeline.mask_secrets(spark, one, SMALL)
    before, after = {r.doc_id: r for r in one.collect()}, {r.doc_id: r for r in masked.collect()}
    assert before.keys() == after.keys()
    assert all("[SECRET]" in after[i].text and after[i].n_chars == len(after[i].text) for i in before if before[i].text != after[i].text)
    mixed = corpus_pipeline.mix_sources(spark, masked, SMALL)
    for df in (good, one, masked, mixed):
        assert df.columns == start
    assert mixed.count() > 0


def test_odd_rows_and_clashing_columns(spark):
    """Null ids and texts, repeated rows, an id with two texts, ties and columns named like the stages' own ones."""
    from pyspark.sql import functions as F

    text = "the same words of a text that is long enough for more than five of them"
    rows = [(None, text), (None, None), (1, text), (1, text), (2, f"{text} x"), (3, "other words " * 40), (3, "and a second text of this id"), (4, None), (5, ""), (6, "z " * 20_000)]
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("domain", "epoch", "id", "row", "kept_id", "kept_rows", "place", "value", "score", "token", "piece", "component_id", "n_shingles", "cut")
    docs = docs.withColumns({c: F.lit(c) for c in clash})
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    kept = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 3, 4, 5, 6] and sum(i is None for i, _ in kept) == 2
    again = corpus_pipeline.drop_near_duplicates(spark, docs.orderBy(F.desc("n_chars")), SMALL)
    assert sorted(map(str, kept)) == sorted(str((r.doc_id, r.text)) for r in again.collect())
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SMALL)
        assert at.columns == docs.columns, name
        assert all(r[c] == c for r in at.select(*clash).collect() for c in clash)
    packed = corpus_pipeline.pack_sequences(spark, at, SMALL).collect()
    assert len({(r.row, r.piece) for r in packed}) == len(packed)


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert rows and max(used.values()) <= 4096
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
