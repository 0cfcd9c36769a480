"""Importance resampling towards a target distribution, over hashed n-grams.

Features are all runs of 1 to `order` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its bytes modulo `buckets`. Each
document is scanned once: its words, joined by one space, give a running CRC at the end of every word. With crc(a + b) = shift(crc(a), bytes of b) xor crc(b), where
`shift` multiplies by a power of x over GF(2), the CRC of any n-gram is the running CRC at its end xor the running one before its first word, shifted by the n-gram's
length: no n-gram is put together or read again. Long texts are scanned in parts that carry the running CRC and the last words' places.

A bucket's gain is the logarithm of its smoothed share in the target against that in the corpus, in thousandths; counts are summed per task before they are
shuffled, as one row per bucket. A document's weight is the sum of its features' gains, and its score adds Gumbel noise by the hash of its id: the `percent` % of highest
scores are a sample without replacement in proportion to exp(weight / 1000). They are ranked by a range partitioning of those rows that can be drawn, with each partition's
rows counted before it, so no task sees more than its range.

Null text: no words, weight 0. Null ids: their noise is that of an empty id, and they come last among ties; repeated rows are drawn and ranked each (ties in an order of their own). Extra columns are ignored,
whatever their names. No rows give no rows; an empty target makes all its counts 0. Bytes that aren't UTF-8 are taken as they stand.
"""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, by_size, table

#: Lower-cases A-Z, keeps digits, a-z and all bytes of other characters than ASCII's; any other byte parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text that are scanned at once.
PART = 1 << 20
#: Shifts by fewer bytes than this have a table each, longer ones are put together.
SHORT = 64


def _zeros() -> np.ndarray:
    """table[n, k, v]: what a CRC's byte k of value v becomes by a shift over n zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> 8)
    return out


ZEROS = _zeros()


def shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of texts that are followed by `size` bytes, without what those bytes add."""

    def apply(c, table, base=0):
        return table[base + (c & 255)] ^ table[base + 256 + (c >> 8 & 255)] ^ table[base + 512 + (c >> 16 & 255)] ^ table[base + 768 + (c >> 24)]

    crc, size = crc.astype(np.uint32), size.astype(np.int64)
    out = apply(crc, ZEROS.ravel(), (size % SHORT) * 1024)
    far, power = size // SHORT, ZEROS[SHORT]
    while far.any():
        odd = (far & 1).astype(bool)
        out[odd] = apply(out[odd], power.ravel())
        far, power = far >> 1, apply(power, power.ravel())
    return out


def features(text: bytes, order: int):
    """Parts of a text as (words, CRCs of all its n-grams that end in the part)."""
    crc, place, lo, first = 0, 0, 0, True
    starts, before = np.empty(0, np.int64), np.empty(0, np.uint32)  # of the last words
    while lo < len(text):
        hi = lo + PART
        data = text[lo:hi].translate(WORD_BYTES)
        while hi < len(text) and data[-1:] != b" ":  # a part ends between words
            more = text[hi : hi + 4096].translate(WORD_BYTES)
            cut = more.find(b" ") + 1 or len(more)
            data, hi = data + more[:cut], hi + cut
        lo, words = hi, data.split()
        if not words:
            continue
        spaced = [b" " + w for w in words]
        if first:
            spaced[0] = words[0]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = place + np.cumsum(sizes + 1) - first
        # Running CRCs at the words' ends; the space before a word is one step more.
        run = np.fromiter(accumulate(spaced, lambda c, w: zlib.crc32(w, c), initial=crc), np.uint32, len(words) + 1)
        at_start = _after_space(run[:-1])
        if first:
            at_start[0] = 0
        starts, before = np.concatenate([starts, ends - sizes]), np.concatenate([before, at_start])
        n, at = len(words), len(starts) - len(words)
        grams = []
        for back in range(order):
            skip = max(0, back - at)  # words that have too few before them
            i = slice(at - back + skip, len(starts) - back)
            grams.append(run[1 + skip :] ^ shift(before[i], ends[skip:] - starts[i]))
        yield n, np.concatenate(grams)
        crc, place, first = int(run[-1]), int(ends[-1]), False
        keep = max(0, order - 1)
        starts, before = starts[len(starts) - min(keep, len(starts)) :], before[len(before) - min(keep, len(before)) :]


def _after_space(crc: np.ndarray) -> np.ndarray:
    """CRCs of texts with one space more."""
    c = crc ^ np.uint32(0xFFFFFFFF)
    return (ZEROS[1, 0][(c ^ np.uint32(32)) & 255] ^ (c >> 8)) ^ np.uint32(0xFFFFFFFF)


def _tally(order: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in by_size(batch.column(0), PART):
                for text in texts:
                    for _, grams in features(text or b"", order):
                        total += np.bincount(grams % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def tally(texts: DataFrame, text_col: str, order: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; at most `buckets` rows come to the driver."""
    part = texts.select(text_col).mapInArrow(_tally(order, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over corpus share, both smoothed by one feature a bucket."""
    s, t, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = ((target + 1.0) * (s + buckets)) / ((corpus + 1.0) * (t + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weigh(gain: np.ndarray, order: int):
    def run(batches):
        for batch in batches:
            for lo, hi, texts in by_size(batch.column(1), PART):
                rows = np.zeros((len(texts), 3), np.int64)
                for row, text in zip(rows, texts, strict=True):
                    for words, grams in features(text or b"", order):
                        row += words, len(grams), gain[grams % len(gain)].sum()
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(rows[:, i].copy()) for i in range(3))], names=["id", "n_words", "n_features", "weight"])

    return run


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the hash of the seed and an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Id, n_features, weight, score and rank of every row; rank is null where the row isn't drawn."""
    scratch = Scratch(docs.sparkSession, "importance")
    gain = gains(tally(docs, text_col, order, buckets), tally(target, text_col, order, buckets))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_weigh(gain, order), "id long, n_words long, n_features long, weight long")
    rows = scratch.save(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    # The cut leaves a point of percentage more than can be drawn, ten times the sketch's error.
    share = 1 - min(100, percent + 1) / 100
    n, cut = rows.where(able).agg(F.count("*"), F.percentile_approx("score", share, 1000)).first()
    near = able & (F.col("score") >= F.lit(cut)) if n else F.lit(False)
    order_by = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    dealt = rows.where(near).repartitionByRange(*order_by).withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order_by))), "ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    ahead = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.col("place") + F.col("ahead")
    drawn = dealt.join(ahead, "part").withColumn("rank", F.when(rank <= percent * n // 100, rank))
    out = drawn.select("id", "n_features", "weight", "score", "rank").unionByName(rows.where(~near).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op11_importance_resampling`: 5 % of the documents, towards the texts of `benchmark`."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql() -> str:
    """The same in DuckDB: n-grams are put together and their CRCs computed byte by byte, once for each distinct n-gram."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
    bit = "case when (c & 1) = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end"
    # One row per value of a byte, made by eight steps.
    steps = "select v, v::bigint as c, 0 as k from range(256) r(v) union all select v, " + bit + ", k + 1 from crc_steps where k < 8"
    return f"""with recursive crc_steps as ({steps}), crc_table as (select list(c order by v) as t from crc_steps where k = 8),
d as (select doc_id, {words} as w from (select doc_id, coalesce(text, '') as text from documents)),
b as (select {words} as w from (select coalesce(text, '') as text from benchmark)),
dg as (select doc_id, unnest({grams}) as g from d), bg as (select unnest({grams}) as g from b),
dc as (select g, count(*) as n from dg group by g), bc as (select g, count(*) as n from bg group by g),
each as (select g, hex(encode(g)) as x from (select g from dc union select g from bc)),
hashed as (select g, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(x) // 2), lambda i: (('0x' || substr(x, 2 * i::int + 1, 2))::bigint))), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::bigint) % 10000)::int as bucket from each, crc_table),
s as (select bucket, sum(n) as n from dc join hashed using (g) group by bucket), t as (select bucket, sum(n) as n from bc join hashed using (g) group by bucket),
gain as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * (coalesce((select sum(n) from t), 0) + 10000)::double)))::bigint as gain
  from (select range::int as bucket from range(10000)) x left join s using (bucket) left join t using (bucket)),
weights as (select doc_id, sum(gain)::bigint as weight from dg join hashed using (g) join gain using (bucket) group by doc_id),
scored as (select doc_id, len(w) as n_words, (greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join weights using (doc_id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= 5 * (select count(*) from ranked) // 100 then place end as rank from scored left join ranked using (doc_id)"""
