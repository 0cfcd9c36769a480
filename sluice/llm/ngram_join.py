"""N-gram Jaccard join: an exact metric-space join of documents on their word shingles.

A document is a point of the Jaccard metric space (distance = 1 - similarity, a true metric). Documents
link at 100 * |intersection| >= 75 * |union|, that is within the radius r = 0.25.

1. *Shingles.* Every text is cut into words, its set is the distinct n-word shingles (64-bit hashes of
   the words' 64-bit hashes; all counts are of hashes). Equal sets within a batch of documents are put
   down once. The shingles are dealt by hash, counted, and only those that two sets share go back to
   their documents: a shingle nobody shares adds to a set's size and to no intersection.
2. *First pivots.* A document is within r of another only if they share one of its rarest
   n - ceil(0.75 n) + 1 shingles. Document pivots can't separate unrelated documents (all their distances
   are 1), so the first level's pivots are these single shingles: a one-shingle set {s} lies nearer than 1
   only to documents with s, and each document is replicated to the regions of its rarest shingles
   and to the two rings of set sizes that its window (the empty set as pivot) meets. Unshared shingles
   come first in the order, so nearly all documents reach no region at all.
3. *Regions.* Regions with the same members are joined once. A region of a few documents is joined pair
   by pair. A larger one gets several documents as pivots (the first ones in fixed orders) and all members' distances
   to them are computed exactly. Members within r of a pivot are linked, and are one component without
   further comparison. By the triangle inequality a member farther than 2r links with none of those, so only
   the boundary (r to 2r) is replicated to the pivot's ball once more, unless it has reached the pivot's component by
   then: there documents are joined on what they add to the pivot and what they lack of it, rarest first. All other
   members belong to the Voronoi region of their nearest pivot, with windows that replicate those near a border (see `_regions_of`), and
   these regions, cut into rings of distance, are joined recursively down to small ones. A region of which more than two thirds
   come out as one region again is joined on its members' shingles that are rarest within it.
4. *Components* of all links by alternating star rounds. Only pairs that pivots haven't put into one component are compared.

Every pair that links is compared, or both ends are linked to a common pivot. No document, shingle or
pair is left out at any size.

Nulls and empty texts: no shingles, linked with nothing; a null id gives a row with null component_id.
Repeated rows: one output row for each input row. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, by_size, connected_components, lean, shuffle_partitions, small, table

#: A part's shingle held by more sets than this is reported as frequent, with a count, not with postings.
FREQUENT = 256
#: Rank of shingles that are frequent in any batch: after all others.
LAST = 65535
#: Regions of at most this many documents are joined pair by pair; pivots of a larger one; copies of a set per task.
LEAF, PIVOTS, SPLIT = 12, 2, 2000
#: Words whose hashes a task remembers.
WORDS = 100_000
#: Bytes of text that a task holds as numbers at once, and whose shingles one bucket gets.
CHUNK, BUCKET = 2_000_000, 8_000_000
#: Rows that a task is handed at once: a few chunks of texts of 3 KB.
BATCH = 2_500
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class _WordHash(dict):
    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = h
        return h


def shingles(text: bytes | None, n: int, words: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles. Only A-Z are lower-cased."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    k = min(n, len(a))
    h = np.full(len(a) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ a[i : len(h) + i]) * np.uint64(MULTIPLIERS[i % 5])
        h ^= h >> np.uint64(29)
    h *= np.uint64(MULTIPLIERS[0])
    h ^= h >> np.uint64(32)
    return np.unique(h)


BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("ords", pa.binary()), ("keys", pa.binary()), ("extra", pa.binary())])
BLOCK_DDL = "bucket int, kind int, ids binary, ords binary, keys binary, extra binary"
#: Kinds of blocks: documents (ids, keys: set size and two key parts), postings (document after document; ids: packed, of the documents that the block names; ords: how many
#: postings each has, if not one), frequent shingles (keys), postings with a known rank (extra: ranks).
DOCS, POSTINGS, COUNTS, RANKED = range(4)


def _blocks(rows):
    return pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, r, strict=True)) for r in rows], BLOCK)


def _by_bucket(buckets, n, within=None):
    """(bucket, positions) for each bucket that occurs; positions in the order of `within`, so that equal values there stand together and compress."""
    order = np.argsort(buckets, kind="stable") if within is None else np.lexsort((within, buckets))
    edges = np.searchsorted(buckets[order], np.arange(n + 1))
    return [(i, order[edges[i] : edges[i + 1]]) for i in range(n) if edges[i] < edges[i + 1]]


def packed(ids: np.ndarray) -> bytes:
    """Ascending numbers as the first one and differences in as few bytes as all of them fit."""
    steps = np.diff(ids.view(np.uint64))
    most = int(steps.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + ids[:1].tobytes() + steps.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.uint64)
    return np.cumsum(np.r_[np.frombuffer(data[1:9], np.uint64), steps], dtype=np.uint64).view(np.int64)


def postings(at: np.ndarray) -> tuple[bytes, bytes]:
    """Ids and ords of a block. at: the documents of its postings in ascending order. Each is named once, so blocks get smaller as buckets get more."""
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    each = np.diff(np.r_[start, len(at)])
    ords = b"" if len(start) == len(at) else each.astype("<u1" if each.max() < 1 << 8 else "<u4").tobytes()
    return packed(at[start]), ords


def posted(ids: bytes, ords: bytes, rows: int) -> np.ndarray:
    """The postings' documents. rows: how many postings there are."""
    own = unpacked(ids)
    return own if len(own) == rows else np.repeat(own, np.frombuffer(ords, f"<u{len(ords) // len(own)}"))


def _bucket(keys, n):
    return ((keys >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def shingle_blocks(n: int, buckets: int):
    """Documents to blocks of set sizes and postings, dealt by hash."""

    def blocks_of(ids, texts, words):
        sets, keys, seen, first = [], np.zeros((len(ids), 3), np.int64), set(), []
        for i, text in enumerate(texts):
            s = shingles(text, n, words)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            keys[i] = len(s), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63
            if len(s) and d not in seen:
                seen.add(d)
                sets.append(s)
                first.append(i)
        for b, at in _by_bucket(_bucket(ids.view(np.uint64) * np.uint64(MULTIPLIERS[1]), buckets), buckets):
            yield b, DOCS, ids[at].tobytes(), b"", keys[at].tobytes(), b""
        if not sets:
            return
        order = np.argsort(ids[first], kind="stable")
        own, sets = ids[first][order], [sets[i] for i in order]
        h = np.concatenate(sets)
        o = np.repeat(own, [len(s) for s in sets])
        del sets
        u, counts = np.unique(h, return_counts=True)
        often = u[counts > FREQUENT]
        del u, counts
        if len(often):
            for b, at in _by_bucket(_bucket(often, buckets), buckets):
                yield b, COUNTS, b"", b"", often[at].tobytes(), b""
            hit = np.isin(h, often)
            yield int(ids[0] % buckets), RANKED, *postings(o[hit]), h[hit].tobytes(), b""
            h, o = h[~hit], o[~hit]
        for b, at in _by_bucket(_bucket(h, buckets), buckets):
            yield b, POSTINGS, *postings(o[at]), h[at].tobytes(), b""

    def run(batches):
        words = _WordHash()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, texts in by_size(batch.column(1), CHUNK):
                rows = list(blocks_of(ids[lo:hi], texts, words))
                for at in range(0, len(rows), 64):
                    yield _blocks(rows[at : at + 64])

    return run


def _read(batches):
    for batch in batches:
        for kind, *cells in zip(*(batch.column(c).to_pylist() for c in ("kind", "ids", "ords", "keys", "extra")), strict=True):
            yield kind, *cells


def shared_blocks(buckets: int):
    """The postings of a range of hashes to those that two sets share, with ranks, dealt by document."""

    def run(batches):
        ids, keys, often, rows = [], [], [], []
        for kind, i, o, k, x in _read(batches):
            if kind == DOCS:
                at = np.frombuffer(i, np.int64)
                k = np.frombuffer(k, np.int64).reshape(-1, 3)
                rows += [(b, DOCS, at[p].tobytes(), b"", k[p].tobytes(), b"") for b, p in _by_bucket(_bucket(at.view(np.uint64) * np.uint64(MULTIPLIERS[1]), buckets), buckets)]
            elif kind == COUNTS:
                often.append(np.frombuffer(k, np.uint64))
            else:
                k = np.frombuffer(k, np.uint64)
                at = posted(i, o, len(k))
                if kind == RANKED:
                    rows += [(b, RANKED, *postings(at[p]), k[p].tobytes(), np.full(len(p), LAST, np.uint16).tobytes()) for b, p in _by_bucket(_bucket(at.view(np.uint64) * np.uint64(MULTIPLIERS[1]), buckets), buckets, at)]
                else:
                    ids.append(at)
                    keys.append(k)
        if keys:
            h, at = np.concatenate(keys), np.concatenate(ids)
            del keys, ids
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[start, len(h)])
            rank = np.minimum(count, LAST - 1)
            if often:
                rank[np.isin(h[start], np.concatenate(often))] = LAST
            rank = np.repeat(rank.astype(np.uint16), count)
            keep = rank > 1
            h, at, rank = h[keep], at[keep], rank[keep]
            rows += [(b, RANKED, *postings(at[p]), h[p].tobytes(), rank[p].tobytes()) for b, p in _by_bucket(_bucket(at.view(np.uint64) * np.uint64(MULTIPLIERS[1]), buckets), buckets, at)]
        for lo in range(0, len(rows), 64):
            yield _blocks(rows[lo : lo + 64])

    return run


SET = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("shared", pa.list_(pa.int64())), ("prefix", pa.int32())])
SET_DDL = "id long, n long, k1 long, k2 long, shared array<long>, prefix int"


def sets_of_documents(percent: int):
    """One row per document: its size, key and, if it can link, its shared shingles from the rarest on."""

    def run(batches):
        docs, at, keys, ranks = [], [], [], []
        for kind, i, o, k, x in _read(batches):
            if kind == DOCS:
                docs.append((np.frombuffer(i, np.int64), np.frombuffer(k, np.int64).reshape(-1, 3)))
            else:
                keys.append(np.frombuffer(k, np.uint64))
                at.append(posted(i, o, len(keys[-1])))
                ranks.append(np.frombuffer(x, np.uint16))
        if not docs:
            return
        ids, k = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        h = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        rank = np.concatenate(ranks) if ranks else np.empty(0, np.uint16)
        order = np.lexsort((h, rank, at))
        at, h = at[order], h[order].view(np.int64)
        lo, hi = np.searchsorted(at, ids, "left"), np.searchsorted(at, ids, "right")
        given: set[int] = set()
        for part in range(0, len(ids), 2000):
            rows = []
            for j in range(part, min(part + 2000, len(ids))):
                n = int(k[j, 0])
                most = n - (percent * n + 99) // 100 + 1 - (n - int(hi[j] - lo[j]))
                row = [int(ids[j]), n, int(k[j, 1]), int(k[j, 2]), None, 0]
                if most > 0 and hi[j] > lo[j] and row[0] not in given:
                    given.add(row[0])
                    row[4:] = h[lo[j] : hi[j]], min(most, int(hi[j] - lo[j]))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(SET)], schema=SET)

    return run


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact intersection and union sizes. pairs: a saved table, so that Spark knows its size.

    Either side's sets are joined to the pairs alone: while the pairs are few, only the sets that they name are shuffled.
    """
    pairs = small(pairs)
    side = lambda c: pairs.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"s_{c}")), c).select("a", "b", f"n_{c}", f"s_{c}")
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return side("a").join(side("b"), ["a", "b"]).select("a", "b", common.alias("common"), (F.col("n_a") + F.col("n_b") - common).alias("union"))


def _around_pivots(around: DataFrame, reps: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that may link among documents within 2r of a common pivot, where components are still apart.

    around: (a, b: pivot, linked, common). Seen from the pivot p, a document x is what it adds and what it lacks, and
    |x & z| = |x & p| + |z & p| - |p| + (shared additions and lacks). Two documents that p doesn't already
    prove linked must share s of these differences, so they meet in the first |differences| - s + 1 of them, the
    rarest additions first and the lacks last.
    """
    unit = 100 + percent
    own = reps.select(F.col("id").alias("a"), "n", F.col("shared").alias("s_a"))
    piv = reps.select(F.col("id").alias("b"), F.col("n").alias("n_p"), F.col("shared").alias("s_p"))
    part = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    x = around.join(part("a"), "a", "left").join(part("b"), "b", "left").withColumns({"part_a": F.coalesce("part_a", "a"), "part_b": F.coalesce("part_b", "b")})
    x = scratch.save(x, "around").join(own, "a").withColumns({"g": percent * F.col("n") - unit * F.col("common"), "out": ~F.col("linked") & (F.col("part_a") != F.col("part_b"))})
    low_out = x.where("out").groupBy("b").agg(F.min("g").alias("g_out"))
    x = x.join(low_out, "b").join(piv, "b").withColumn("size", F.col("n") + F.col("n_p") - 2 * F.col("common"))
    shares = lambda g: F.ceil((F.col("g") + F.col(g)) / unit) + F.col("n_p")
    x = x.where(F.col("out") | (shares("g_out") <= F.col("size")))
    low = x.groupBy("b").agg(F.min("g").alias("g_all"), F.min_by("a", "g").alias("closest"))
    x = x.join(low, "b").withColumn("s", F.when(F.col("out"), shares("g_all")).otherwise(shares("g_out")))
    sure = x.where((F.col("s") <= 0) & (F.col("a") != F.col("closest"))).select(F.least("a", "closest").alias("a"), F.greatest("a", "closest").alias("b"))
    lacks = F.transform(F.array_except("s_p", "s_a"), lambda e: F.bitwise_not(e))
    tail = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_p") - F.size("s_p"), F.lit(1))), lambda k: F.xxhash64(F.lit("own"), k))
    tail = F.slice(tail, F.lit(1), (F.col("n_p") - F.size("s_p")).cast("int"))
    length = F.col("size") - F.greatest(F.col("s"), F.lit(1)) + 1 - (F.col("n") - F.size("s_a"))
    e = F.posexplode(F.slice(F.concat(F.array_except("s_a", "s_p"), lacks, tail), F.lit(1), F.greatest(length, F.lit(0)).cast("int")))
    x = x.select("b", "a", "n", "n_p", "g", "out", "part_a", (F.col("size") - F.col("n") + F.size("s_a")).alias("listed"), e.alias("i", "e"))
    x = x.withColumn("after", F.col("listed") - F.col("i")).drop("listed", "i")  # differences from this one on
    left, right = x.where("out"), x.select("b", "e", F.col("a").alias("c"), F.col("n").alias("n_c"), F.col("g").alias("g_c"), F.col("part_a").alias("part_c"), F.col("after").alias("after_c"))
    sizes = 100 * F.least("n", "n_c") >= percent * F.greatest("n", "n_c")
    # If this is the first one that both have, all that they share is from here on.
    enough = unit * F.least("after", "after_c") >= F.col("g") + F.col("g_c") + unit * F.col("n_p")
    met = left.join(right, ["b", "e"]).where((F.col("part_a") != F.col("part_c")) & sizes & enough)
    return met.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).union(sure).distinct()


def _without_own(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are not in one component yet."""
    part = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    x = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left")
    return x.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def _pairs_within(m: DataFrame, percent: int) -> DataFrame:
    """All pairs of each small region whose sizes allow a link, but for those close to one pivot."""
    x = m.select("region", F.col("id").alias("a"), F.col("n").alias("na"), F.col("near").alias("pa"))
    y = m.select("region", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("near").alias("pb"))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return x.join(y, "region").where((F.col("a") < F.col("b")) & sizes & ~F.arrays_overlap("pa", "pb")).select("a", "b").distinct()


def _pairs_by_prefix(m: DataFrame, core: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link in regions that pivots don't split: they meet in one of their shingles that are rarest within the region."""
    x = m.select("region", "id", "near").join(core.select("id", "n", "shared"), "id").select("region", "id", "n", "near", F.explode("shared").alias("s"))
    often = x.groupBy("region", "s").agg(F.count("*").alias("c")).where("c > 1")
    by = Window.partitionBy("region", "id")
    x = x.join(often, ["region", "s"]).withColumns({"at": F.row_number().over(by.orderBy("c", "s")), "m": F.count("*").over(by)})
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    x = x.where(F.col("at") <= F.col("m") - need + 1).select("region", "s", "id", "n", "near", (F.col("m") - F.col("at") + 1).alias("left"))
    a, b = (x.select("region", "s", *(F.col(k).alias(f"{k}_{c}") for k in ("id", "n", "near", "left"))) for c in "ab")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # Seen from the first one that both have, all that they share is from there on.
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))
    met = a.join(b, ["region", "s"]).where((F.col("id_a") < F.col("id_b")) & sizes & enough & ~F.arrays_overlap("near_a", "near_b"))
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _regions_of(big: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The next level's regions: (region, id, n, near, close, was) of the members that no pivot of their region is linked to.

    big: (region, size, most: largest set, pivots, id, n, near); found: (a, b: pivot, delta: shingles that only one of them has, linked, close). Two documents that link
    differ in at most u * (n + n') shingles, u = (1 - t) / (1 + t). The count of differing shingles is a metric too, with a sharper window than the Jaccard distance has, so
    a member belongs to its nearest pivot's region (equal: of smallest id) and, if one of another pivot may link with it, to that one's: not farther than the nearest by
    more than twice the most that it can differ. Within a pivot's region, rings of distance are cut where no link can cross, at gaps, and
    else every three windows, with the first window of a ring in the ring before as well.
    """
    u = (100 - percent) / (100 + percent)
    x = big.select("region", "size", "most", "id", "n", "near", F.explode("pivots").alias("b"))
    x = x.join(found.withColumnRenamed("a", "id"), ["id", "b"], "left")
    own = F.col("id") == F.col("b")
    to = F.struct(F.col("delta"), F.col("b"), F.col("close"))
    x = x.groupBy("region", "id").agg(
        *(F.first(c).alias(c) for c in ("size", "most", "n", "near")), F.max(F.coalesce("linked", own)).alias("inside"), F.collect_list(F.when(~own, to)).alias("to")
    ).where("not inside")
    reach = u * (F.col("n") + F.least("most", F.col("n") * 100 / percent)) + 1e-6
    x = x.withColumns({"home": F.array_min("to"), "near": F.array_union("near", F.transform(F.filter("to", lambda t: t["close"]), lambda t: t["b"]))})
    boundary = lambda t: (t["b"] == F.col("home.b")) | (t["b"] < F.col("home.b")) & (t["delta"] <= F.col("home.delta") + 2 * reach)
    x = x.select("region", "size", "most", "id", "n", "near", F.inline(F.filter("to", boundary)))
    window = F.ceil(2 * u * F.max("most") + 1e-6)
    rings = x.groupBy("region", "b", "delta").agg(window.alias("window"))  # a row per distance that occurs
    by = Window.partitionBy("region", "b").orderBy("delta")
    rings = rings.withColumn("gap", F.col("delta") - F.lag("delta").over(by))
    rings = rings.withColumn("start", F.max(F.when(F.col("gap").isNull() | (F.col("gap") > F.col("window")), F.col("delta"))).over(by))
    i = F.floor((F.col("delta") - F.col("start")) / (3 * F.col("window")))
    again = (i > 0) & (F.col("delta") - F.col("start") - i * 3 * F.col("window") < F.col("window"))
    rings = rings.select("region", "b", "delta", "start", F.explode(F.when(again, F.array(i, i - 1)).otherwise(F.array(i))).alias("ring"))
    x = x.join(rings, ["region", "b", "delta"])
    return x.select(F.xxhash64("region", "b", "start", "ring").alias("region"), "id", "n", "near", "close", F.col("size").alias("was"))


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """n_shingles and component_id of every row of `docs`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET))  # what a task holds doesn't grow with the table
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = rows.where("id is not null").mapInArrow(lean(shingle_blocks(n, buckets)), BLOCK_DDL)
    blocks = scratch.save(blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(shared_blocks(buckets)), BLOCK_DDL), "shared", BATCH)
    scratch.release()
    found = scratch.save(blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(sets_of_documents(percent)), SET_DDL), "found")
    scratch.drop(blocks)
    sets = scratch.save(found.select("id", "n", "k1", "k2", F.col("shared").isNotNull().alias("whole")), "sets")
    # Equal sets are one point; only a copy that carries its shingles can stand for it.
    points = sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("low"), F.min(F.when(F.col("whole"), F.col("id"))).alias("point"), F.count("*").alias("copies"))
    points = scratch.save(points, "equal")
    reps = found.where("shared is not null").join(points.where("point is not null").select(F.col("point").alias("id"), "low"), "id")
    reps = scratch.save(reps.select(F.col("low").alias("id"), "n", "shared", "prefix"), "points")
    scratch.drop(found)
    scratch.release()
    linked = (F.col("common") * 100 >= F.lit(percent) * F.col("union")).alias("linked")
    in_ring = math.log(100 / percent) * 1.001
    post = reps.select("id", "n", F.explode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("s"))
    ring = F.floor(F.log("n") / in_ring)
    post = post.withColumn("ring", F.explode(F.array(ring, ring + 1)))
    post = scratch.save(post.select("s", "ring", "id", "n"), "postings")
    regions = post.groupBy("s", "ring").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.expr("bit_xor(xxhash64(id))").alias("x1"), F.expr("bit_xor(xxhash64(id, 1))").alias("x2")).where("size > 1")
    same = regions.groupBy("size", "low", "x1", "x2").agg(F.min(F.struct("s", "ring")).alias("r"))
    same = scratch.save(same.select(F.col("r.s").alias("s"), F.col("r.ring").alias("ring"), F.xxhash64("r.s", "r.ring").alias("region")), "regions")
    members = post.join(small(same), ["s", "ring"]).select("region", "id", "n", F.array().cast("array<long>").alias("near"), F.lit(False).alias("close"), F.lit(None).cast("long").alias("was"))
    live = scratch.save(members, "live")
    scratch.drop(post)
    scratch.drop(same)
    named = scratch.save(live.select("id").distinct(), "named")
    core = scratch.save(reps.join(small(named), "id", "left_semi"), "core")
    scratch.drop(reps)
    scratch.release()
    links, near, pairs = [], [], []
    while True:
        # The same orders in all regions: regions of one group of near copies then mostly share their pivots.
        first = [F.min("id"), *(F.min(F.struct(F.xxhash64("id", F.lit(j)), "id"))["id"] for j in range(1, PIVOTS))]
        sizes = live.groupBy("region").agg(F.count("*").alias("size"), F.max("n").alias("most"), F.max("was").alias("was"), F.every("close").alias("done"), F.array_distinct(F.array(*first)).alias("pivots"))
        # Members that are all close to one pivot are joined around it; a region that is hardly smaller than the one before isn't split again.
        stuck = F.coalesce(F.col("size") * 3 > F.col("was") * 2, F.lit(False))
        way = F.when(F.col("size") <= LEAF, "pairs").when(stuck, "prefix").otherwise("pivots")
        sizes = scratch.save(sizes.where("size > 1 and not done").select("region", "size", "most", "pivots", way.alias("way")), "sizes")
        ways = {r[0] for r in sizes.select("way").distinct().collect()}
        step = lambda w: live.select("region", "id", "n", "near").join(sizes.where(F.col("way") == w), "region")  # noqa: B023, E731
        if "pairs" in ways:
            pairs.append(scratch.save(_pairs_within(step("pairs"), percent), "pairs"))
        if "prefix" in ways:
            pairs.append(scratch.save(_pairs_by_prefix(step("prefix"), core, percent), "pairs"))
        if "pivots" not in ways:
            break
        asked = scratch.save(step("pivots").select(F.col("id").alias("a"), F.explode("pivots").alias("b")).where("a <> b").distinct(), "asked")
        close = (100 * F.col("common") >= (2 * percent - 100) * F.col("union")).alias("close")
        seen = scratch.save(_similar(asked, core).select("a", "b", linked, "common", close, (F.col("union") - F.col("common")).alias("delta")), "pivots")
        scratch.drop(asked)
        links.append(seen.where("linked").select("a", "b"))
        near.append(seen.where("close").select("a", "b", "linked", "common"))
        last, live = live, scratch.save(_regions_of(step("pivots"), seen.select("a", "b", "delta", "linked", "close"), percent), "live")
        scratch.drop(last)
        scratch.drop(sizes)
        scratch.release()
    by_pivots = links[0] if links else spark.createDataFrame([], "a long, b long")
    for x in links[1:]:
        by_pivots = by_pivots.union(x)
    parts = scratch.save(connected_components(by_pivots, scratch), "parts")
    scratch.release()
    if near:
        around = near[0]
        for x in near[1:]:
            around = around.union(x)
        pairs.append(_around_pivots(around.distinct(), core, parts, percent, scratch))
    if pairs:
        every = pairs[0]
        for x in pairs[1:]:
            every = every.union(x)
        every = scratch.save(_without_own(every.distinct(), parts), "apart")
        scratch.release()
        more = scratch.save(_similar(every, core).select("a", "b", linked).where("linked").select("a", "b"), "links")
        star = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        parts = scratch.save(connected_components(star.union(more), scratch), "parts")
    scratch.drop(core)
    named = points.join(parts.withColumnRenamed("node", "low"), "low", "left").select("k1", "k2", "n", F.coalesce("component", "low").alias("component_id"), F.ceil(F.col("copies") / SPLIT).alias("cuts"))
    # A set of very many copies is dealt to several tasks.
    cuts = points.where(F.col("copies") > SPLIT).select("k1", "k2", "n", F.ceil(F.col("copies") / SPLIT).alias("cuts"))
    keyed = sets.select("id", "n", "k1", "k2").join(cuts, ["k1", "k2", "n"], "left").withColumn("cut", F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("cuts"))).otherwise(0)).drop("cuts")
    named = named.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).drop("cuts")
    out = keyed.join(named, ["k1", "k2", "n", "cut"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    count = rows.where("id is null").select("id", "text").mapInArrow(_sizes(n), "n long")
    return out.union(count.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))


def _sizes(n):
    def run(batches):
        words = _WordHash()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingles(t, n, words)) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.int64())], names=["n"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op8_ngram_jaccard_join`: all documents, five words, similarity 0.75."""
    return components(table(spark, sf_dir, "documents"))
