"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

1. *Counts.* Words and word pairs of all training documents are counted per chunk of text, dealt into buckets by the hash of the (first) word
   and added up there. Words that would fill a bucket by themselves (chosen from about `sample_docs` documents; the choice changes no result) are hot: pairs that begin with one
   are dealt by the hash of the pair instead, and what those pairs take from its probability is summed over all buckets. There is a bucket for every `bucket_bytes` of text, and a task takes one bucket at a time.
2. *Filter.* A count c is quantised to the level floor(log_b c), and for each level from 0 to its own one entry (n-gram, level) is set in a Bloom filter: a reader
   probes level after level until a miss. Every word and every pair that occurs is kept. Each bucket has a segment of `bits_per_entry` bits
   per entry, so the filter grows with the corpus and its error rate doesn't: with the default of 8 bits and 4 hashes, a probe of what was not set
   hits in 2.4 % of all cases.
3. *Scores.* While all segments together have at most `most_bytes`, the filter is broadcast. Beyond that, each chunk asks the buckets for the
   levels of its distinct pairs (8 bytes each) and for the counts and weights of its distinct words, and gets a byte a pair back, in the order of
   the question; the chunk's numbered tokens go along to where its answers meet. That is done for a part of the documents after the other
   (`ROUNDS`), so that only a part's questions are on disk at once. Both ways probe the same segments and give the same scores.

Probabilities: P(w | v) = (c(v w) - d) / c(v) for pairs in the filter + a(v) * P0(w), where a(v) is the weight that the discounted pairs of
v leave, quantised in the filter as well (hot words' weights are broadcast), and P0(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). The most frequent words (at most
`head_words`) are broadcast with exact counts; other words' counts come from the filter.

`base_score` and `n_known` use exact counts of every token: frequent words' from the broadcast, all others by dealing
(document, word, count) postings to the words' counts by hash and adding up per document.

Null or empty text: the end token alone. Null ids: never held out. Repeated rows are counted and scored each. Other columns are ignored.
Words are told apart by 64-bit hashes, rows by id and a 64-bit hash of their text. Without training rows all counts are 0.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, by_size, lean, shuffle_partitions, table

BASE, DISCOUNT, STEP, HASHES, MAX_LEVEL = 1.5, 0.6, 0.25, 4, 110
WORDS = 250_000
END = np.uint64(0x9E3779B97F4A7C15)
WEIGHT = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1_500_000  # bytes of text that a task holds as numbers at once, while there are few buckets
ROUNDS = 4  # parts of the documents that ask the buckets one after another
K1, K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * K1
    x = (x ^ (x >> np.uint64(27))) * K2
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xC2B2AE3D27D4EB4F) + second)


class _WordHash(dict):
    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = h
        return h


def token_arrays(texts: list[bytes | None], words: _WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts one after another, each text closed by END; and tokens per text."""
    split = [(t or b"").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    return np.insert(flat, np.cumsum(sizes), END), sizes + 1


def with_contexts(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in order, the place of each token among them, and that of the token before it (END before the first of a text)."""
    u, at = np.unique(tokens, return_inverse=True)
    return u, at, places_before(u, at)


def places_before(u: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.empty_like(at)
    before[1:] = at[:-1]
    if len(at):
        before[0] = np.searchsorted(u, END)
    return before


def _split(buckets: np.ndarray, n: int):
    order, edges = _dealt(buckets, n)
    return [(i, order[edges[i] : edges[i + 1]]) for i in range(n) if edges[i] < edges[i + 1]]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _dealt(buckets: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """The order by bucket, and where in it each bucket begins."""
    order = np.argsort(buckets.astype(np.min_scalar_type(n)), kind="stable")  # 16 bits are sorted by their digits
    return order, np.cumsum(np.bincount(buckets + 1, minlength=n + 1)).tolist()


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. np.unique without further answers hashes, which takes many times as long here."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def chunk_bytes(buckets: int) -> int:
    """Text that a task holds as numbers at once: more while it is dealt to many buckets, so that blocks don't become tiny."""
    return CHUNK * min(5, max(1, buckets // 64))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest one needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // max(n, 1) or 1}").astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers under 2 ** 32 as all their lowest bytes, then all their next ones: the high ones are mostly 0 and compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcde")])
BLOCK_DDL = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
#: A bucket's answer to a chunk: levels of its pairs, counts, levels and weights of its words; or, as bucket -1, the chunk itself.
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in "abcd")])
ANSWER_DDL = "chunk long, bucket int, a binary, b binary, c binary, d binary"
#: Kinds of blocks, in the order in which a bucket's task reads them: words and counts, filter segment, a chunk's counted words and pairs,
#: postings of words, a chunk's questions, chunks that wait for answers, parts of documents.
WORD, SEGMENT, PAIR, POST, ASK, KEEP, DOC, MASS = range(8)
#: Least share of all tokens of a hot word: there are at most this many.
MOST_HOT = 100_000
#: Rows of a chunk: id (0 for null), whether there is an id, hash of the text; and their sums, all over `copies` equal rows.
ROWS = np.dtype([("id", "<i8"), ("named", "<i8"), ("text", "<i8")])
#: Where a posting counts: the chunk's document and how often.
PLACES = np.dtype([("doc", "<i4"), ("n", "<f8")])
SUMS = ("copies", "n_tokens", "n_known", "base", "score")
PART_DDL = "id long, named boolean, text long, copies double, n_tokens double, n_known double, base double, score double"


def _emit(rows, step: int = 48, schema: pa.Schema = BLOCK):
    for lo in range(0, len(rows), step):
        cols = list(zip(*((*r, *[b""] * (len(schema) - len(r))) for r in rows[lo : lo + step]), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _blocks(batches):
    """The blocks of a task as (bucket, kind, arrays), or the answers as (chunk, bucket, arrays), one at a time."""
    for batch in batches:
        for i in range(len(batch)):
            yield tuple(column[i].as_py() for column in batch.columns)


def _in_order(df: DataFrame, parts: int) -> DataFrame:
    """Blocks dealt by bucket, and in each task bucket after bucket, kind after kind."""
    return df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")


def level_of(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def value_of(level: np.ndarray) -> np.ndarray:
    """Mean of the whole numbers of each level."""
    lo, hi = np.ceil(BASE**level - 1e-6), np.ceil(BASE ** (level + 1) - 1e-6) - 1
    return np.maximum((lo + np.maximum(hi, lo)) / 2, 1)


def weight_level(weight: np.ndarray) -> np.ndarray:
    return np.rint(-np.log(weight) / STEP).astype(np.int64)


def hashed(keys: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of each (key, level) entry, which give its bits for all hash functions. level: a number, or one per key."""
    h = mix(keys + (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * K2)
    return h, mix(h) | np.uint64(1)


def bit_of(h: np.ndarray, bits) -> np.ndarray:
    """The bit of each hash. bits (of the segment, under 2 ** 32): a number, or one per hash."""
    return ((h >> np.uint64(32)) * bits) >> np.uint64(32)


def position(keys: np.ndarray, level, i: int, bits) -> np.ndarray:
    """The bit of each (key, level) entry for the i-th hash function alone."""
    h, step = hashed(keys, level)
    return bit_of(h + np.uint64(i) * step, bits)


def segment_of(keys: list[np.ndarray], levels: list[np.ndarray], bits_per_entry: float) -> bytes:
    """A Bloom filter of all entries (key, 0) to (key, level)."""
    entries = int(sum((v + 1).sum() for v in levels))
    size = max(8, math.ceil(entries * bits_per_entry / 8))
    flags = np.zeros(size * 8, bool)
    for key, level in zip(keys, levels, strict=True):
        for v in range(int(level.max(initial=-1)) + 1):
            key, level = key[level >= v], level[level >= v]
            h, step = hashed(key, v)
            for _ in range(HASHES):
                flags[bit_of(h, np.uint64(size * 8)).view(np.int64)] = True
                h = h + step
    return np.packbits(flags, bitorder="little").tobytes()


class Filter:
    """Segments of the filter one after another. sizes: bytes of each bucket's segment; segments: (bucket, segment), in any order."""

    def __init__(self, sizes: dict[int, int], buckets: int, segments):
        self.buckets = buckets
        each = np.array([sizes.get(b, 0) for b in range(buckets)], np.int64)
        self.start, self.bits = np.cumsum(each) - each, (each * 8).astype(np.uint64)
        self.flags = np.zeros(int(each.sum()), np.uint8)
        for b, segment in segments:
            self.flags[self.start[b] : self.start[b] + each[b]] = np.frombuffer(segment, np.uint8)

    @classmethod
    def single(cls, segment: bytes) -> Filter:
        """One bucket's segment, for keys of that bucket."""
        return cls({0: len(segment)}, 1, [(0, segment)])

    def level(self, keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Number of levels found for each key by repeated probes: 0 if not in the filter. heads: the words whose buckets hold the keys."""
        at = _bucket(heads, self.buckets)
        out, alive = np.zeros(len(keys), np.int64), np.flatnonzero(self.bits[at] > 0)
        keys, bits, start = keys[alive], self.bits[at[alive]], self.start[at[alive]]
        for level in range(MAX_LEVEL):
            if not len(alive):
                return out
            h, step = hashed(keys, level)
            for _ in range(HASHES):
                p = bit_of(h, bits).view(np.int64)
                hit = np.flatnonzero((self.flags[start + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1)
                if len(hit) < len(alive):
                    keys, bits, start, alive, h, step = keys[hit], bits[hit], start[hit], alive[hit], h[hit], step[hit]
                h = h + step
            out[alive] += 1
        return out


class Model:
    """What every task knows: the most frequent words with their counts, hot words with their weights, the totals and, if it is small enough, the filter."""

    def __init__(self, head, head_counts, hot, hot_counts, hot_weights, total: int, distinct: int, filter_: Filter | None):
        self.head, self.head_counts, self.floor, self.filter = head, head_counts, total + 0.5 * (distinct + 1), filter_
        self.hot, self.hot_counts, self.hot_weights = hot, value_of(level_of(hot_counts)), hot_weights  # counts as the filter has them

    def exact(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether words are among the most frequent ones, and those ones' counts."""
        if not len(self.head):
            return np.zeros(len(words), bool), np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        known = self.head[at] == words
        return known, np.where(known, self.head_counts[at], 0.0)

    def counts(self, words: np.ndarray, known: np.ndarray, count: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Counts of words: exact for frequent ones (`known`, `count`), else from the level found in the filter, 0 if in neither."""
        out = np.where(known, count, np.where(level > 0, value_of(level - 1), 0.0))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
            out = np.where(~known & (self.hot[at] == words), self.hot_counts[at], out)
        return out

    def probability(self, first: np.ndarray, seen: np.ndarray, weight_level: np.ndarray, of: np.ndarray, level: np.ndarray, p0: np.ndarray) -> np.ndarray:
        """P(second | first) of distinct pairs from the levels found in the filter. first: distinct first words, with their counts and weights; of: their place for each pair; p0: P0 of the second words."""
        weight = np.exp(-STEP * np.maximum(0, weight_level - 1))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            weight = np.where(self.hot[at] == first, self.hot_weights[at], weight)
        seen = np.maximum(seen, 1.0)[of]
        found = np.where(level > 0, value_of(level - 1) - DISCOUNT, 0.0)
        return np.minimum(1.0, np.minimum(found, seen) / seen + weight[of] * p0)


def places(hot: np.ndarray, first: np.ndarray, pair: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """What decides a pair's bucket: its first word, or the pair itself if that is hot. of: the place of each pair's first word in `first`, if those are distinct words."""
    each = first if of is None else first[of]
    if not len(hot):
        return each
    warm = np.isin(first, hot)
    return np.where(warm if of is None else warm[of], pair, each)


def _frequencies(batches):
    """Words of a sample and how often they come."""
    words = _WordHash()
    for batch in batches:
        for _, _, texts in by_size(batch.column(0), CHUNK):
            u, n = np.unique(token_arrays(texts, words)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["word", "n"])


def hot_words(training: DataFrame, sample_docs: int, buckets: int) -> np.ndarray:
    """Words of which a sample suggests that the pairs that begin with them would fill half a bucket; fewer than 2 * buckets and MOST_HOT."""
    share = max(1, training.count() // sample_docs)
    chosen = training.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(share)) == 0).select("text")
    counts = chosen.mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > total / min(2 * buckets, MOST_HOT)).select("word").collect()
    return np.sort(np.array([r.word for r in found], np.int64).view(np.uint64))


def pairs_and_buckets(u: np.ndarray, code: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and buckets of pairs. code: places of both words in u."""
    of = code // len(u)
    key = pair_keys(u[of], u[code % len(u)])
    return key, _bucket(places(hot, u, key, of), buckets)


def _count(buckets: int, hot: np.ndarray, chunk: int = CHUNK):
    def run(batches):
        words = _WordHash()
        for batch in batches:
            for _, _, texts in by_size(batch.column(0), chunk):
                tokens, _ = token_arrays(texts, words)
                u, at, before = with_contexts(tokens)
                code, c = np.unique(before * len(u) + at, return_counts=True)  # in the order of first words
                key, bucket = pairs_and_buckets(u, code, hot, buckets)
                order, edges = _dealt(bucket, buckets)
                key, c = key[order], c[order]
                # A block names each word once: those that it counts, and hot words, which are counted elsewhere (0 here), before their pairs.
                firsts, runs = np.unique((bucket * len(u) + code // len(u))[order], return_counts=True)
                own = _bucket(u, buckets) * len(u) + np.arange(len(u))
                named = distinct(np.concatenate([firsts, own]))
                n, of = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
                n[np.searchsorted(named, own)], of[np.searchsorted(named, firsts)] = np.bincount(at), runs
                starts = np.searchsorted(named, np.arange(buckets + 1) * len(u)).tolist()
                named = u[named % len(u)]
                yield from _emit([
                    (b, PAIR, key[p].tobytes(), _narrow(c[p]), named[w].tobytes(), _narrow(of[w]), _narrow(n[w]))
                    for b in range(buckets) if starts[b] < starts[b + 1] for p, w in [(slice(*edges[b : b + 2]), slice(*starts[b : b + 2]))]
                ])

    return run


def _merge(parts: list[tuple]) -> tuple:
    """Sorted distinct keys with added counts, and any further arrays that are functions of the key."""
    key, count, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(count, start), *(m[order][start] for m in more)


class _Sum:
    """Parts of counts, merged whenever those that wait hold more rows than what is merged."""

    def __init__(self):
        self.done, self.parts, self.rows = None, [], 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.rows += len(part[0])
        if self.rows > max(1_000_000, len(self.done[0]) if self.done else 0):
            self.get()

    def get(self) -> tuple | None:
        if self.parts:
            self.done = _merge([self.done, *self.parts] if self.done else self.parts)
            self.parts, self.rows = [], 0
        return self.done


def _add_up(bits_per_entry: float, hot: np.ndarray):
    """Each bucket's counted words and pairs to its words' counts, its filter segment, and its part of what pairs take from hot words."""

    def close(bucket, words, pairs):
        key, count = words.get() or (np.empty(0, np.uint64), np.empty(0, np.int64))
        level = level_of(count)
        keys, levels = [key], [level]
        if (found := pairs.get()) is not None:
            pair, c, first = found
            pl = level_of(c)
            heads, inverse = np.unique(first, return_inverse=True)
            mass = np.bincount(inverse, value_of(pl) - DISCOUNT, len(heads))
            warm = np.isin(heads, hot)
            if warm.any():
                yield from _emit([(bucket, MASS, heads[warm].tobytes(), mass[warm].tobytes())])
            heads, mass = heads[~warm], mass[~warm]
            of = count[np.searchsorted(key, heads)].astype(np.float64) if len(heads) else mass  # END closes every text, so every first word is a token
            keys += [pair, mix(heads ^ WEIGHT)]
            levels += [pl, weight_level(np.clip(1 - mass / of, 0.01, 1))]
        segment = segment_of(keys, levels, bits_per_entry)
        rows = [(bucket, WORD, key[lo : lo + 200_000].tobytes(), count[lo : lo + 200_000].tobytes()) for lo in range(0, len(key), 200_000)]
        yield from _emit([*rows, (bucket, SEGMENT, segment)], 1)

    def run(batches):
        last, words, pairs = None, _Sum(), _Sum()
        for bucket, _, a, b, c, d, e in _blocks(batches):
            if bucket != last and last is not None:
                yield from close(last, words, pairs)
                words, pairs = _Sum(), _Sum()
            last = bucket
            key, word = np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint64)
            n = _wide(e, len(word))
            if n.any():
                words.add(word[n > 0], n[n > 0])
            if len(key):
                pairs.add(key, _wide(b, len(key)), np.repeat(word, _wide(d, len(word))))
        if last is not None:
            yield from close(last, words, pairs)

    return run


def _levels(batches):
    """Number of words and of tokens of each level."""
    n, t = np.zeros(MAX_LEVEL + 1, np.int64), np.zeros(MAX_LEVEL + 1, np.int64)
    for _, kind, _, b, *_ in _blocks(batches):
        if kind == WORD:
            c = np.frombuffer(b, np.int64)
            level = level_of(c)
            n += np.bincount(level, minlength=MAX_LEVEL + 1)
            np.add.at(t, level, c)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(t[at])], names=["level", "n", "t"])


def _own(ids: list[int | None], texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct rows, where each is first, and how often it comes."""
    own = np.zeros(len(texts), ROWS)
    own["id"], own["named"] = [i or 0 for i in ids], [i is not None for i in ids]
    own["text"] = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts], np.uint64).view(np.int64)
    return np.unique(own, return_index=True, return_counts=True)


def _score(shared, buckets: int):
    """Documents to their parts of the sums that need no bucket, and to postings of words whose exact counts buckets must add."""

    def blocks_of(ids, texts, words):
        model = shared.value
        own, rows, copies = _own(ids, texts)
        tokens, sizes = token_arrays([texts[i] for i in rows], words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        u, inverse, before = with_contexts(tokens)
        frequent, count = model.exact(u)
        sure = frequent[inverse]
        base = np.bincount(doc[sure], np.log10((count + 0.5) / model.floor)[inverse[sure]], len(sizes))
        code, pair_of = np.unique(before * len(u) + inverse, return_inverse=True)
        heads, of = np.unique(code // len(u), return_inverse=True)
        level = np.zeros(len(u), np.int64)
        level[~frequent] = model.filter.level(u[~frequent], u[~frequent])
        counts = model.counts(u, frequent, count, level)
        first, pair = u[heads], pair_keys(u[code // len(u)], u[code % len(u)])
        weight = model.filter.level(mix(first ^ WEIGHT), first)
        p = model.probability(first, counts[heads], weight, of, model.filter.level(pair, places(model.hot, first, pair, of)), ((counts + 0.5) / model.floor)[code % len(u)])
        score = np.bincount(doc, np.log10(p)[pair_of], len(sizes))
        sums = np.stack([np.ones(len(sizes)), sizes, np.bincount(doc[sure], minlength=len(sizes)), base, score], 1)
        yield int(rows[0] % buckets), DOC, own.tobytes(), (sums * copies[:, None]).tobytes()
        where = np.flatnonzero(~sure)
        _, first, n = np.unique(inverse[where] * len(sizes) + doc[where], return_index=True, return_counts=True)
        i = where[first]
        place = np.zeros(len(i), PLACES)
        place["doc"], place["n"] = doc[i], n * copies[doc[i]]
        for b, p in _split(_bucket(tokens[i], buckets), buckets):
            yield b, POST, tokens[i[p]].tobytes(), place[p].tobytes(), own.tobytes()

    def run(batches):
        words = _WordHash()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in by_size(batch.column(1), CHUNK):
                yield from _emit(list(blocks_of(ids[lo:hi], texts, words)))

    return run


class _Counts:
    """A bucket's words with their counts, added block by block in order."""

    def __init__(self):
        self.parts, self.whole = [], (np.empty(0, np.uint64), np.empty(0, np.int64))

    def add(self, key: bytes, count: bytes) -> None:
        self.parts.append((np.frombuffer(key, np.uint64), np.frombuffer(count, np.int64)))

    def of(self, words: np.ndarray) -> np.ndarray:
        """Exact counts; 0 of words that don't occur."""
        if self.parts:
            self.whole, self.parts = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True)), []
        key, count = self.whole
        if not len(key):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(key, words), len(key) - 1)
        return np.where(key[at] == words, count[at], 0)


def _look_up(shared):
    """Postings of a bucket to parts of documents' sums."""

    def run(batches):
        model, last = shared.value, None
        for bucket, kind, a, b, c, *_ in _blocks(batches):
            if bucket != last:
                last, counts = bucket, _Counts()
            if kind == WORD:
                counts.add(a, b)
            elif kind == DOC:
                yield from _emit([(bucket, DOC, a, b)])
            elif kind == POST:
                place, rows = np.frombuffer(b, PLACES), np.frombuffer(c, ROWS)
                docs, of = np.unique(place["doc"], return_inverse=True)
                found = counts.of(np.frombuffer(a, np.uint64))
                sums = np.zeros((len(docs), len(SUMS)))
                sums[:, 2] = np.bincount(of, place["n"] * (found > 0), len(docs))
                sums[:, 3] = np.bincount(of, place["n"] * np.log10((found + 0.5) / model.floor), len(docs))
                yield from _emit([(bucket, DOC, rows[docs].tobytes(), sums.tobytes())])

    return run


def _ask(buckets: int, hot: np.ndarray, chunk: int):
    """Chunks of documents to what they ask each bucket, and to their rows, words and numbered tokens, which wait for the answers."""

    def run(batches):
        words, part, n = _WordHash(), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in by_size(batch.column(1), chunk):
                own, rows, copies = _own(ids[lo:hi], texts)
                tokens, sizes = token_arrays([texts[i] for i in rows], words)
                u, at, before = with_contexts(tokens)
                # The name has the place and the rows in it: a repeated task that meets other rows finds no answers rather than wrong ones.
                name = xxhash.xxh3_64_digest(own.tobytes(), seed=part << 32 | n)
                n += 1
                key, bucket = pairs_and_buckets(u, distinct(before * len(u) + at), hot, buckets)
                (pairs, edges), (named, starts) = _dealt(bucket, buckets), _dealt(_bucket(u, buckets), buckets)
                key, word = key[pairs], u[named]
                asked = [
                    (b, ASK, key[p].tobytes(), word[w].tobytes(), name)
                    for b in range(buckets) if edges[b] < edges[b + 1] or starts[b] < starts[b + 1] for p, w in [(slice(*edges[b : b + 2]), slice(*starts[b : b + 2]))]
                ]
                yield from _emit(asked)
                yield from _emit([(int.from_bytes(name) % buckets, KEEP, own.tobytes(), np.stack([copies, sizes]).tobytes(), u.tobytes(), _planes(at), name)])

    return run


def _answer(most: int = 500_000):
    """Answers to chunks from their buckets' counts and segments. most: keys that are looked up at once."""

    def close(bucket, asked, counts, filter_):
        pairs, words = (np.concatenate([np.frombuffer(x[k], np.uint64) for x in asked]) for k in (0, 1))
        level, count = filter_.level(pairs, pairs), counts.of(words)
        own, weight = filter_.level(words, words), filter_.level(mix(words ^ WEIGHT), words)
        rows, p, w = [], 0, 0
        for key, word, name in asked:
            q, x = p + len(key) // 8, w + len(word) // 8
            rows.append((int.from_bytes(name, signed=True), bucket, level[p:q].astype(np.uint8).tobytes(), _narrow(count[w:x]), own[w:x].astype(np.uint8).tobytes(), weight[w:x].astype(np.uint8).tobytes()))
            p, w = q, x
        yield from _emit(rows, schema=ANSWER)

    def run(batches):
        last, asked, held = None, [], 0
        for bucket, kind, a, b, c, d, e in _blocks(batches):
            if asked and (bucket != last or held > most):
                yield from close(last, asked, counts, own_filter)
                asked, held = [], 0
            if bucket != last:
                last, counts, own_filter = bucket, _Counts(), Filter({}, 1, [])
            if kind == WORD:
                counts.add(a, b)
            elif kind == SEGMENT:
                own_filter = Filter.single(a)
            elif kind == ASK:
                asked.append((a, b, c))
                held += (len(a) + len(b)) // 8
            elif kind == KEEP:
                yield from _emit([(int.from_bytes(e, signed=True), -1, a, b, c, d)], schema=ANSWER)
        if asked:
            yield from close(last, asked, counts, own_filter)

    return run


def _put_together(shared, buckets: int):
    """A chunk and the answers to it, in the order of the buckets, to its documents' sums."""

    def close(chunk, kept, answers):
        model = shared.value
        if kept is None:
            raise RuntimeError(f"answers to chunk {chunk}, which a repeated task made otherwise: the input's rows changed")
        own, u, at = np.frombuffer(kept[0], ROWS), np.frombuffer(kept[2], np.uint64), _from_planes(kept[3])
        copies, sizes = np.frombuffer(kept[1], np.int64).reshape(2, -1)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        code, pair_of = np.unique(places_before(u, at) * len(u) + at, return_inverse=True)

        def in_place(blobs, order):
            found = np.concatenate(blobs) if blobs else np.empty(0, np.int64)
            if len(found) != len(order):
                raise RuntimeError(f"chunk {chunk} has {len(found)} answers to {len(order)} questions: the input's rows changed")
            out = np.empty(len(order), np.int64)
            out[order] = found
            return out

        pairs, words = _dealt(pairs_and_buckets(u, code, model.hot, buckets)[1], buckets)[0], _dealt(_bucket(u, buckets), buckets)[0]
        byte = lambda k: [np.frombuffer(x[k], np.uint8) for x in answers]
        level, own_level, weight = in_place(byte(0), pairs), in_place(byte(2), words), in_place(byte(3), words)
        exact = in_place([_wide(x[1], len(x[2])) for x in answers], words)
        heads, of = np.unique(code // len(u), return_inverse=True)
        counts = model.counts(u, *model.exact(u), own_level)
        p = model.probability(u[heads], counts[heads], weight[heads], of, level, ((counts + 0.5) / model.floor)[code % len(u)])
        base = np.log10((exact + 0.5) / model.floor)
        sums = np.stack([np.ones(len(sizes)), sizes, np.bincount(doc, (exact > 0)[at], len(sizes)), np.bincount(doc, base[at], len(sizes)), np.bincount(doc, np.log10(p)[pair_of], len(sizes))], 1)
        yield _part(own, sums * copies[:, None])

    def run(batches):
        last, kept, answers = None, None, []
        for chunk, bucket, *blobs in _blocks(batches):
            if chunk != last:
                if last is not None:
                    yield from close(last, kept, answers)
                last, kept, answers = chunk, None, []
            if bucket < 0:
                kept = blobs
            else:
                answers.append(blobs)
        if last is not None:
            yield from close(last, kept, answers)

    return run


def _part(rows: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows["id"]), pa.array(rows["named"] > 0), pa.array(rows["text"]), *(pa.array(sums[:, i]) for i in range(len(SUMS)))], names=["id", "named", "text", *SUMS])


def _parts(batches):
    """Blocks of parts as rows."""
    for _, _, a, b, *_ in _blocks(batches):
        yield _part(np.frombuffer(a, ROWS), np.frombuffer(b, np.float64).reshape(-1, len(SUMS)))


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head_words: int = 200_000, bits_per_entry: float = 8.0, bucket_bytes: int = 16_000_000, most_bytes: int = 256_000_000, sample_docs: int = 2000) -> DataFrame:
    """Scores of every row of `docs`, learnt from those that are not held out."""
    spark = docs.sparkSession
    scratch, tasks = Scratch(spark, "lm"), shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(tasks, math.ceil(size / bucket_bytes))
    hot = hot_words(rows.where(~held_out), sample_docs, buckets)
    counted = rows.where(~held_out).select("text").mapInArrow(lean(_count(buckets, hot, chunk_bytes(buckets))), BLOCK_DDL)
    counts = scratch.save(_in_order(counted, tasks).mapInArrow(lean(_add_up(bits_per_entry, hot)), BLOCK_DDL), "counts")
    levels = counts.where(F.col("kind") == WORD).mapInArrow(_levels, "level long, n long, t long").groupBy("level").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    total, distinct, by = sum(r["t"] for r in levels), sum(r["n"] for r in levels), {r["level"]: r["n"] for r in levels}
    head_least = next(v for v in range(MAX_LEVEL + 2) if sum(n for k, n in by.items() if k >= v) <= head_words)

    def frequent(batches):
        for _, _, a, b, *_ in _blocks(batches):
            key, count = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            at = (level_of(count) >= head_least) | np.isin(key.view(np.uint64), hot)
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(count[at])], names=["word", "n"])

    head = counts.where(F.col("kind") == WORD).mapInArrow(frequent, "word long, n long").toPandas()  # at most head_words rows, and hot words
    key = head["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    head_key, head_count = key[order], head["n"].to_numpy(np.int64)[order]

    def masses(batches):
        for _, _, a, b, *_ in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.float64))], names=["word", "mass"])

    taken = counts.where(F.col("kind") == MASS).mapInArrow(masses, "word long, mass double").groupBy("word").agg(F.sum("mass").alias("mass")).collect() if len(hot) else []
    taken = {r.word: r.mass for r in taken}
    mass = np.array([taken.get(int(w), 0.0) for w in hot.view(np.int64)])
    of = np.zeros(len(hot), np.int64)
    if len(head_key):
        at = np.minimum(np.searchsorted(head_key, hot), len(head_key) - 1)
        of = np.where(head_key[at] == hot, head_count[at], 0)
    hot_weights = np.exp(-STEP * weight_level(np.clip(1 - mass / np.maximum(of, 1), 0.01, 1)))
    top = level_of(head_count) >= head_least
    segments = counts.where(F.col("kind") == SEGMENT)
    sizes = dict(segments.select("bucket", F.length("a")).collect())
    whole = None
    if sum(sizes.values()) <= most_bytes:
        whole = Filter(sizes, buckets, ((r["bucket"], r["a"]) for r in segments.select("bucket", "a").toLocalIterator()))
    shared = spark.sparkContext.broadcast(Model(head_key[top], head_count[top].astype(np.float64), hot, of, hot_weights, total, distinct, whole))
    if whole is not None:
        postings = rows.mapInArrow(lean(_score(shared, buckets)), BLOCK_DDL)
        found = _in_order(postings.unionByName(counts.where(F.col("kind") == WORD)), tasks).mapInArrow(lean(_look_up(shared)), BLOCK_DDL).mapInArrow(_parts, PART_DDL)
    else:
        known, done = counts.where(F.col("kind").isin(WORD, SEGMENT)), []
        for k in range(ROUNDS):
            asked = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)) == k).mapInArrow(lean(_ask(buckets, hot, chunk_bytes(buckets))), BLOCK_DDL)
            answers = scratch.save(_in_order(asked.unionByName(known), tasks).mapInArrow(lean(_answer()), ANSWER_DDL), "answers")
            met = answers.repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket")
            done.append(scratch.save(met.mapInArrow(lean(_put_together(shared, buckets)), PART_DDL), "sums"))
            scratch.drop(answers)
        scratch.drop(counts)
        found = reduce(DataFrame.unionByName, done)
    sums = found.groupBy("id", "named", "text").agg(*(F.sum(c).alias(c) for c in SUMS))
    out = sums.select(F.when(F.col("named"), F.col("id")).alias("id"), "copies", *((F.col(c) / F.col("copies")).alias(c) for c in SUMS[1:]), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), *(F.round(c).cast("long").alias(c) for c in ("n_tokens", "n_known")), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op3_lm_scoring`: all documents, learnt from the training fold."""
    return scores(table(spark, sf_dir, "documents"))
