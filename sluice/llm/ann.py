"""Approximate nearest neighbours by multiprobe p-stable hashing.

Rows are put into bands of norms, each half as large as the one before (the last takes all that are smaller), so that a few very long vectors don't flatten the others.
Within a band, largest inner product becomes smallest Euclidean distance: vectors are scaled by the band's largest norm and get one component that fills them up to length 1,
queries are scaled to length 1. Each of `tables` hash tables of a band projects on `functions` Gaussian directions, cut into slots of equal width; a band of few rows is one bucket.
A query visits buckets of every band.

A query visits the buckets of a table in the order of their estimated success: the probability that a neighbour at the cosine that the
neighbours of a bounded sample have (`sample_rows`) falls into the bucket, given the query's projections. It goes on until the
visited buckets hold `success` of that probability and enough rows. A bounded set of queries (`audit`) is held against all rows by brute
force: `success` is raised until the buckets that they visit hold `target` of their true neighbours, in the end to all buckets. Buckets are bounded in number (slots ** functions); one with more than
`block_rows` rows is dealt to several tasks by id hash. In a task, every visited bucket is scored exactly (inner products in double precision)
and the best k per query are merged over its buckets; the tables' and tasks' candidates are then merged without duplicates.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Repeated ids count once with their best row. Ties go
to the smaller id. Vectors of another length than the most frequent one take no part. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, shuffle_partitions, smallest, table
from sluice.llm.vectors import doubles, matrix


#: A success share that visits all buckets.
EVERY = 2.0
#: Bands of norms; sampled rows under which a band is one bucket.
BANDS, FEW = 16, 50


class Hashes:
    """Projections and slots of one band, and, once counted, its buckets' rows."""

    def __init__(self, sample: np.ndarray, scale: float, rows: int, k: int, tables: int, functions: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.scale, self.tables, self.functions = scale, tables, functions
        self.slots = max(1, min(8, math.ceil((rows / 400) ** (1 / functions)))) if len(sample) >= FEW else 1
        self.counts: dict[int, int] = {}
        if self.slots == 1:
            return
        width = sample.shape[1] + 1
        self.directions = rng.normal(size=(width, tables * functions))
        p = self.project(self.lift(sample))
        spread = p.std(0) + 1e-9
        # Slots of one width per function, shifted at random; the outer two are open.
        self.width = spread * 4.2 / self.slots
        self.first = p.mean(0) - self.width * (self.slots / 2 + rng.uniform(-0.25, 0.25, len(spread)))
        self.mean = p.mean(0)
        unit = sample / np.maximum(np.linalg.norm(sample, axis=1), 1e-300)[:, None]
        some = unit[:400]
        sims = some @ (sample / scale).T
        sims[np.arange(len(some)), np.arange(len(some))] = -2
        rank = min(sims.shape[1], max(1, round(k * len(sample) / max(rows, 1))))
        self.cosine = float(np.clip(np.median(np.sort(sims, 1)[:, -rank]) if sims.size > 1 else 0.5, 0.05, 0.99))

    @property
    def size(self) -> int:
        """Number of buckets."""
        return self.tables * self.slots**self.functions

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket number of each row in each table."""
        if self.slots == 1:
            return np.zeros((len(x), self.tables), np.int64)
        slot = np.clip(np.floor((self.project(self.lift(x)) - self.first) / self.width), 0, self.slots - 1).astype(np.int64)
        slot = slot.reshape(len(x), self.tables, self.functions)
        return (slot * self.slots ** np.arange(self.functions)).sum(2) + np.arange(self.tables) * self.slots**self.functions

    def probes(self, q: np.ndarray, success: float, enough: int) -> list[np.ndarray]:
        """Buckets that each unit query visits, in estimated success order in each table."""
        if self.slots == 1:
            return [np.zeros(1 if self.counts else 0, np.int64) for _ in q]
        f = self.project(np.hstack([q, np.zeros((len(q), 1))]))
        # A unit residual in a random direction has a share of 1 / width of a direction's squared length.
        spread = math.sqrt((1 - self.cosine**2) / len(self.directions)) * np.linalg.norm(self.directions, axis=0)
        edges = self.first[:, None] + self.width[:, None] * np.arange(1, self.slots)
        at = (edges[None] - self.cosine * f[:, :, None]) / spread[:, None]
        below = 0.5 * (1 + np.vectorize(math.erf)(at / math.sqrt(2))) if at.size else at
        below = np.concatenate([np.zeros((*below.shape[:2], 1)), below, np.ones((*below.shape[:2], 1))], 2)
        inside = np.diff(below, axis=2).reshape(len(q), self.tables, self.functions, self.slots)
        size = self.slots**self.functions
        held = np.array([self.counts.get(b, 0) for b in range(size * self.tables)])
        out: list[list[np.ndarray]] = [[] for _ in q]
        for t in range(self.tables):
            p = np.ones((len(q), 1))
            for i in range(self.functions):  # bucket = sum of slot_i * slots ** i
                p = (inside[:, t, i, :, None] * p[:, None, :]).reshape(len(q), -1)
            order = np.argsort(-p, axis=1, kind="stable")
            rows = held[t * size : (t + 1) * size]
            p = np.where(rows > 0, p, 0)
            total = np.maximum(p.sum(1), 1e-300)
            done = np.take_along_axis(p, order, 1).cumsum(1) / total[:, None]
            seen = rows[order].cumsum(1)
            visit = ((done - np.take_along_axis(p, order, 1) / total[:, None]) < success) | ((seen - rows[order]) < enough)
            for i in range(len(q)):
                b = order[i][visit[i]]
                out[i].append(b[rows[b] > 0] + t * size)
        return [np.concatenate(o) for o in out]


class Bands:
    """The bands of norms with their hashes; bucket numbers run through all bands."""

    def __init__(self, sample: np.ndarray, largest: float, found: dict[int, tuple[int, float]], k: int, tables: int, functions: int, block_rows: int):
        """found: rows and largest norm of each band."""
        self.largest, self.tables, self.block_rows = largest, tables, block_rows
        at = self.band(sample)
        self.hashes = {b: Hashes(sample[at == b], norm, rows, k, tables, functions) for b, (rows, norm) in sorted(found.items())}
        sizes = np.array([self.hashes[b].size if b in self.hashes else 0 for b in range(BANDS)])
        self.start = np.cumsum(sizes) - sizes
        self.counts: dict[int, int] = {}

    def band(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.einsum("ij,ij->i", x / self.largest, x / self.largest))
        return np.clip(np.floor(-np.log2(np.maximum(norm, 1e-300))), 0, BANDS - 1).astype(np.int64)

    def count(self, counts: dict[int, int]) -> None:
        self.counts = counts
        for b, h in self.hashes.items():
            h.counts = {i: counts[i + self.start[b]] for i in range(h.size) if i + self.start[b] in counts}

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket number of each row in each table of its band."""
        at, out = self.band(x), np.zeros((len(x), self.tables), np.int64)
        for b in np.unique(at):
            out[at == b] = self.hashes[int(b)].buckets(x[at == b]) + self.start[b]
        return out

    def probes(self, q: np.ndarray, success: float, enough: int) -> list[np.ndarray]:
        """Buckets of all bands that each unit query visits."""
        each = [[v + self.start[b] for v in h.probes(q, success, enough)] for b, h in self.hashes.items()]
        return [np.concatenate(v) for v in zip(*each, strict=True)]

    def blocks(self, bucket: int) -> int:
        return max(1, -(-self.counts.get(int(bucket), 0) // self.block_rows))


def _mix(x, salt):
    with np.errstate(over="ignore"):  # products of 64 bits, also of single numbers
        x = (np.asarray(x).astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


ROW_DDL = "part int, asks boolean, vec_id long, vec array<double>, buckets array<int>"


def _deal(shared, parts: int, divisor: int, success: float, enough: int):
    """Index rows by bucket, and queries with the buckets they visit, to the tasks that hold them."""

    def rows(cols):
        part, asks, ids, vecs, buckets = cols
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(asks, pa.bool_()), pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.float64())), pa.array(buckets, pa.list_(pa.int32()))], names=["part", "asks", "vec_id", "vec", "buckets"])

    def run(batches):
        hashes = shared.value
        for batch in batches:
            ids, all_x = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            for lo in range(0, len(ids), 1000):
                own, x = ids[lo : lo + 1000], all_x[lo : lo + 1000]
                b = hashes.buckets(x)
                cuts = np.vectorize(hashes.blocks)(b)
                cut = _mix(own, 5)[:, None] % cuts.astype(np.uint64)
                part = (_mix(b, 17) + cut * np.uint64(7919)) % np.uint64(parts)
                cols = [[], [], [], [], []]
                for i in range(len(own)):
                    by: dict[int, list[int]] = {}
                    for p, k in zip(part[i].tolist(), b[i].tolist(), strict=True):
                        by.setdefault(p, []).append(k)
                    for p, k in by.items():
                        for c, v in zip(cols, (p, False, own[i], x[i], k), strict=True):
                            c.append(v)
                at = np.flatnonzero(own % divisor == 0)
                q = x[at] / np.linalg.norm(x[at], axis=1)[:, None]
                for i, visits in zip(at, hashes.probes(q, success, enough) if len(at) else [], strict=True):
                    by = {}
                    for k in visits.tolist():
                        base = int(_mix(k, 17))
                        for c in range(hashes.blocks(k)):
                            by.setdefault(((base + c * 7919) % 2**64) % parts, []).append(k)
                    for p, k in by.items():
                        for c, v in zip(cols, (p, True, own[i], x[i], k), strict=True):
                            c.append(v)
                yield rows(cols)

    return run


def _best(k: int):
    """Per query, the best k of the buckets that a task holds."""

    def run(batches):
        have: dict[int, list] = {}
        want: dict[int, list] = {}
        ids, vecs, qids, qvecs = [], [], [], []
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            x, own, lists = matrix(batch.column("vec")), batch.column("vec_id").to_numpy(), batch.column("buckets").to_pylist()
            for flag, to, where_ids, where_vecs in ((False, have, ids, vecs), (True, want, qids, qvecs)):
                at = np.flatnonzero(asks == flag)
                start = sum(map(len, where_ids))
                for j, i in enumerate(at):
                    for b in lists[i]:
                        to.setdefault(b, []).append(start + j)
                where_ids.append(own[at])
                where_vecs.append(x[at])
        if not have or not want:
            return
        ids, vecs, qids, qvecs = np.concatenate(ids), np.concatenate(vecs), np.concatenate(qids), np.concatenate(qvecs)
        # A query's rows from several parts are one query here.
        query, of = np.unique(qids, return_inverse=True)
        first = np.zeros(len(query), np.int64)
        first[of] = np.arange(len(qids))
        best_s, best_i = np.full((len(query), k), -np.inf), np.full((len(query), k), -1)
        for b, rows in have.items():
            if b not in want:
                continue
            rows, qs = np.unique(rows), np.unique(of[want[b]])
            once = len(np.unique(ids[rows])) == len(rows)  # else one id may fill what is kept
            for lo in range(0, len(rows), 4096):
                r = rows[lo : lo + 4096]
                for qlo in range(0, len(qs), 512):
                    q = qs[qlo : qlo + 512]
                    s = qvecs[first[q]] @ vecs[r].T
                    s[query[q][:, None] == ids[r][None]] = -np.inf
                    s = np.hstack([best_s[q], s])
                    i = np.hstack([best_i[q], np.broadcast_to(ids[r], (len(q), len(r)))])
                    if once and s.shape[1] > 3 * k:  # ties with the k-th stay until the ids decide
                        least = np.partition(s, -2 * k, 1)[:, -2 * k]
                        if not ((s == least[:, None]).sum(1) > k).any():
                            keep = np.argpartition(-s, 2 * k, 1)[:, : 2 * k]
                            s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
                    order = np.lexsort((-s, i), axis=1)
                    s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                    again = np.zeros(s.shape, bool)  # the same id from another table, whose score may differ in its last bit
                    again[:, 1:] = i[:, 1:] == i[:, :-1]
                    s[again] = -np.inf
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s[q], best_i[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        q, c = np.nonzero(best_s > -np.inf)
        for lo in range(0, len(q), 50_000):
            a, b = q[lo : lo + 50_000], c[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(query[a]), pa.array(best_i[a, b]), pa.array(best_s[a, b])], names=["query_id", "vec_id", "score"])

    return run


def _norms(bands: Bands):
    """Rows and largest norm of each band."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vec"))
            norm, at = np.linalg.norm(x, axis=1), bands.band(x)
            b = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array([int((at == i).sum()) for i in b], pa.int64()), pa.array([float(norm[at == i].max()) for i in b], pa.float64())], names=["band", "n", "norm"])

    return run


def _count(shared):
    def run(batches):
        for batch in batches:
            b, n = np.unique(shared.value.buckets(matrix(batch.column("vec"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(n)], names=["bucket", "n"])

    return run


def _nearest(shared, k: int):
    """The k nearest rows of each audited query among a task's rows, by brute force, with the rows' buckets."""

    def run(batches):
        hashes, qids, q = shared.value
        best = [(np.empty(0, np.int64), np.empty(0), np.empty((0, hashes.tables), np.int64)) for _ in qids]
        for batch in batches:
            all_ids, all_x = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            for lo in range(0, len(all_ids), 4096):
                ids, x = all_ids[lo : lo + 4096], all_x[lo : lo + 4096]
                scores, buckets, once = q @ x.T, hashes.buckets(x), len(np.unique(ids)) == len(ids)
                for i, s in enumerate(scores):
                    at = np.flatnonzero(ids != qids[i])
                    if once and len(at) > k:
                        at = at[s[at] >= np.partition(s[at], -k)[-k]]
                    at = at[np.lexsort((ids[at], -s[at]))]
                    own, value, held = (np.concatenate(c) for c in zip(best[i], (ids[at], s[at], buckets[at]), strict=True))
                    order = np.lexsort((own, -value))
                    first = np.sort(np.unique(own[order], return_index=True)[1])[:k]  # an id's best row alone
                    best[i] = tuple(c[order[first]] for c in (own, value, held))
        for qid, (own, value, held) in zip(qids, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), qid)), pa.array(own), pa.array(value), pa.array(list(held.astype(np.int32)), pa.list_(pa.int32()))], names=["query_id", "vec_id", "score", "buckets"])

    return run


def _audited(rows: DataFrame, hashes: Bands, divisor: int, k: int, success: float, audit: int, target: float) -> tuple[float, float]:
    """The least success from `success` on at which the audited queries find `target` of their true neighbours, and what they find."""
    asked = smallest(rows.where(F.col("vec_id") % divisor == 0), audit, "vec_id").toPandas().drop_duplicates("vec_id")
    if asked.empty:
        return success, 1.0
    q, qids = matrix(asked["vec"].tolist()), asked["vec_id"].to_numpy()
    q = q / np.linalg.norm(q, axis=1)[:, None]
    shared = rows.sparkSession.sparkContext.broadcast((hashes, qids, q))
    near = rows.mapInArrow(_nearest(shared, k), "query_id long, vec_id long, score double, buckets array<int>")
    near = near.groupBy("query_id", "vec_id").agg(F.max_by("buckets", "score").alias("buckets"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "buckets").collect()  # at most audit * k
    for share in (s for s in (success, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999, EVERY) if s >= success):
        visits = {i: set(v.tolist()) for i, v in zip(qids.tolist(), hashes.probes(q, share, 10 * k), strict=True)}
        recall = sum(not visits[r["query_id"]].isdisjoint(r["buckets"]) for r in true) / len(true) if true else 1.0
        if recall >= target:
            break
    return share, recall


def search(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", divisor: int = 20, k: int = 20, tables: int = 2, functions: int = 4, success: float = 0.8, sample_rows: int = 10_000, block_rows: int = 4000, audit: int = 200, target: float = 0.92) -> DataFrame:
    """The k nearest found of every row whose id is divisible by `divisor`, and `audit_recall`: the share of their true neighbours that the buckets visited by audited queries hold."""
    spark = vectors.sparkSession
    scratch, parts = Scratch(spark, "ann"), shuffle_partitions(spark)
    rows = scratch.save(doubles(vectors, id_col, vec_col), "vectors")
    widths = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, audit_recall double")
    rows = rows.where(F.size("vec") == widths[0]["w"])
    n = widths[0]["count"]
    largest_part = rows.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    largest = largest_part * math.sqrt(widths[0]["w"])  # no norm is larger
    norms = rows.mapInArrow(_norms(Bands(np.empty((0, 1)), largest, {}, k, tables, functions, block_rows)), "band int, n long, norm double")
    found = {r["band"]: (r["n"], r["norm"]) for r in norms.groupBy("band").agg(F.sum("n").alias("n"), F.max("norm").alias("norm")).collect()}
    sample = smallest(rows, sample_rows, "vec_id").select("vec").toPandas()
    hashes = Bands(matrix(sample["vec"].tolist()), largest, found, k, tables, functions, block_rows)
    counts = rows.mapInArrow(_count(spark.sparkContext.broadcast(hashes)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    hashes.count({r["bucket"]: r["n"] for r in counts})  # at most bands * tables * slots ** functions
    success, recall = _audited(rows, hashes, divisor, k, success, audit, target)
    shared = spark.sparkContext.broadcast(hashes)
    dealt = rows.mapInArrow(_deal(shared, parts, divisor, success, 10 * k), ROW_DDL).repartition(parts, "part")
    found = dealt.mapInArrow(_best(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(recall).cast("double").alias("audit_recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op6_nearest_neighbours`: rows divisible by 20 against all embeddings."""
    return search(table(spark, sf_dir, "embeddings"))
