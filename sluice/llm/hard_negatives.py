"""Hard negatives for anchors, by inner product over integers with coordinate pruning.

Vectors are scaled and floored to integers, so scores are exact. A row's score is its inner product with an anchor; higher scores come first, ties by smaller id.
An anchor's positives are its best `positives` rows of the same label; for each of them the best `negatives` rows of other labels are wanted
whose score lies between two shares of the positive's. Both are searches: the best k rows for an anchor within a window of scores.

A search deals rows and anchors to blocks by a hash of their ids, and every block of rows meets every block of anchors in one task; block sizes are bounded in bytes, so a hot label is no
hot task. In a task, rows lie in buckets of decreasing length. A bucket keeps a sorted list of each coordinate of its unit vectors. An anchor needs
at least a score t (the end of its window, or its k-th best so far), hence a cosine of at least c = t / (its length * the bucket's largest length) with a row of the bucket: if c > 1, no row of the bucket serves; else
the angle of a row to any axis differs from the anchor's by at most arccos(c), which gives a range of feasible values in that coordinate's list. The ranges of the anchor's
`focus` largest coordinates are intersected, starting from the shortest, and what is left is verified exactly. Where even the shortest range holds more than a quarter of the
bucket, the bucket is verified as a whole by one matrix product. The tasks' best k are merged by rank.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Zero and empty vectors do, with score 0. Rows meet only rows of
the same number of components. Rows of one id count as the one of smallest (label, vector). An anchor is not its own positive or negative. Fewer rows than asked for: all. Scores beyond a long are set to its ends; extra
columns are ignored, whatever their names. No anchors give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, shuffle_partitions, table
from sluice.llm.vectors import matrix

LONG = 2**63 - 1
#: Rows of a bucket of similar lengths, and the focus coordinates of an anchor.
BUCKET, FOCUS = 2048, 4
FOUND_DDL = "anchor_id long, key long, vec_id long, score long"


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, as longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ p.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (q, p)]
    return np.clip(whole[0] @ whole[1].T, -LONG, LONG).astype(np.int64)


class Bucket:
    """Rows of similar lengths, with a sorted list of each coordinate of their unit vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, length: np.ndarray):
        self.ids, self.labels, self.x, self.longest = ids, labels, x, float(length.max(initial=0))
        self.unit = x / np.maximum(length, 1e-300)[:, None]
        self.order = self.unit.argsort(0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, 0)

    def ranges(self, unit: np.ndarray, least: np.ndarray, focus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(coordinates, feasible lower and upper values, rows between) of the focus coordinates of unit queries that need a cosine of at least `least`."""
        axes = np.argpartition(-np.abs(unit), min(focus, unit.shape[1]) - 1, axis=1)[:, :focus]
        to_axis, apart = np.arccos(np.clip(np.take_along_axis(unit, axes, 1), -1, 1)), np.arccos(np.clip(least, -1, 1))[:, None]
        slack = 1e-7  # of angles near 0 as doubles
        low, high = np.cos(np.minimum(np.pi, to_axis + apart)) - slack, np.cos(np.maximum(0, to_axis - apart)) + slack
        held = np.empty(axes.shape, np.int64)
        for axis in np.unique(axes):
            at = axes == axis
            held[at] = np.searchsorted(self.lists[:, axis], high[at], "right") - np.searchsorted(self.lists[:, axis], low[at], "left")
        return axes, low, high, held

    def candidates(self, axes, low, high, held) -> np.ndarray:
        """Rows that lie in the feasible ranges of all focus coordinates of one query."""
        first, *rest = np.argsort(held, kind="stable")
        values = self.lists[:, axes[first]]
        rows = self.order[np.searchsorted(values, low[first], "left") : np.searchsorted(values, high[first], "right"), axes[first]]
        for i in rest:
            value = self.unit[rows, axes[i]]
            rows = rows[(value >= low[i]) & (value <= high[i])]
        return rows


class Best:
    """The best k rows of each (query, window) so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.at, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))
        self.floor = low.copy()  # a score below it can't be among the best

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer rows to windows (their numbers)."""
        ok = (scores >= self.floor[at]) & (scores <= self.high[at])
        at, ids, scores = (np.concatenate([a, b[ok]]) for a, b in ((self.at, at), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        full = np.flatnonzero(np.arange(len(self.at)) - np.searchsorted(self.at, self.at) == self.k - 1)
        self.floor[self.at[full]] = self.scores[full]


def search_block(rows, queries, same: bool, k: int, focus: int = FOCUS, bucket: int = BUCKET):
    """The best k rows of each window of each query. rows: (ids, labels, x); queries: (ids, labels, q, window of each: query number, low, high).

    Gives (window number, row id, score) and the number of exact products of a query and a row.
    """
    ids, labels, x = rows
    q_ids, q_labels, q, (owner, low, high) = queries
    best, verified = Best(low, high, k), 0
    if not len(ids) or not len(owner):
        return best, verified
    owner_first, owner_end = np.searchsorted(owner, np.arange(len(q_ids))), np.searchsorted(owner, np.arange(len(q_ids)), "right")
    length, q_length = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    order = np.lexsort((ids, -length))
    unit = q / np.maximum(q_length, 1e-300)[:, None]
    for lo in range(0, len(ids), bucket):
        rows_ = order[lo : lo + bucket]
        b = Bucket(ids[rows_], labels[rows_], x[rows_], length[rows_])
        # The smallest score that any window of a query still needs.
        need = np.full(len(q_ids), np.inf)
        np.minimum.at(need, owner, best.floor.astype(float))
        some = np.isfinite(need)
        least = np.where(need > 0, need * (1 - 1e-12) / np.maximum(q_length * b.longest, 1e-300), -1.0)
        alive = np.flatnonzero(some & (least <= 1))
        if not len(alive):
            continue
        axes, low_, high_, held = b.ranges(unit[alive], least[alive], focus) if x.shape[1] else (None, None, None, np.full((len(alive), 1), len(rows_)))
        wide = held.min(1) > len(rows_) / 4
        parts = [(alive[wide][i : i + 256], None) for i in range(0, int(wide.sum()), 256)]
        parts += [(alive[i : i + 1], b.candidates(axes[i], low_[i], high_[i], held[i])) for i in np.flatnonzero(~wide)]
        for some_q, found in parts:
            some_ids, some_labels, some_x = (b.ids, b.labels, b.x) if found is None else (b.ids[found], b.labels[found], b.x[found])
            if not len(some_ids):
                continue
            scores = products(q[some_q], some_x)
            verified += scores.size
            fit = (some_labels == q_labels[some_q][:, None]) == same
            fit &= some_ids != q_ids[some_q][:, None]
            for number in range(int((owner_end - owner_first)[some_q].max())):
                at = owner_first[some_q] + number
                has = np.flatnonzero(at < owner_end[some_q])
                at = at[has]
                ok = fit[has] & (scores[has] <= best.high[at][:, None]) & (scores[has] >= best.floor[at][:, None])
                if len(some_ids) > k:  # only scores down to the bucket's own k-th can be among the best
                    kth = np.partition(np.where(ok, scores[has], -LONG), len(some_ids) - k, axis=1)[:, len(some_ids) - k]
                    ok &= scores[has] >= kth[:, None]
                i, j = np.nonzero(ok)
                best.add(at[i], some_ids[j], scores[has][i, j])
    return best, verified


def _search(same: bool, k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        width, q_width = (np.asarray(t.column("width").to_numpy()) for t in (rows, queries))
        for n in np.intersect1d(width, q_width):
            r, q = rows.filter(pa.array(width == n)), queries.filter(pa.array(q_width == n)).combine_chunks()
            columns = [np.asarray(t.column(c).to_numpy()) for t in (r, q) for c in ("vec_id", "label")]
            windows = q.column("windows").combine_chunks()
            owner = np.repeat(np.arange(len(q)), np.diff(windows.offsets.to_numpy()))
            flat = windows.flatten()
            key, low, high = (flat.field(c).to_numpy() for c in ("key", "low", "high"))
            best, _ = search_block(
                (columns[0], columns[1], matrix(r.column("vec").combine_chunks(), n)), (columns[2], columns[3], matrix(q.column("vec").combine_chunks(), n), (owner, low.copy(), high.copy())), same, k
            )
            out.append((columns[2][owner[best.at]], key[best.at], best.ids, best.scores))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("anchor_id", "key", "vec_id", "score"), map(pa.array, cols), strict=True)))

    return run


def search(rows: DataFrame, queries: DataFrame, *, same: bool, k: int, row_blocks: int, query_blocks: int) -> DataFrame:
    """(anchor_id, key, vec_id, score, rank): the best k rows of the same label (or of another) for every window of every query.

    rows: (vec_id, label, vec, width); queries: those and windows, an array of (key, low, high).
    """
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "label", "vec", "width", part(row_blocks, 1).alias("block"), every(query_blocks).alias("q_block"))
    right = queries.select("vec_id", "label", "vec", "width", "windows", part(query_blocks, 2).alias("q_block"), every(row_blocks).alias("block"))
    found = left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInArrow(_search(same, k), FOUND_DDL)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: float = 256.0, block_bytes: int = 8 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hard negatives.

    anchor: a condition over (vec_id, label). A negative's score is between `low` and `high` % of the positive's. block_bytes: vectors of a block, as doubles.
    """
    scratch = Scratch(df.sparkSession, "negatives")
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vec, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-(2.0**62))), F.lit(2.0**62))).cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.when(finite, whole).alias("vec"))
    rows = rows.where("vec_id is not null and label is not null and vec is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.label", "row.vec", F.size("row.vec").alias("width"))
    rows = scratch.save(rows, "rows")
    is_anchor = F.expr(anchor) if isinstance(anchor, str) else anchor
    n, anchors, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.max("width")).first()
    most = max(1, block_bytes // (8 * max(1, width or 1)))
    blocks = {"row_blocks": max(1, -(-n // most), min(shuffle_partitions(df.sparkSession), -(-n // BUCKET))), "query_blocks": max(1, -(-4 * anchors // most))}
    window = lambda key, lo, hi: F.struct(F.lit(key).cast("long").alias("key"), lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    asked = scratch.save(rows.where(is_anchor).withColumn("windows", F.array(window(0, F.lit(-LONG), F.lit(LONG)))), "anchors")
    best = scratch.save(search(rows, asked, same=True, k=positives, **blocks), "positives")
    # 100 * negative within low and high times the positive: whole scores between the rounded-up and rounded-down quotients.
    share = lambda p: (F.col("score").cast("decimal(20,0)") * p) / F.lit(100).cast("decimal(3,0)")
    wanted = best.select("anchor_id", window(0, F.ceil(share(low)), F.floor(share(high))).withField("key", F.col("vec_id")).alias("w")).where("w.low <= w.high")
    asked = asked.drop("windows").join(wanted.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list("w")).alias("windows")), "vec_id")
    found = search(rows, scratch.save(asked, "windows"), same=False, k=negatives, **blocks)
    pairs = best.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("positive_score"))
    out = found.join(pairs, ["anchor_id", "key"])
    return out.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op12_hard_negatives`: anchors are rows whose id is divisible by 50; a label of an id divisible by 7 is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label=label, anchor="vec_id % 50 = 0")


def sql() -> str:
    return """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.vec, b.vec)::bigint as score from v a join v b on a.vec_id <> b.vec_id and a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3"""
