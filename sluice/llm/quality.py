"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text is reduced to a row of statistics (character classes, repetition, line and word
shape). The trees are fitted on all labelled rows (but those whose crc32(id) mod 5 is 0, which never take part): tasks add up gradients of their rows
by node, feature and bin, Spark adds up those, and the driver sees sums alone (at most 8 x 8 x 19 x 32 rows a level). They are kept as arrays of
complete binary trees, and every document is scored by vectorised numpy traversal inside its task.

Nulls: a null or empty text has all statistics 0 and is scored as any other. A null id counts as not held out
and is never labelled. Several label rows of a document count as their rounded mean; null labels are
ignored. Repeated rows are scored each. Without labelled rows every score is 0.5; with one class only, the
smoothed share of that class. Columns other than id, text and label are ignored.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, by_size, lean, table

#: Bytes of text that a task has as Python objects at once, and rows that it is handed at once.
CHUNK, BATCH = 1_000_000, 1_000
FEATURES = (
    "log_bytes", "upper", "digits", "spaces", "newlines", "periods", "commas", "marks", "symbols", "bars", "high_bytes",
    "log_words", "word_length", "distinct_words", "next_same", "long_words", "line_words", "distinct_lines", "top_byte",
)
_CLASSES = np.zeros((256, 10))
for _c, _s in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"#$%&*<>{}=+~^@", b"|", bytes(range(128, 256)))):
    _CLASSES[list(_s), _c] = 1
_LETTERS = np.zeros(256)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a whole UTF-8 text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, by = len(text), (counts @ _CLASSES)
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    share = by / n
    share[0] = by[0] / max(1.0, counts @ _LETTERS)
    return [
        math.log1p(n), *share.tolist(), math.log1p(len(words)), (n - by[2] - by[3]) / w, len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w, sum(1 for x in words if len(x) > 14) / w, len(words) / len(lines), len(set(lines)) / len(lines), counts.max() / n,
    ]


def _statistics_of(batches):
    for batch in batches:
        for lo, hi, texts in by_size(batch.column(1), CHUNK):
            x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])


def _matrix(column) -> np.ndarray:
    """The statistics of an Arrow column of arrays, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


#: Gradients are whole multiples of 1 / UNIT, so that their sums don't depend on the order of adding.
UNIT = 2.0**16


def grid(x: np.ndarray) -> np.ndarray:
    """Values cut to 8 binary digits, of which there are few however many rows."""
    m, e = np.frexp(x)
    return np.ldexp(np.floor(m * 256) / 256, e)


class BoostedTrees:
    """Binary classifier of depth-limited trees on quantile bins, kept as flat arrays.

    Boosting goes in rounds of `together` trees that share their gradients and differ by the features that they may use, so
    that a level of them all takes one pass over the rows. A pass gives sums by tree, node, feature and bin, of whatever number of rows.
    """

    def __init__(self, trees: int = 80, depth: int = 4, bins: int = 32, rate: float = 0.7, least: int = 20, penalty: float = 1.0, together: int = 8, share: float = 0.7, seed: int = 7):
        self.trees, self.depth, self.bins, self.rate, self.least, self.penalty = trees, depth, bins, rate, least, penalty
        self.together, self.share, self.seed = together, share, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """From arrays."""
        self._start([dict(zip(*(v.tolist() for v in np.unique(grid(x[:, f]), return_counts=True)), strict=True)) for f in range(x.shape[1])], len(y), y.sum())
        binned = self._binned(x)
        return self._learn(lambda first, level: self._sums(binned, y, first, level))

    def fit_table(self, rows: DataFrame, scratch: Scratch) -> BoostedTrees:
        """From a table (x, y) of any size."""
        rows = scratch.save(rows, "labelled")

        def cells(batches):
            for batch in batches:
                x = grid(_matrix(batch.column(0)))
                for f in range(x.shape[1]):
                    v, n = np.unique(x[:, f], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f)), pa.array(v), pa.array(n)], names=["f", "v", "n"])

        of = [{} for _ in FEATURES]
        for f, v, n in rows.select("x").mapInArrow(cells, "f long, v double, n long").groupBy("f", "v").agg(F.sum("n")).collect():
            of[f][v] = n
        self._start(of, *rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first())
        if not 0 < self.ones < self.rows:
            return self

        def bins(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in self._binned(_matrix(batch.column(0)))], pa.binary()), batch.column(1)], names=["b", "y"])

        binned = scratch.save(rows.mapInArrow(bins, "b binary, y double"), "bins")

        def add_up(first, level):
            def run(batches):
                total = 0
                for batch in batches:
                    b = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), -1)
                    total = total + self._sums(b, batch.column(1).to_numpy(), first, level)
                if np.ndim(total):
                    flat = total.reshape(-1, 3)
                    at = np.flatnonzero(flat[:, 2])
                    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[at, k]) for k in range(3))], names=["at", "g", "h", "n"])

            sums = binned.mapInArrow(run, "at long, g double, h double, n double").groupBy("at").agg(*(F.sum(c).alias(c) for c in "ghn")).toPandas()
            out = np.zeros((*self._shape(first, level), 3))
            out.reshape(-1, 3)[sums["at"].to_numpy()] = sums[["g", "h", "n"]].to_numpy()
            return out

        return self._learn(add_up)

    def _start(self, of: list[dict], rows: int, ones: float) -> None:
        """Edges of the bins, from how often each feature's values come, and empty trees."""
        inner = 2**self.depth - 1
        self.rows, self.ones = int(rows), float(ones)
        self.feature, self.bin = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), self.bins)
        self.cut, self.leaf = np.full((self.trees, inner), np.inf), np.zeros((self.trees, inner + 1))
        p = (self.ones + 0.5) / (self.rows + 1)
        self.base = math.log(p / (1 - p))
        self.edges = []
        for counts in of:
            values = np.array(sorted(counts), np.float64)
            upto = np.cumsum([counts[v] for v in values.tolist()])
            self.edges.append(np.unique(values[np.searchsorted(upto, np.arange(1, self.bins) / self.bins * upto[-1])]) if len(values) else values)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, c]) for c, e in enumerate(self.edges)], 1).astype(np.uint8)

    def _shape(self, first: int, level: int) -> tuple:
        return min(self.together, self.trees - first), 2**level, len(self.edges), self.bins

    def _sums(self, binned: np.ndarray, y: np.ndarray, first: int, level: int) -> np.ndarray:
        """Gradients, curvatures and rows by tree of the round that begins with `first`, node of the level, feature and bin."""
        trees, width, cols, bins = self._shape(first, level)
        rows, score = np.arange(len(y)), np.full(len(y), self.base)

        def walk(t, levels):
            node = np.zeros(len(y), np.int64)
            for depth in range(levels):
                at = 2**depth - 1 + node
                node = 2 * node + (binned[rows, self.feature[t, at]] > self.bin[t, at])
            return node

        for t in range(first):
            score += self.leaf[t, walk(t, self.depth)]
        q = 1 / (1 + np.exp(-score))
        each = [np.repeat(v, cols) for v in (np.rint((y - q) * UNIT), np.rint(q * (1 - q) * UNIT), np.ones(len(y)))]
        slot, out = binned + np.arange(cols) * bins, np.zeros((trees, width * cols * bins, 3))
        for t in range(trees):
            at = (walk(first + t, level)[:, None] * (cols * bins) + slot).ravel()
            for k, v in enumerate(each):
                out[t, :, k] = np.bincount(at, v, width * cols * bins)
        return out.reshape(trees, width, cols, bins, 3)

    def _learn(self, sums) -> BoostedTrees:
        """Grow all rounds by one level at a time. sums: of a round and level, over all rows."""
        if not 0 < self.ones < self.rows:
            return self
        rng, cols = np.random.default_rng(self.seed), len(self.edges)
        for first in range(0, self.trees, self.together):
            trees = range(first, min(first + self.together, self.trees))
            barred = {t: rng.permutation(cols)[math.ceil(self.share * cols) :] for t in trees}
            for level in range(self.depth):
                found = sums(first, level) / (UNIT, UNIT, 1.0)
                for t in trees:
                    upto = found[t - first].cumsum(2)
                    (g, h, c), (gt, ht, ct) = np.moveaxis(upto[:, :, :-1], 3, 0), np.moveaxis(upto[:, :, -1:], 3, 0)
                    gain = g**2 / (h + self.penalty) + (gt - g) ** 2 / (ht - h + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(c < self.least) | (ct - c < self.least)] = -np.inf
                    gain[:, barred[t]] = -np.inf
                    for k, best in enumerate(gain.reshape(2**level, -1).argmax(1).tolist()):
                        f, b = divmod(best, self.bins - 1)
                        left = whole = upto[k, 0, -1]  # a node that isn't split sends all to the left
                        if gain[k, f, b] > 1e-9 and b < len(self.edges[f]):
                            at = 2**level - 1 + k
                            self.feature[t, at], self.bin[t, at], self.cut[t, at], left = f, b, self.edges[f][b], upto[k, f, b]
                        if level == self.depth - 1:
                            for side, (s, w, _) in enumerate((left, whole - left)):
                                self.leaf[t, 2 * k + side] = self.rate / len(trees) * s / (w + self.penalty)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-score))


def _score(model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(_matrix(batch.column(1))))], names=["id", "score"])

    return run


def held_out(id_col: str):
    """Whether a row belongs to the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label_col: str, scratch: Scratch) -> BoostedTrees:
    """Trees fitted on all labelled rows of (id, x)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    known = known.where(~held_out("id")).groupBy("id").agg(F.round(F.avg("y")).alias("y"))
    # Several texts of an id count as the one of smallest statistics.
    one = stats.join(known, "id").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    return BoostedTrees().fit_table(one.select("x", F.col("y").cast("double").alias("y")), scratch)


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Id, held_out, score and predicted of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stats = scratch.save(rows.mapInArrow(lean(_statistics_of), "id long, x array<double>"), "statistics", BATCH)
    out = stats.mapInArrow(_score(fit(stats, labels, label_col, scratch)), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def _keep(model, text_col: str, threshold: float):
    def run(batches):
        for batch in batches:
            for lo, hi, texts in by_size(batch.column(batch.schema.get_field_index(text_col)), CHUNK):
                x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
                yield batch.slice(lo, hi - lo).filter(pa.array(model.predict(x) >= threshold))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, unchanged, as a saved table. Texts are judged where they are read, without a shuffle."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull()).select(F.col("doc_id").cast("long").alias("id")).distinct()
    stats = scratch.save(rows.mapInArrow(lean(_statistics_of), "id long, x array<double>").join(known, "id", "left_semi"), "statistics", BATCH)
    model = fit(stats, labels, label_col, scratch)
    return scratch.save(docs.mapInArrow(lean(_keep(model, text_col, threshold)), docs.schema), "kept", BATCH)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op10_quality_classifier`: all documents, learnt from labels.quality."""
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
