"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least `least` characters of A-Z a-z 0-9 + / _ - with a digit or a change from lower to upper case in it, or whatever is assigned to
a secret's name (four characters or more, of any kind but white space and quotes). Its features are its length, character shares,
transitions between kinds of neighbouring characters and how likely its neighbouring characters follow each other in the documents' words, the share covered by dictionary words, whether it stands
in a path, url or mail address, and the words and marks next to it. Dictionary and transitions are learnt from all documents: the most frequent words, and
counts of pairs of characters over all words. A random forest, grown on all distinct labelled findings, gives each candidate a probability: all trees grow by one level
at a time, on counts of findings by node, feature, bin and label that Spark adds up, and only these counts come to the driver. Its trees are Spark SQL expressions, so scanning and masking are
expressions on the row and no text is shuffled.

Labelled findings are (value, before, after, label). Where none are given they are made from the documents by context: a value
assigned to a secret's name is a secret, one that neither is assigned nor follows such a name is not; all others are
left unlabelled. What makes these labels, the name and the mark of assignment, is no feature, so that the forest learns what values of either kind and
their surroundings look like instead of the rule. With findings of one class only, every candidate gets that class.

Null and empty texts have no candidates. Repeated rows are scanned each. Null ids pass through. Extra columns
pass through `mask` unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import Scratch, table

LEAST = 16
#: Names that secrets are assigned to.
NAME = "token|secret|passw|password|passwd|pwd|api_?key|access_?key|private_?key|auth|bearer|credential|client_?id"
NAMES = f"(?i)({NAME})"
ASSIGNED = r"[\"']?\s{0,3}[=:]\s{0,3}[\"'(\[]?"
#: Long runs, or at the start of a word what a name and a mark precede.
CANDIDATE = rf"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*?(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_\-]{{%d,}}+={{0,2}}|(?<![^\s\"'=:(\[])(?<=[=:][\s\"'(\[]{{0,4}})(?<=(?i:{NAME}){ASSIGNED})[^\s\"')\]]{{4,}}"
#: Words that a dictionary holds, and their least length; kinds of characters for transitions: a-z, digit, other.
WORDS, SHORT, KINDS = 4096, 3, 28
#: Function words, of which prose has many.
PROSE = "a|an|the|of|to|in|is|it|and|or|for|on|at|by|der|die|das|und|ein|ist|zu|le|la|les|de|du|et|un|une|el|los|y|en|que"
MASK = "[SECRET]"
FEATURES = ("length", "digits", "upper", "lower", "marks", "transitions", "letter_to_digit", "case_change", "hex_only", "digit_only", "distinct", "words", "in_path", "quoted", "at_mail", "line_start", "prose_before", "word_after", "digits_near", "likely")


def candidates(text: Column, least: int = LEAST) -> Column:
    """Array of (value, before, after, position of the pieces) of a text's candidates, in order."""
    pattern = F.lit(CANDIDATE % least)
    text = F.coalesce(text, F.lit(""))
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), F.split(text, CANDIDATE % least, -1).alias("piece"))


class Language:
    """What is learnt from documents: a dictionary, and logarithms of how likely a kind of character follows another in a word."""

    def __init__(self, words: list[str], follows: list[float]):
        # Texts that are split become literals when the query is planned.
        self.words = F.split(F.lit(" ".join(words)), " ")
        self.follows = F.split(F.lit(",".join(f"{v:.4f}" for v in follows)), ",").cast("array<double>")

    def covered(self, value: Column) -> Column:
        """Characters of a value in dictionary words; words end where letters do and where a capital follows a small letter."""
        parts = F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
        known = F.filter(parts, lambda w: (F.length(w) >= SHORT) & F.array_contains(self.words, w))
        return F.aggregate(known, F.lit(0), lambda total, w: total + F.length(w))

    def likely(self, value: Column) -> Column:
        """Mean logarithm over a value's pairs of neighbouring characters."""
        kinds = F.transform(F.filter(F.split(F.lower(value), ""), lambda c: c != ""), kind)
        n = F.greatest(F.size(kinds) - 1, F.lit(0))
        each = F.zip_with(F.slice(kinds, F.lit(1), n), F.slice(kinds, F.lit(2), n), lambda a, b: F.get(self.follows, a * KINDS + b))
        return F.aggregate(each, F.lit(0.0), lambda total, v: total + v) / F.greatest(n, F.lit(1))


def kind(c: Column) -> Column:
    """Number of a lower-case character's kind."""
    return F.when(c.between("a", "z") & (F.length(c) == F.octet_length(c)), F.ascii(c) - 97).when(c.between("0", "9"), 26).otherwise(27)


def learn(docs: DataFrame, text_col: str) -> Language:
    """Dictionary and transitions of all documents; at most WORDS words and KINDS * KINDS counts come to the driver."""
    word = F.explode(F.split(F.lower(F.col(text_col)), r"[\s.,;:!?()\"]+"))
    scratch = Scratch(docs.sparkSession, "secrets")
    counts = scratch.save(docs.where(F.col(text_col).isNotNull()).select(word.alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n")), "words")
    plain = counts.where(F.col("w").rlike(f"^[a-z]{{{SHORT},}}$") & (F.col("n") > 1))
    words = [r.w for r in plain.orderBy(F.col("n").desc(), "w").limit(WORDS).collect()]
    kinds = counts.select("n", F.transform(F.filter(F.split("w", ""), lambda c: c != ""), kind).alias("k"))
    n = F.greatest(F.size("k") - 1, F.lit(0))
    pairs = kinds.select("n", F.explode(F.zip_with(F.slice("k", F.lit(1), n), F.slice("k", F.lit(2), n), lambda a, b: a * KINDS + b)).alias("pair"))
    table_ = np.ones((KINDS, KINDS))
    for pair, total in pairs.groupBy("pair").agg(F.sum("n")).collect():
        table_[divmod(pair, KINDS)] += total
    scratch.drop(counts)
    return Language(words, np.log2(table_ / table_.sum(1, keepdims=True)).ravel().tolist())


def features(value: Column, before: Column, after: Column, language: Language) -> list[Column]:
    """Features of one candidate between the text before and after it."""
    n = F.length(value).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[a-z]+", "1"), "[A-Z]+", "2"), "[^0-2]+", "3")
    share = lambda chars: (n - F.length(F.regexp_replace(value, chars, ""))) / n
    yes = lambda c: c.cast("double")
    return [
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"), F.length(kinds) / n, F.regexp_count(kinds, F.lit("[12]0|0[12]")) / n, F.regexp_count(kinds, F.lit("12|21")) / n, yes(value.rlike("^(?i)[0-9a-f]+$")), yes(value.rlike("^[0-9]+$")),
        F.size(F.array_distinct(F.split(value, ""))) / n, language.covered(value) / n, yes(before.rlike(r"[/.?&%#\\]$") | after.rlike(r"^[./@]\w")),
        yes(before.rlike("[\"']$") & after.rlike("^[\"']")), yes(after.startswith("@") | before.rlike("@$")), yes((before == "") | before.rlike(r"\n\s*$")),
        yes(before.rlike(rf"(?i)(^|\s)({PROSE})\s+(\S+\s+){{0,2}}\S*$")), yes(after.rlike(r"^[.,;]?\s+[a-z]")), yes(before.rlike(r"[0-9]\s*$") | after.rlike(r"^\s*[0-9]")), language.likely(value),
    ]


class Forest:
    """Random forest of small depth, kept as nested (feature, cut, left, right) with leaf probabilities.

    Every tree sees all findings, those of either label with the same weight in all; trees differ by the features that a node may choose from. Cuts are quantiles of all findings, `bins` of their values and as many of their balanced distribution.
    """

    def __init__(self, trees: int = 12, depth: int = 4, least: int = 5, seed: int = 7, bins: int = 32):
        self.trees, self.depth, self.least, self.seed, self.bins = trees, depth, least, seed, bins
        self.roots: list = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        """From arrays."""
        cells = [(f, float(v), int(label), int(n)) for label in (0, 1) for f in range(x.shape[1]) for v, n in zip(*np.unique(x[y == label, f], return_counts=True), strict=True)]

        def count(splits, chosen):
            binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)], 1)
            for tree, node in chosen:
                at = np.ones(len(x), np.int64)
                for _ in range(node.bit_length() - 1):
                    here = np.array([splits.get((tree, k), (0, -1)) for k in at.tolist()])
                    at = 2 * at + (binned[np.arange(len(x)), here[:, 0]] > here[:, 1])
                for f in chosen[tree, node]:
                    for (b, label), n in zip(*(v.tolist() for v in np.unique(np.stack([binned[at == node, f], y[at == node]], 1).astype(np.int64), axis=0, return_counts=True)), strict=True):
                        yield tree, node, f, b, label, n

        return self._learn([int((y == v).sum()) for v in (0, 1)], cells, count)

    def fit_table(self, found: DataFrame, scratch: Scratch) -> Forest:
        """From a table (value, x, label) of any size, of which equal rows count once."""
        found = scratch.save(found.select("x", F.col("label").cast("int").alias("label"), "value").distinct().drop("value"), "findings")
        # Rounded values have a bounded number of cells; cuts need no more.
        v = F.col("v")
        v = F.when(F.abs(v) <= 1, F.round(v, 3)).when(F.abs(v) < 64, F.round(v, 2)).otherwise(F.signum(v) * F.round(F.pow(F.lit(2.0), F.round(F.log2(F.abs(v)) * 8) / 8)))
        cells = found.select("label", F.posexplode("x").alias("f", "v")).groupBy("f", v.alias("v"), "label").agg(F.count("*").alias("n")).select("f", "v", "label", "n")
        total = {r.label: r.n for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
        binned = None

        def count(splits, chosen):
            nonlocal binned
            if binned is None:
                edges = F.array(*(F.array(*map(F.lit, e)) if len(e) else F.array().cast("array<double>") for e in self.edges))
                binned = scratch.save(found.select("label", F.zip_with("x", edges, lambda v, e: F.size(F.filter(e, lambda c: c < v))).alias("b")), "bins")

            def reached(tree, node=1):
                if (tree, node) in chosen:
                    return F.struct(F.lit(tree).alias("tree"), F.lit(node).alias("node"), F.array(*map(F.lit, chosen[tree, node])).alias("fs"))
                if (tree, node) in splits:
                    f, j = splits[tree, node]
                    return F.when(F.get("b", F.lit(f)) <= j, reached(tree, 2 * node)).otherwise(reached(tree, 2 * node + 1))
                return F.lit(None).cast("struct<tree:int,node:int,fs:array<int>>")

            at = binned.select("label", "b", F.explode(F.array(*(reached(t) for t in sorted({t for t, _ in chosen})))).alias("at")).where("at is not null")
            each = at.select("label", "b", "at.tree", "at.node", F.explode("at.fs").alias("f"))
            return map(tuple, each.groupBy("tree", "node", "f", F.get("b", F.col("f")).alias("bin"), "label").agg(F.count("*").alias("n")).collect())

        return self._learn([total.get(0, 0), total.get(1, 0)], cells.collect() if min(total.get(0, 0), total.get(1, 0)) else [], count)

    def _learn(self, total: list[int], cells, count) -> Forest:
        """Grow all trees by one level at a time. total: findings by label; cells: (feature, value, label, findings); count: gives (tree, node, feature, bin, label, findings) of the nodes' chosen features.

        Nodes are numbered from 1, children of k are 2 k and 2 k + 1; a split (feature, j) sends bins up to j to the left.
        """
        if not min(total):
            self.roots = [1.0 if total[1] else 0.0]
            return self
        rng, weight = np.random.default_rng(self.seed), np.array([max(total) / n for n in total])
        of: dict[int, dict[float, float]] = {}
        for f, v, label, n in cells:
            of.setdefault(f, {})[v] = of.get(f, {}).get(v, 0.0) + n * weight[label]
        self.edges = [self._cuts(of.get(f, {})) for f in range(max(of) + 1)]
        columns = len(self.edges)
        splits: dict[tuple, tuple] = {}
        leaf = {(t, 1): 0.5 for t in range(self.trees)}  # both labels weigh the same
        nodes = list(leaf)
        for _ in range(self.depth):
            if not nodes:
                break
            chosen = {k: sorted(rng.choice(columns, min(columns, max(3, int(columns**0.5))), replace=False).tolist()) for k in nodes}
            sums = {(*k, f): np.zeros((len(self.edges[f]) + 1, 2)) for k, fs in chosen.items() for f in fs}
            for t, node, f, b, label, n in count(splits, chosen):
                sums[t, node, f][b, label] += n
            nodes = []
            for (t, node), fs in chosen.items():
                best = None
                for f in fs:
                    upto = (sums[t, node, f] * weight).cumsum(0)
                    left, right = upto[:-1], upto[-1] - upto[:-1]
                    k, m = left.sum(1), right.sum(1)
                    fits = (k >= self.least) & (m >= self.least)
                    if not fits.any():
                        continue
                    p, q = left[:, 1] / np.maximum(k, 1e-9), right[:, 1] / np.maximum(m, 1e-9)
                    impurity = np.where(fits, k * p * (1 - p) + m * q * (1 - q), np.inf)
                    j = int(impurity.argmin())
                    whole = upto[-1].sum()
                    share = upto[-1, 1] / whole
                    if impurity[j] < share * (1 - share) * whole - 1e-9 and (best is None or impurity[j] < best[0]):
                        best = (impurity[j], f, j, left[j], right[j])
                if best is None:
                    continue
                splits[t, node] = best[1:3]
                for child, (zero, one) in ((2 * node, best[3]), (2 * node + 1, best[4])):
                    leaf[t, child] = round(float(one / (zero + one)), 6)
                    if min(zero, one) > 0 and zero + one >= 2 * self.least:
                        nodes.append((t, child))

        def nested(t, node):
            if (t, node) not in splits:
                return leaf[t, node]
            f, j = splits[t, node]
            return f, self.edges[f][j], nested(t, 2 * node), nested(t, 2 * node + 1)

        self.roots = [nested(t, 1) for t in range(self.trees)]
        return self

    def _cuts(self, weights: dict[float, float]) -> list[float]:
        """Cuts of a feature from the weights of its values: between neighbours, or quantiles where there are many."""
        values = np.array(sorted(weights))
        if len(values) <= 2 * self.bins:
            cuts = (values[1:] + values[:-1]) / 2
        else:
            upto = np.cumsum([weights[v] for v in values.tolist()])
            levels = np.arange(1, self.bins + 1) / (self.bins + 1)
            cuts = np.concatenate([np.quantile(values, levels), values[np.searchsorted(upto, levels * upto[-1])]])
        return np.unique(cuts.round(6)).tolist()

    def expression(self, x: Column) -> Column:
        """Mean leaf probability for an array column of features."""

        def tree(node):
            if isinstance(node, float):
                return F.lit(node)
            f, cut, left, right = node
            return F.when(F.get(x, F.lit(f)) <= cut, tree(left)).otherwise(tree(right))

        total = tree(self.roots[0])
        for r in self.roots[1:]:
            total = total + tree(r)
        return total / len(self.roots)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def tree(node, row):
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([sum(tree(r, row) for r in self.roots) / len(self.roots) for row in x])


def _each(text: Column, least: int, one) -> Column:
    """`one(value, before, after)` of each candidate of a text, with the whole text up to the neighbouring candidates, as an array."""
    pieces = F.split(F.coalesce(text, F.lit("")), CANDIDATE % least, -1)
    after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))
    return F.transform(F.filter(F.arrays_zip(candidates(text, least).alias("c"), after.alias("after")), lambda z: z["c"]["value"].isNotNull()), lambda z: one(z["c"]["value"], z["c"]["piece"], F.coalesce(z["after"], F.lit(""))))


def _spread(docs: DataFrame, id_col: str, text_col: str, least: int, language: Language) -> DataFrame:
    """A row per candidate: id, start, value, its features and its label by context. Texts stay where they are."""
    one = lambda v, b, a: F.struct(v.alias("value"), F.length(b).alias("gap"), F.array(*features(v, b, a, language)).alias("x"), context_label(b).alias("label"))
    found = docs.where(F.col(text_col).rlike(CANDIDATE % least)).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_key"), _each(F.col(text_col), least, one).alias("found"))
    found = found.select("id", "row_key", F.posexplode("found").alias("i", "c")).select("id", "row_key", "i", "c.*")
    upto = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row_key").orderBy("i"))
    return found.withColumn("start", (upto - F.length("value")).cast("long")).drop("gap", "row_key", "i")


def context_label(before: Column) -> Column:
    """1 where a value is assigned to a secret's name, 0 where it is neither assigned nor named, null where that isn't plain."""
    named, assigned = before.rlike(NAMES + r"[\w .\-]{0,12}$"), before.rlike(NAMES + ASSIGNED + "$")
    return F.when(assigned, 1).when(~named & ~before.rlike(r"[=:]\s*[\"'(\[]?$"), 0)


def fit(labelled: DataFrame) -> Forest:
    """Forest on all distinct labelled findings (value, x, label)."""
    return Forest().fit_table(labelled.where("label in (0, 1)").select("value", "x", "label"), Scratch(labelled.sparkSession, "secrets"))


def with_features(labelled: DataFrame, language: Language) -> DataFrame:
    """(value, x, label) of given findings (value, before, after, label); null labels and values are left out."""
    x = F.array(*features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), language))
    return labelled.where("label is not null and value <> ''").select("value", x.alias("x"), "label")


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, threshold: float = 0.5) -> DataFrame:
    """A row per candidate: id, start (code points before it), length, value, score and is_secret."""
    language = learn(docs, text_col)
    found = Scratch(docs.sparkSession, "secrets").save(_spread(docs, id_col, text_col, least, language), "candidates")
    forest = fit(with_features(labelled, language) if labelled is not None else found)
    x = found.withColumn("score", F.round(forest.expression(F.col("x")), 6))
    return x.select(F.col("id").alias(id_col), "start", F.length("value").alias("length"), "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def mask(docs: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, threshold: float = 0.5) -> DataFrame:
    """`docs` with every secret in the text replaced by MASK; all other text and columns unchanged."""
    language = learn(docs, text_col)
    if labelled is None:
        labelled = Scratch(docs.sparkSession, "secrets").save(_spread(docs, id_col, text_col, least, language).where("label is not null").select("value", "x", "label"), "candidates")
    else:
        labelled = with_features(labelled, language)
    forest = fit(labelled)
    # Features are computed once for each candidate, and then asked by all trees.
    found = _each(F.col(text_col), least, lambda v, b, a: F.struct(v.alias("value"), b.alias("before"), F.array(*features(v, b, a, language)).alias("x")))
    shown = F.transform(found, lambda z: F.concat(z["before"], F.when(F.round(forest.expression(z["x"]), 6) >= threshold, MASK).otherwise(z["value"])))
    last = F.element_at(F.split(F.col(text_col), CANDIDATE % least, -1), -1)
    masked = F.concat(F.array_join(shown, ""), last)
    return docs.withColumn(text_col, F.when(F.col(text_col).rlike(CANDIDATE % least), masked).otherwise(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op9_secret_scans`: all documents; values are given as their md5."""
    return scan(table(spark, sf_dir, "documents")).withColumn("value", F.md5("value")).withColumnRenamed("value", "value_md5")
