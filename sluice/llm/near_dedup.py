"""Embedding near-dedup by range search on a robust-pruned flat graph.

1. Equal vectors are one point. Centroids are fitted on a bounded sample (`sample_rows`, smallest id hashes); each point
   is put into the shards of its two nearest centroids, so shards overlap. A shard of more than `shard_rows` points is split by
   id hash, and what searches it searches all its parts.
2. In each shard a graph is built: every point's nearest candidates, robustly pruned (a candidate is dropped if a
   neighbour already chosen is `alpha` times nearer to it than the point is). The adjacency lists of a point from all its shards are united.
3. Every point searches the shards of its `probes` nearest centroids: greedily from the shard's medoids (and, where it is a member,
   itself), expanding the best open node; then every open node within the range (threshold less `slack`) is expanded until none
   is left. Similarities are cosines in double precision, so each link found is verified. A link is two-sided: found from either end, it counts for both. Of the
   places where its ends can meet, the task of one (a shard that holds both, if there is any) counts it, so that no other task counts it again.
4. Before the search, probes and width are widened until a trial with the audited points alone promises the target. Recall is audited on links between distinct points, without copies: random points are held against all points by brute force, `audit` at first and more in blocks
   until they have `audit_links` links (32 times `audit` points at most). While their links counted are under `target`, the search runs again with more
   probes and wider, in the end over all shards by full products. The last recall is given in `audit_recall`, null where the audited points have no link at all.

Links are counted in the tasks, only a spanning forest of them is put out, and components are joined by star rounds.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. A null id: component_id and kept are null. Repeated
rows are equal vectors. Rows of one id with different vectors are different points: each row has its own vector's links and component, and `kept` where that begins with its id. Vectors of several lengths: each length is compared by itself. Labels and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, connected_components, shuffle_partitions, smallest, table
from sluice.llm.vectors import doubles, matrix, usable


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def pruned_graph(x: np.ndarray, degree: int, pool: int, alpha: float) -> list[np.ndarray]:
    """Adjacency of each unit row: its nearest rows, robustly pruned."""
    out, n = [], len(x)
    for lo in range(0, n, 512):
        sims = x[lo : lo + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -2
        k = min(pool, n - 1)
        near = np.argpartition(-sims, k - 1, 1)[:, :k] if k > 0 else np.empty((len(sims), 0), int)
        for row, cand in zip(sims, near, strict=True):
            cand = cand[np.argsort(-row[cand], kind="stable")]
            own = 2 - 2 * row[cand]  # squared distances
            among = 2 - 2 * (x[cand] @ x[cand].T)
            open_, chosen = np.ones(len(cand), bool), []
            for i in range(len(cand)):
                if open_[i]:
                    chosen.append(i)
                    if len(chosen) == degree:
                        break
                    open_ &= alpha * alpha * np.maximum(among[i], 0) > own
                    open_[: i + 1] = False
            out.append(cand[chosen])
    return out


def range_search(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, starts: np.ndarray, own: np.ndarray, least: float, width: int) -> np.ndarray:
    """Cosines (queries by rows) of all rows visited, -2 elsewhere. graph: adjacency padded with -1; own: a query's row or -1."""
    at = np.arange(len(queries))
    sims = np.full((len(queries), len(x) + 1), -2.0)  # the last column takes the padding
    closed = np.zeros(sims.shape, bool)
    closed[:, -1] = True
    sims[:, starts] = queries @ x[starts].T
    has = own >= 0
    sims[at[has], own[has]] = 1.0
    step, live = 0, at
    while len(live):
        open_ = np.where(closed[live], -3.0, sims[live])
        best = open_.argmax(1)
        value = open_[np.arange(len(live)), best]
        go = (value > -2) & ((value >= least) | (step < width))
        live, best = live[go], best[go]
        closed[live, best] = True
        next_ = graph[best]
        fresh = (next_ >= 0) & (sims[live[:, None], next_] == -2)
        q, col = np.nonzero(fresh)
        nodes = next_[q, col]
        sims[live[q], nodes] = np.einsum("ij,ij->i", queries[live[q]], x[nodes])
        step += 1
    return sims[:, :-1]


def _assign(shared, many: int):
    def run(batches):
        c = shared.value
        for batch in batches:
            v = matrix(batch.column("vec"))
            near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :many]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("copies"), batch.column("vec"), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "copies", "vec", "near"])

    return run


def _build(degree: int, pool: int, alpha: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["vec_id"].to_numpy()
        lists = pruned_graph(matrix(part["vec"].tolist()), degree, pool, alpha)
        return pd.DataFrame({"vec_id": ids, "next": [ids[x] for x in lists]})

    return run


def _roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id reachable for each position by the links (a, b) of positions."""
    low = ids.copy()
    while len(a):
        old = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (old == low).all():
            break
    return low


def _owned(shard: int, every: bool, homes: np.ndarray, asked: np.ndarray, other_homes: np.ndarray, other_asked: np.ndarray) -> np.ndarray:
    """Whether each pair (one row a pair: shards that hold an end, shards that it asks) is counted in this shard."""
    places = np.hstack([homes, other_homes])
    among = lambda a, b: (a[:, :, None] == b[:, None, :]).any(2)
    apart = ~np.hstack([among(homes, other_homes), among(other_homes, homes)])
    cost = places + apart * (1 << 20)
    if not every:
        cost[~np.hstack([among(homes, other_asked), among(other_homes, asked)])] = 1 << 40
    return cost.min(1) % (1 << 20) == shard


def _shard(part: pd.DataFrame):
    """A shard's members and askers: (members, asks, ids, vectors, graph, medoids, asking ids, asking vectors, their rows among the members or -1), or None without either."""
    members = part[part["member"]].drop_duplicates("vec_id").sort_values("vec_id", kind="stable")
    asks = part[part["asks"]].drop_duplicates("vec_id").sort_values("vec_id", kind="stable")
    if not len(members) or not len(asks):
        return None
    ids, x = members["vec_id"].to_numpy(), matrix(members["vec"].tolist())
    lists = []
    for n in members["next"]:
        n = np.asarray(n if n is not None else [], np.int64)
        at = np.minimum(np.searchsorted(ids, n), len(ids) - 1)
        lists.append(at[ids[at] == n])
    graph = np.full((len(ids) + 1, max(1, max(map(len, lists)))), -1)
    for i, n in enumerate(lists):
        graph[i, : len(n)] = n
    middle = x.mean(0)
    starts = np.unique(np.r_[(x @ middle).argmax(), (x @ x[(x @ middle).argmin()]).argmax(), (x @ -middle).argmax()])
    qid, qx = asks["vec_id"].to_numpy(), matrix(asks["vec"].tolist())
    own = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
    return members, asks, ids, x, graph, starts, qid, qx, np.where(ids[own] == qid, own, -1)


def _trial(threshold: float, slack: float, width: int):
    """(point, link found) of the points that ask."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        held = _shard(part)
        if held is None:
            return pd.DataFrame({"vec_id": [], "hit": []}).astype("int64")
        _, _, ids, x, graph, starts, qid, qx, own = held
        found = [(np.empty(0, np.int64),) * 2]
        for lo in range(0, len(qid), 256):
            s = slice(lo, lo + 256)
            q, m = np.nonzero(range_search(qx[s], x, graph, starts, own[s], threshold - slack, width) >= threshold)
            found.append((qid[s][q], ids[m]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"vec_id": a[a != b], "hit": b[a != b]})

    return run


def _search(threshold: float, slack: float, width: int, every: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        held = _shard(part)
        if held is None:
            return pd.DataFrame({"vec_id": [], "links": [], "points": [], "root": []}).astype("int64")
        members, asks, ids, x, graph, starts, qid, qx, own = held
        shard = int(part["shard"].iloc[0])
        copies, homes, asked = ([np.array(df[c].tolist(), np.int64) for df in (members, asks)] for c in ("copies", "homes", "near"))
        # Links and linked points of members and of those who ask without being members.
        links, linked = ([np.zeros(len(ids), np.int64), np.zeros(len(qid), np.int64)] for _ in range(2))
        within, every_id = np.zeros((len(ids), len(ids)), bool), np.concatenate([ids, qid])
        one, two = [], []
        for lo in range(0, len(qid), 256):
            s = slice(lo, lo + 256)
            hit = (qx[s] @ x.T if every else range_search(qx[s], x, graph, starts, own[s], threshold - slack, width)) >= threshold
            inside = own[s] >= 0
            hit[np.flatnonzero(inside), own[s][inside]] = False
            within[own[s][inside]] = hit[inside]
            q, m = np.nonzero(hit)
            one.append(q + lo + len(ids))
            two.append(m)
            q, m = q[~inside[q]] + lo, m[~inside[q]]
            mine = _owned(shard, every, homes[1][q], asked[1][q], homes[0][m], asked[0][m])
            # Members of two cuts of one shard ask each other: the smaller id's question counts.
            mine &= (qid[q] < ids[m]) | (homes[1][q] != shard).all(1)
            q, m = q[mine], m[mine]
            for to, of, other, side in ((1, q, m, 0), (0, m, q, 1)):
                np.add.at(links[to], of, copies[side][other])
                np.add.at(linked[to], of, 1)
        within |= within.T
        for lo in range(0, len(ids), 256):
            a, b = np.nonzero(within[lo : lo + 256])
            a += lo
            mine = _owned(shard, every, homes[0][a], asked[0][a], homes[0][b], asked[0][b])
            np.add.at(links[0], a[mine], copies[0][b[mine]])
            np.add.at(linked[0], a[mine], 1)
        one, two = np.concatenate(one), np.concatenate(two)
        low = _roots(every_id, np.r_[one, np.flatnonzero(own >= 0) + len(ids)], np.r_[two, own[own >= 0]])
        met = np.unique(np.r_[two, own[own >= 0]])
        out = pd.DataFrame({"vec_id": ids[met], "links": links[0][met], "points": linked[0][met], "root": low[met]})
        met = np.flatnonzero((own < 0) & ((linked[1] > 0) | (low[len(ids) :] != qid) | np.isin(np.arange(len(qid)) + len(ids), one)))
        return pd.concat([out, pd.DataFrame({"vec_id": qid[met], "links": links[1][met], "points": linked[1][met], "root": low[len(ids) + met]})])

    return run


def _audit(shared, threshold: float):
    def run(batches):
        x = shared.value
        found = np.zeros(len(x), np.int64)
        for batch in batches:
            v, rows = matrix(batch.column("vec")), max(64, 1_000_000 // len(x))
            for lo in range(0, len(v), rows):
                found += ((x @ v[lo : lo + rows].T) >= threshold).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(found)], names=["at", "n"])

    return run


def _true_links(points: DataFrame, threshold: float, audit: int, audit_links: int) -> dict[int, int]:
    """Linked points of each audited point, by brute force; audited points are added in blocks until they have enough links."""
    asked = smallest(points, 32 * audit, "vec_id").select("vec_id", "vec").toPandas()
    truth: dict[int, int] = {}
    at = 0
    while at < len(asked) and sum(truth.values()) < audit_links:
        block = asked[at : max(audit, 4 * at)]
        at += len(block)
        shared = points.sparkSession.sparkContext.broadcast(matrix(block["vec"].tolist()))
        found = points.mapInArrow(_audit(shared, threshold), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toPandas()
        truth |= dict(zip(block["vec_id"].tolist(), (found["n"] - 1).tolist(), strict=True))
    return truth


def _near_points(points: DataFrame, *, threshold, shard_rows, sample_rows, degree, pool, alpha, slack, probes, width, audit, audit_links, target, most_shards, scratch) -> DataFrame:
    """(vec_id, n_links, component_id, audit_recall) of distinct unit vectors (vec_id, copies, vec) of one length; vec_id is any number that no other point has."""
    spark, parts = points.sparkSession, shuffle_partitions(points.sparkSession)
    n = points.count()
    sample = smallest(points, max(sample_rows, 4 * min(most_shards, round(n / (shard_rows / 2)))), "vec_id").select("vec").toPandas()
    c = centroids(matrix(sample["vec"].tolist()), min(most_shards, max(1, round(n / (shard_rows / 2)))))
    shared = spark.sparkContext.broadcast(c)  # at most `most_shards` centroids
    reach = min(len(c), 4 * probes)
    near = scratch.save(points.mapInArrow(_assign(shared, reach), "vec_id long, copies long, vec array<double>, near array<int>"), "near")
    shards = near.select("vec_id", F.explode(F.slice("near", 1, 2)).alias("shard")).groupBy("shard").count()
    shards = shards.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("cuts"))
    member = near.select("vec_id", "copies", "vec", F.slice("near", 1, 2).alias("homes"), "near", F.explode(F.slice("near", 1, 2)).alias("shard")).join(shards, "shard")
    member = member.withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
    built = member.groupBy("shard", "cut").applyInPandas(_build(degree, pool, alpha), "vec_id long, next array<long>")
    united = built.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))  # two lists at most
    member = scratch.save(member.join(united, "vec_id").select("shard", "cut", "cuts", "vec_id", "copies", "vec", "homes", "near", "next", F.lit(True).alias("member"), (F.col("cuts") == 1).alias("asks")), "graph")
    truth, size = _true_links(near, threshold, audit, audit_links), min(len(c), probes)
    names, every, want = spark.createDataFrame([(v,) for v in truth], "vec_id long"), False, sum(truth.values())

    def blocks(every: bool) -> Column:
        """Blocks of a shard's askers: of about `shard_rows` points where every point asks, else as many as the shard has cuts."""
        return F.lit(max(1, round(n / (4 * shard_rows)))) if every else F.col("cuts")

    def dealt(members: DataFrame, every: bool) -> DataFrame:
        """Members for each block of askers; they ask their own shard in the first block alone."""
        rows = members.withColumn("block", F.explode(F.sequence(F.lit(0), blocks(every).cast("int") - 1)))
        return rows.withColumn("asks", F.col("asks") & (F.col("block") == 0)).drop("cuts")

    def asking(points: DataFrame, size: int, every: bool) -> tuple[DataFrame, Column]:
        """Rows of what points ask beside the shards that they are members of, or of cuts of those; and the shards that a point asks."""
        seen = F.array().cast("array<int>") if every else F.slice("near", 1, size)
        asks = points.select("vec_id", "copies", "vec", F.slice("near", 1, 2).alias("homes"), seen.alias("near"), F.explode(F.sequence(F.lit(0), F.lit(len(c) - 1)) if every else F.slice("near", 1, size)).alias("shard")).join(shards, "shard")
        asks = asks.where(~F.array_contains("homes", F.col("shard")) | (F.col("cuts") > 1)).withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1)))
        # Askers come in blocks, each of which meets the cut's members once, so that no task holds all that ask a shard; a cut's own members are in its first block together.
        own = F.array_contains("homes", F.col("shard")) & (F.col("cut") == F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
        asks = asks.withColumn("block", F.when(own, 0).otherwise(F.pmod(F.xxhash64("vec_id", F.lit(5)), blocks(every))).cast("int"))
        return asks.select("shard", "cut", "block", "vec_id", "copies", "vec", "homes", "near", F.lit(None).cast("array<long>").alias("next"), F.lit(False).alias("member"), F.lit(True).alias("asks")), seen

    # Probes and width are first tried on the audited points alone; a link that one end misses with chance 1 - r is missed by both with the square of that.
    while want:
        asks, _ = asking(near.join(F.broadcast(names), "vec_id"), size, False)
        audited = member.join(F.broadcast(names.withColumn("audited", F.lit(True))), "vec_id", "left").withColumn("asks", F.col("asks") & F.coalesce("audited", F.lit(False))).drop("audited")
        pairs = dealt(audited, False).unionByName(asks).groupBy("shard", "cut", "block").applyInPandas(_trial(threshold, slack, width), "vec_id long, hit long")
        hits = dict(pairs.distinct().groupBy("vec_id").count().collect())
        once = sum(min(hits.get(v, 0), t) for v, t in truth.items()) / want
        if 1 - (1 - once) ** 2 >= target or size == reach and width >= 40:
            break
        size, width = min(reach, 2 * size), 2 * width
    while True:
        asks, seen = asking(near, size, every)
        found = scratch.save(dealt(member.withColumn("near", seen), every).unionByName(asks).groupBy("shard", "cut", "block").applyInPandas(_search(threshold, slack, width, every), "vec_id long, links long, points long, root long"), "found")
        sums = found.groupBy("vec_id").agg(F.sum("links").alias("links"), F.sum("points").alias("points"))
        got = dict(sums.join(F.broadcast(names), "vec_id").select("vec_id", "points").collect())
        recall = sum(min(got.get(v, 0), t) for v, t in truth.items()) / want if want else None
        if recall is None or recall >= target or every:
            break
        scratch.drop(found)
        every, size, width = size == reach and width >= 40, min(reach, 2 * size), 2 * width
    comps = connected_components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch)
    out = near.select("vec_id", "copies").join(sums, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.lit(recall).cast("double").alias("audit_recall"))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, shard_rows: int = 2500, sample_rows: int = 20_000, degree: int = 24, pool: int = 64, alpha: float = 1.2, slack: float = 0.05, probes: int = 3, width: int = 10, audit: int = 200, audit_links: int = 2000, target: float = 0.98, most_shards: int = 16_384) -> DataFrame:
    """n_links, component_id, kept and audit_recall for every row of `vectors`."""
    scratch = Scratch(vectors.sparkSession, "near-dedup")
    rows = doubles(vectors, id_col, vec_col)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    unit = F.transform("vec", lambda v: v / norm)
    largest = F.array_max(F.transform("vec", F.abs))
    rows = rows.withColumn("vec", F.transform("vec", lambda v: v / largest)).withColumn("vec", unit)
    rows = scratch.save(rows.select("vec_id", "vec", F.size("vec").alias("width"), F.sha2(F.array_join("vec", ","), 256).alias("same")), "unit")
    points = rows.groupBy("same", "width").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    # Points have numbers of their own, as rows of one id may have different vectors. They are the same on every read of what is saved.
    points = scratch.save(points.withColumn("point", F.monotonically_increasing_id()), "points")
    done = None
    for (width_,) in points.select("width").distinct().orderBy("width").collect():  # one in any table of one model's vectors
        part = _near_points(points.where(F.col("width") == width_).select(F.col("point").alias("vec_id"), "copies", "vec"), threshold=threshold, shard_rows=shard_rows, sample_rows=sample_rows, degree=degree, pool=pool, alpha=alpha, slack=slack, probes=probes, width=width, audit=audit, audit_links=audit_links, target=target, most_shards=most_shards, scratch=scratch)
        done = part if done is None else done.unionByName(part)
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"), usable(F.col(vec_col).cast("array<double>")).alias("usable"))
    alone = ids.where("not usable or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("audit_recall"))
    if done is not None:
        named = scratch.save(points.select("same", "point", "vec_id").join(done.withColumnsRenamed({"vec_id": "point", "component_id": "group"}), "point"), "named")
        lowest = named.groupBy("group").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")  # a point alone is its own
        named = named.join(lowest, "group", "left").select("same", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"), "audit_recall")
        alone = rows.select("vec_id", "same").join(named, "same").select("vec_id", "n_links", "component_id", "audit_recall").unionByName(alone)
    return alone.select(F.col("vec_id").alias(id_col), "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "audit_recall")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op1_embedding_near_dedup`: all embeddings, cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
