"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a domain - language - source tree. A token budget is passed down the tree: each
node's children share its budget by weight, a child that can't use its share (its subtree holds too few tokens, even
repeated `max_epochs` times) takes all it has, and what it leaves goes to its siblings by weight. Subtree
capacities limit a node before its budget is fixed, so a shortage moves to ancestors' siblings only when all
siblings are exhausted. Shares are rounded down to whole tokens.

Each leaf takes whole epochs while its budget lasts, then a token-prefix of one more epoch: documents in
the order of md5(seed | epoch | id), as long as the tokens up to and including a key fit the rest. The prefix is found in two
steps, by sums over 4096 ranges of the key and then within the one range that the budget ends in, so no leaf is
sorted in one task, and documents are then chosen by comparing their key with the leaf's last one: texts are not shuffled.

A token here is a run of characters other than ASCII white space. Null texts have none; null languages and sources are ''.
Null ids take part with the key of ''. Rows with equal keys (repeated rows) are chosen together or not at all. An empty
table gives no rows. Other columns, whatever their names, pass through `mix` unchanged: the row travels as one struct beside the tree's columns.

A source may hold most rows, so the tree's leaves are never joined by a shuffle on the leaf alone: up to `BROADCAST` leaves are broadcast (counted first), more are
repeated for `CUTS` parts of the rows' ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, table

#: Domain of a source by its number modulo 3, and weights; anything else has weight 1.
DOMAINS = ("web", "reference", "dialogue")
DOMAIN_WEIGHTS = {"web": 3, "reference": 2, "dialogue": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
LEAF = ["domain", "lang", "source"]
#: Most leaves that are broadcast; parts of a leaf's rows where they aren't.
BROADCAST, CUTS = 100_000, 64


def _at_leaf(rows: DataFrame, leaves: DataFrame, few: bool) -> DataFrame:
    """Rows (with the columns of LEAF and id) with the columns of their leaf."""
    if few:
        return rows.join(F.broadcast(leaves), LEAF)
    cut = F.pmod(F.xxhash64("id"), F.lit(CUTS)).cast("int")
    each = leaves.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))))
    return rows.withColumn("cut", cut).join(each, [*LEAF, "cut"]).drop("cut")


def _weight(col: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, w in sorted(weights.items()):
        out = F.when(F.col(col) == k, w).otherwise(out)
    return out.cast("long")


def domain_of(source: Column) -> Column:
    """Domain of a source named by a number."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)") % 3
    return F.coalesce(F.when(number == 0, DOMAINS[0]).when(number == 1, DOMAINS[1]).when(number == 2, DOMAINS[2]), F.lit("other"))


def _leaves(df: DataFrame) -> DataFrame:
    df = df.withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    return df.withColumn("domain", domain_of(F.col("source")))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`quota` of each child from its parent's `budget`, by weight, capped by `capacity`."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = nodes.withColumns({"taken": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "left": F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    full = F.col("capacity") * F.col("left") <= F.col("weight") * (F.col("budget") - F.col("taken"))
    x = x.withColumn("full", full)
    rest = F.first(F.when(~F.col("full"), F.struct("taken", "left")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("rest", rest)
    share = F.floor(F.expr("weight * greatest(budget - rest.taken, 0) div rest.left"))
    return x.withColumn("quota", F.when(F.col("full"), F.col("capacity")).otherwise(share).cast("long")).drop("taken", "left", "full", "rest")


def quotas(leaves: DataFrame, percent: int, max_epochs: int) -> DataFrame:
    """`quota` of every leaf of (domain, lang, source, tokens)."""
    cap = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    domains = cap.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("domain", DOMAIN_WEIGHTS))
    total = F.sum("tokens").alias("all_tokens")
    domains = domains.crossJoin(F.broadcast(leaves.agg(total)))  # one row
    domains = domains.withColumn("budget", F.expr(f"all_tokens * {int(percent)} div 100"))
    domains = share_out(domains, [], "domain").select("domain", F.col("quota").alias("budget"))
    langs = cap.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("lang", LANG_WEIGHTS)).join(domains, "domain")
    langs = share_out(langs, ["domain"], "lang").select("domain", "lang", F.col("quota").alias("budget"))
    sources = cap.withColumn("weight", F.lit(1).cast("long")).join(langs, ["domain", "lang"])
    return share_out(sources, ["domain", "lang"], "source").select(*LEAF, "tokens", "quota")


def n_tokens(text_col: str) -> Column:
    """Number of white-space separated words."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _key(seed: str, epoch: Column, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def plan(counted: DataFrame, *, percent: int, max_epochs: int, seed: str) -> tuple[DataFrame, bool]:
    """Per leaf: quota, whole epochs, and the last key of the prefix of the epoch after them; and whether leaves are few. counted: (id, leaf, n_tokens)."""
    scratch = Scratch(counted.sparkSession, "mixing")
    leaves = scratch.save(counted.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    few = leaves.count() <= BROADCAST
    leaf = quotas(leaves, percent, max_epochs)
    leaf = leaf.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(0).cast("long"))
    leaf = leaf.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
    leaf = scratch.save(leaf.select(*LEAF, "quota", "epochs", "rest"), "quotas")
    keyed = _at_leaf(counted.select("id", *LEAF, "n_tokens"), leaf.select(*LEAF, "epochs", "rest"), few).withColumn("key", _key(seed, F.col("epochs"), "id"))
    keyed = keyed.withColumn("range", F.substring("key", 1, 3)).select(*LEAF, "rest", "range", "key", "n_tokens")
    sums = keyed.groupBy(*LEAF, "rest", "range").agg(F.sum("n_tokens").alias("part"), F.max("key").alias("last"))
    upto = sums.withColumn("upto", F.sum("part").over(Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    whole = upto.where("upto <= rest").groupBy(*LEAF).agg(F.max("last").alias("cut"))
    ends = upto.where("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("range", (F.col("upto") - F.col("part")).alias("before"))).alias("e")).select(*LEAF, F.col("e.range").alias("range"), F.col("e.before").alias("before"))
    here = keyed.withColumn("id", F.col("key"))
    inner = _at_leaf(here, ends.withColumnRenamed("range", "end"), few).where(F.col("range") == F.col("end")).groupBy(*LEAF, "range", "before", "rest", "key").agg(F.sum("n_tokens").alias("part"))
    inner = inner.withColumn("upto", F.col("before") + F.sum("part").over(Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    last = inner.where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("cut_in"))
    done = leaf.join(whole, LEAF, "left").join(last, LEAF, "left").select(*LEAF, "quota", "epochs", F.greatest("cut", "cut_in").alias("cut"))
    return scratch.save(done.withColumnRenamed("cut", "last"), "plan"), few


def choose(rows: DataFrame, leaves: DataFrame, few: bool, *, seed: str) -> DataFrame:
    """Rows (id, columns of LEAF, others), once for each epoch that takes them, with `epoch`."""
    x = _at_leaf(rows, leaves, few).withColumn("in_prefix", F.coalesce(_key(seed, F.col("epochs"), "id") <= F.col("last"), F.lit(False)))
    takes = F.col("epochs") + F.col("in_prefix").cast("long")
    return x.where(takes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), takes - 1))).drop("in_prefix", "quota", "epochs", "last")


def mix(docs: DataFrame, *, percent: int = 60, max_epochs: int = 2, seed: str = "mix", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The chosen rows with all columns of `docs` and nothing else, repeated for each epoch that takes them."""
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = scratch.save(_leaves(docs.select(F.col(id_col).alias("id"), "lang", "source", n_tokens(text_col).alias("n_tokens"))), "counted")
    leaves, few = plan(counted, percent=percent, max_epochs=max_epochs, seed=seed)
    rows = _leaves(docs.select(F.col(id_col).alias("id"), "lang", "source", F.struct("*").alias("row")))
    return choose(rows, leaves, few, seed=seed).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op5_mixing`: all documents; a budget of 60 % of their tokens, at most two epochs of a source."""
    docs = table(spark, sf_dir, "documents")
    counted = Scratch(spark, "mixing").save(_leaves(docs.select(F.col("doc_id").alias("id"), "lang", "source", n_tokens("text").alias("n_tokens"))), "counted")
    leaves, few = plan(counted, percent=60, max_epochs=2, seed="mix")
    return choose(counted, leaves, few, seed="mix").select(F.col("id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch")


def sql(docs: str = "documents", percent: int = 60, max_epochs: int = 2, seed: str = "mix", columns: str = "doc_id, domain, lang, source, n_tokens, epoch") -> str:
    """The same in DuckDB SQL, with one running sum per leaf."""
    weight = lambda col, w: "case " + " ".join(f"when {col} = '{k}' then {v}" for k, v in w.items()) + " else 1 end"
    share = lambda part: f"""select *, case when capacity * lft <= weight * (budget - taken) then capacity
  else cast(floor(weight * greatest(budget - min(case when capacity * lft > weight * (budget - taken) then taken end) over (partition by {part}), 0) // max(case when capacity * lft > weight * (budget - taken) then lft end) over (partition by {part})) as bigint) end as quota
  from (select *, coalesce(sum(capacity) over (partition by {part} order by capacity / weight, name rows between unbounded preceding and 1 preceding), 0)::bigint taken,
  (sum(weight) over (partition by {part}) - coalesce(sum(weight) over (partition by {part} order by capacity / weight, name rows between unbounded preceding and 1 preceding), 0))::bigint lft from base)"""  # noqa: E731
    return f"""
with named as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens,
  try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') as bigint) % 3 as num from {docs}),
counted as (select doc_id, lang, source, n_tokens, coalesce(case num when 0 then 'web' when 1 then 'reference' when 2 then 'dialogue' end, 'other') as domain from named),
leaves as (select domain, lang, source, sum(n_tokens)::bigint tokens from counted group by all),
dq as (with base as (select domain, domain as name, (sum(tokens) * {max_epochs})::bigint capacity, {weight('domain', DOMAIN_WEIGHTS)} weight, (select sum(tokens) from leaves)::bigint * {percent} // 100 as budget from leaves group by domain) {share('1')}),
lq as (with base as (select l.domain, lang, lang as name, (sum(tokens) * {max_epochs})::bigint capacity, {weight('lang', LANG_WEIGHTS)} weight, any_value(dq.quota) budget from leaves l join dq on l.domain = dq.domain group by l.domain, lang) {share('domain')}),
sq as (with base as (select l.domain, l.lang, l.source, l.source as name, l.tokens, l.tokens * {max_epochs} as capacity, 1 as weight, lq.quota budget from leaves l join lq on l.domain = lq.domain and l.lang = lq.lang) {share('domain, lang')}),
plan as (select domain, lang, source, tokens, quota, case when tokens > 0 then quota // tokens else 0 end epochs from sq),
keyed as (select c.*, epochs, quota - epochs * tokens as rest, md5('{seed}|' || epochs || '|' || coalesce(doc_id::varchar, '')) as key from counted c join plan using (domain, lang, source)),
upto as (select *, sum(n_tokens) over (partition by domain, lang, source order by key) as upto from keyed),
taken as (select *, epochs + (upto <= rest)::int as takes from upto)
select {columns} from (select *, unnest(range(0, takes::bigint)) as epoch from taken where takes > 0)
"""
