"""URL filters: host and path rules, and a per-host tree of path templates judged by labelled purity.

Rules come first: a rule (host and path) fits its host and all subdomains if the path starts with the rule's path;
the longest wins. Every other url is judged by its template:

1. Path segments have their digit runs put as `#` and form a tree per host, level by level; what follows the first `levels` - 1 segments is one last segment.
   A segment stays named if it has at least `least` urls and, where it has over `many` siblings (ids, titles), stands out among them: by `times` their mean number of urls,
   by `known` labels or by `sure` urls, whatever its share of the parent. All others are the parent's `*`, and what lies below them is one tree.
2. Siblings are merged: branches whose share of good labels is not significantly different (one-sample z-test, 90 %) from their parent's are judged as the parent is. The
   others are put in order of that share, those above and those below the parent's apart, and neighbours whose shares don't differ significantly (two-sample z-test, 90 %) are one branch.
3. Purity is the smoothed share of good labels, down from all labels to host, branch and each further level (`strength` pseudo-labels of the purity above). A template
   of purity under `least_purity` is blocked.

All counting is on urls pre-aggregated by host and segments, so a hot host is many partial counts, not one group.

Null urls, or those without `://`: empty host and path, judged as host ''. Labels: rows (url id, good 0/1); repeated
labels of an id count as one, good only if all are; null ones are ignored. Without labels nothing is blocked.
Repeated pages are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEVELS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def judge(pages: DataFrame, labels: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url", least_purity: float = 0.5, strength: float = 10.0, least: int = 5, many: int = 50, times: int = 4, known: int = 10, sure: int = 1000, levels: int = LEVELS) -> DataFrame:
    """Host, path, rule, verdict, template and purity of every page. labels: (host, path, good 0/1) per labelled url."""
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    def cut(df: DataFrame) -> DataFrame:
        parts = F.split(F.regexp_replace("path", "[0-9]+", "#"), "/")
        segs = F.slice(parts, F.lit(2), F.size(parts))
        whole = F.concat(F.slice(segs, 1, levels - 1), F.array(F.array_join(F.slice(segs, F.lit(levels), F.size(segs)), "/")))
        return df.withColumn("segs", F.when(F.size(segs) >= levels, whole).otherwise(segs))

    labelled = cut(labels).groupBy("host", "segs").agg(F.count("*").alias("l"), F.sum("good").alias("g"))
    tree = cut(rows.select("host", "path")).groupBy("host", "segs").agg(F.count("*").alias("n")).join(labelled, ["host", "segs"], "left").na.fill(0, ["l", "g"])
    scratch = Scratch(pages.sparkSession, "url-filter")
    tree = scratch.save(tree, "tree")  # counts per host and path; read several times from here on
    whole = tree.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("l_all"), F.coalesce(F.sum("g"), F.lit(0)).alias("g_all"), F.coalesce(F.max(F.size("segs")), F.lit(0)).alias("deep"))
    l_all, g_all, deep = whole.first()
    weight = F.lit(float(strength))
    hosts = tree.groupBy("host").agg(F.sum("l").alias("l_h"), F.sum("g").alias("g_h"))
    hosts = hosts.select("host", ((F.col("g_h") + weight * F.lit((g_all + 1.0) / (l_all + 1.0))) / (F.col("l_h") + weight)).alias("purity"))
    tree = tree.join(hosts, "host").withColumn("template", F.lit(""))
    node = ["host", "template"]
    for i in range(deep):
        here = tree.withColumn("seg", F.get("segs", F.lit(i)))
        child = here.where("seg is not null").groupBy(*node, "seg").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("g").alias("g"), F.first("purity").alias("above"))
        parent = child.groupBy(*node).agg(F.count("*").alias("d"), F.sum("n").alias("of"), F.sum("l").alias("l_p"), F.sum("g").alias("g_p"))
        apart = (F.col("d") <= many) | (F.col("n") * F.col("d") >= times * F.col("of")) | (F.col("l") >= known) | (F.col("n") >= sure)
        child = scratch.save(child.join(parent, node).withColumn("name", F.when((F.col("n") >= least) & apart | (F.col("seg") == ""), F.col("seg")).otherwise("*")), "children")
        branch = child.groupBy(*node, "name").agg(F.sum("l").alias("l"), F.sum("g").alias("g"), *(F.first(c).alias(c) for c in ("above", "l_p", "g_p")))
        p0 = F.col("g_p") / F.col("l_p")
        gap = F.col("g") / F.col("l") - p0
        differs = F.when((F.col("l") > 0) & (F.col("l_p") > 0), gap * gap * F.col("l") > F.lit(2.706) * p0 * (1.0 - p0)).otherwise(False)
        branch = branch.withColumn("differs", differs).withColumn("share", F.when(F.col("differs"), F.col("g") / F.col("l")))
        by = Window.partitionBy(*node, "differs").orderBy("share", "name")
        l_0, g_0 = F.lag("l").over(by), F.lag("g").over(by)
        p, step = (F.col("g") + g_0) / (F.col("l") + l_0), F.col("share") - g_0 / l_0
        apart = (F.col("share") > p0) != (g_0 / l_0 > p0)
        other = apart | (step * step * (F.col("l") * l_0) > F.lit(2.706) * p * (1.0 - p) * (F.col("l") + l_0))
        branch = branch.withColumn("first", F.when(F.col("differs"), F.when(l_0.isNull() | other, 1).otherwise(0)))
        branch = branch.withColumn("pool", F.when(F.col("differs"), F.sum("first").over(by)).otherwise(-1)).drop("first", "share", "differs")
        pools = branch.groupBy(*node, "pool").agg(F.sum("l").alias("l_s"), F.sum("g").alias("g_s"), F.first("above").alias("above"))
        pools = pools.withColumn("here", F.when(F.col("pool") < 0, F.col("above")).otherwise((F.col("g_s") + weight * F.col("above")) / (F.col("l_s") + weight)))
        named = branch.select(*node, "name", "pool").join(pools.select(*node, "pool", "here"), [*node, "pool"])
        named = child.select(*node, "seg", "name").join(named.drop("pool"), [*node, "name"])
        ended = here.where("seg is null").select("host", "segs", "n", "l", "g", "purity", "template")
        more = here.drop("purity").join(named, [*node, "seg"]).select("host", "segs", "n", "l", "g", F.col("here").alias("purity"), F.concat("template", F.lit("/"), "name").alias("template"))
        tree = scratch.save(ended.unionByName(more), "tree")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = cut(rows).join(tree.select("host", "segs", "template", "purity"), ["host", "segs"]).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "template", "purity")
    by_template = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template")


def labelled_urls(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """Labelled urls: a page renders the document whose number is in its path, so it carries that one's label."""
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    found = pages.select(host.alias("host"), path.alias("path")).withColumn("doc_id", F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)"))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("good"))
    return found.join(good, "doc_id").select("host", "path", "good")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`op4_url_filters`: all pages, with the given rules and the quality labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))


def sql(rules=RULES) -> str:
    """The same in DuckDB SQL."""
    cases, verdicts = [], []
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{rest}')"
        cases.append(f"when {fits} then '{text}'")
        verdicts.append(f"when {fits} then '{what}'")
    rule, verdict = f"case {' '.join(cases)} end", f"case {' '.join(verdicts)} end"
    level = lambda i: f"""
a{i} as (select *, segs[{i}] as seg, sum(n) over w1 as c, sum(l) over w1 as cl, sum(n) over w2 as pn, sum(l) over w2 as pl, sum(g) over w2 as pg, count(distinct segs[{i}]) over w2 as d from t{i - 1}
  window w1 as (partition by host, template, segs[{i}]), w2 as (partition by host, template, segs[{i}] is null)),
b{i} as (select *, case when c >= 5 and (d <= 50 or c * d >= 4 * pn or cl >= 10 or c >= 1000) or seg = '' then seg else '*' end as name from a{i}),
c{i} as (select *, sum(l) over w as bl, sum(g) over w as bg from b{i} window w as (partition by host, template, seg is null, name)),
e{i} as (select distinct host, template, name, bl, bg, pl, pg, bl > 0 and pl > 0 and (bg::double / bl - pg::double / pl) * (bg::double / bl - pg::double / pl) * bl > 2.706::double * (pg::double / pl) * (1.0::double - pg::double / pl) as differs from c{i} where seg is not null),
f{i} as (select *, case when differs then bg::double / bl end as share from e{i}),
g{i} as (select *, case when lag(bl) over w is null or (share > pg::double / pl) <> (lag(share) over w > pg::double / pl)
  or (share - lag(share) over w) * (share - lag(share) over w) * (bl * lag(bl) over w) > 2.706::double * ((bg + lag(bg) over w)::double / (bl + lag(bl) over w)) * (1.0::double - (bg + lag(bg) over w)::double / (bl + lag(bl) over w)) * (bl + lag(bl) over w) then 1 else 0 end as first
  from f{i} where differs window w as (partition by host, template order by share, name)),
h{i} as (select host, template, name, cast(sum(first) over (partition by host, template order by share, name) as int) as pool from g{i}),
d{i} as (select c.*, coalesce(h.pool, -1) as pool from c{i} c left join h{i} h on c.seg is not null and c.host = h.host and c.template = h.template and c.name = h.name),
t{i} as (select host, segs, n, l, g, case when seg is null then template else template || '/' || name end as template,
  case when seg is null or pool < 0 then purity else (sum(g) over w + 10.0::double * purity) / (sum(l) over w + 10.0::double) end as purity from d{i} window w as (partition by host, template, seg is null, pool))"""  # noqa: E731
    return f"""
with rest as (select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages),
raw as (select page_id, regexp_extract(r, '^[^/?#]*') as h, r from rest),
cutting as (select page_id, translate(h, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') as path from raw),
p as (select *, str_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/')[2:] as parts from cutting),
q as (select page_id, host, path, case when len(parts) >= {LEVELS} then list_append(parts[1:{LEVELS - 1}], array_to_string(parts[{LEVELS}:], '/')) else parts end as segs,
  try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint) as doc_id from p),
lab as (select doc_id, min(quality) good from labels where doc_id is not null and quality is not null group by doc_id),
tree as (select host, segs, count(*) n, count(good) l, coalesce(sum(good), 0) g from q left join lab using (doc_id) group by all),
t0 as (select *, '' as template, (sum(g) over h + 10.0::double * ((sum(g) over () + 1.0::double) / (sum(l) over () + 1.0::double))) / (sum(l) over h + 10.0::double) as purity from tree window h as (partition by host)),
{','.join(level(i) for i in range(1, LEVELS + 1))}
select page_id, q.host, path, {rule.replace('host', 'q.host')} as rule, coalesce({verdict.replace('host', 'q.host')}, case when purity < 0.5 then 'block' else 'allow' end) as verdict, template
from q join t{LEVELS} t on q.host = t.host and q.segs = t.segs
"""
