"""URL filters by a path-template tree.

Per host, paths are walked from the root as a tree of segments. A segment's digits
become ``<n>`` at once; level by level, a node whose rare children are many and hardly
repeat is a variable position, and these become the wildcard ``*``. A child that is
well supported, or whose share of labelled examples a two-proportion test tells apart
from the other rare ones', stays literal, however many there are.
Labels come from the explicit rules: a url that one blocks or allows is an example of its
kind, any other url is none. First-level branches that have examples and whose blocked
shares a two-proportion test can't tell apart are merged into classes; branches without
examples are in none. A template's purity is the share of blocked ones among its examples,
smoothed by its class, its host and all hosts in turn, each weighing as its examples do. It is
rejected if its class has ``examples`` of them and the purity reaches ``reject``: so a url
that no rule covers is blocked where it lies among examples that are. ``evaluate`` hides a
fifth of the labels and tells how the tree judges those urls.

All counting is by groupBy with map-side partial sums, so a hot host is a row a task, and
joins deal a hot host's rows over tasks. The only windows take a row per distinct pair of
counts in a host: branches of equal counts are never told apart.

Defined results: null or a url without ``://`` has an empty host and path and takes
part as such; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, spread_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Segments after the first slash, with runs of digits generalised."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), lambda s: F.regexp_replace(s, "[0-9]+", "<n>"))


def _apart(b: Column, n: Column, b0: Column, n0: Column, z: float) -> Column:
    """Whether a two-proportion test tells b of n from b0 of n0."""
    pooled = (b + b0) / F.greatest(n + n0, F.lit(1))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(n0, F.lit(1))))
    return F.coalesce(F.abs(b / F.greatest(n, F.lit(1)) - b0 / F.greatest(n0, F.lit(1))) > z * spread, F.lit(False))


def template_tree(urls: DataFrame, support: int = 8, repeat: float = 2.0, few: int = 8, z: float = 1.64) -> DataFrame:
    """urls (host, segs, blocked, allowed) -> (host, segs, branch, template, n, blocked, allowed), one row per distinct shape.

    A node's children that occur under ``support`` times are wild if there are more than ``few`` of them and they occur under ``repeat`` times each on average, but for those whose blocked or allowed share is apart from the others'. The walk goes as deep as a node has more than ``few`` shapes below it; under any other node nothing can be wild.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    t = urls.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    t = stored(t.withColumns({"template": F.lit(""), "branch": F.lit("")}))
    done, d = None, 0
    while True:
        node, has = ["host", "template"], F.size("segs") > d
        below = t.where(has).groupBy(*node).agg(F.count(F.lit(1)).alias("hot_n"))
        wide = stored(below.where(F.col("hot_n") > few))
        t = spread_join(t, wide.select(*node, F.lit(True).alias("wide")), node, counts=wide)
        walks = has & F.coalesce("wide", F.lit(False))
        rest = F.when(has, F.concat(F.lit("/"), F.concat_ws("/", F.slice("segs", d + 1, F.greatest(F.size("segs") - d, F.lit(1)))))).otherwise(F.lit(""))
        ended = t.where(~walks).withColumn("branch", F.concat(F.lit("/"), F.col("segs")[0]) if d == 0 else F.col("branch")).withColumn("template", F.concat("template", rest))
        ended = ended.select("host", "segs", "branch", "template", "n", "blocked", "allowed")
        done = ended if done is None else done.unionAll(ended)
        if not wide.limit(1).count():
            return stored(done)
        t = stored(t.where(walks).drop("wide").withColumn("seg", F.col("segs")[d]))
        kids = t.groupBy("host", "template", "seg").agg(*sums)
        counts = stored(kids)
        kids = counts.where(F.col("n") < support)
        nodes = kids.groupBy(*node).agg(F.count(F.lit(1)).alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "allowed")])
        nodes = nodes.where((F.col("kids") > few) & (F.col("all_n") < repeat * F.col("kids")))
        others = lambda c: F.col(f"all_{c}") - F.col(c)
        told = _apart(F.col("blocked"), F.col("n"), others("blocked"), others("n"), z) | _apart(F.col("allowed"), F.col("n"), others("allowed"), others("n"), z)
        labelled = F.col("blocked") + F.col("allowed") > 0
        wild = spread_join(kids, nodes, node, "inner").where(~(labelled & told)).select("host", "template", "seg", F.lit(True).alias("wild"))
        t = spread_join(t, wild, ["host", "template", "seg"])
        t = t.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("wild"), F.lit("*")).otherwise(F.col("seg"))))
        t = stored(t.withColumn("branch", F.col("template") if d == 0 else F.col("branch")).select("host", "segs", "n", "blocked", "allowed", "template", "branch"))
        d += 1


def judge_templates(tree: DataFrame, reject: float = 0.5, strength: float = 4.0, z: float = 1.64, examples: int = 4) -> DataFrame:
    """(host, template, class, purity, rejected) of every template. purity: the smoothed share of blocked examples; class: null without any."""
    tree = tree.select("host", "branch", "template", (F.col("blocked") + F.col("allowed")).alias("n"), "blocked")
    sums = [F.sum(c).alias(c) for c in ("n", "blocked")]
    rate = lambda b, n, prior: (b + F.lit(strength) * prior) / (n + F.lit(strength))
    branch = stored(tree.groupBy("host", "branch").agg(*sums))
    hosts = branch.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("n").alias("hn"), F.count(F.lit(1)).alias("hot_n"))
    hosts = stored(hosts)
    top = hosts.agg((F.coalesce(F.sum("hb"), F.lit(0)) + 1) / (F.coalesce(F.sum("hn"), F.lit(0)) + 2)).first()[0]
    rates = hosts.select("host", rate(F.col("hb"), F.col("hn"), F.lit(top)).alias("host_rate"))
    b = spread_join(branch, rates, "host", counts=hosts.select("host", "hot_n")).withColumn("rate", rate(F.col("blocked"), F.col("n"), F.col("host_rate")))
    alike = ["host", "blocked", "n"]
    c = b.where("n > 0").groupBy(*alike, "rate", "host_rate").agg(F.count(F.lit(1)).alias("branches"))
    w = W.partitionBy("host").orderBy("rate", "blocked", "n")
    apart = _apart(F.col("blocked"), F.col("n"), F.lag("blocked").over(w), F.lag("n").over(w), z).cast("int")
    c = c.withColumn("apart", apart).withColumn("class", F.sum("apart").over(w.rowsBetween(W.unboundedPreceding, 0)))
    v = W.partitionBy("host", "class")
    total = lambda x: F.sum(F.col(x) * F.col("branches")).over(v)
    c = stored(c.select(*alike, "class", total("n").alias("class_n"), rate(total("blocked"), total("n"), F.col("host_rate")).alias("class_rate")))
    b = spread_join(stored(b.select("host", "branch", "blocked", "n", "host_rate")), c, alike).select("host", "branch", "class", F.coalesce("class_n", F.lit(0)).alias("class_n"), F.coalesce("class_rate", "host_rate").alias("class_rate"))
    t = spread_join(stored(tree.groupBy("host", "branch", "template").agg(*sums)), stored(b), ["host", "branch"])
    return t.select("host", "template", "class", "class_n", rate(F.col("blocked"), F.col("n"), F.col("class_rate")).alias("purity")).withColumn("rejected", (F.col("class_n") >= examples) & (F.col("purity") >= reject)).drop("class_n")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, hide: Column | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity, rejected) of every row: the rule's verdict, else the template's. hide: of the key; rows whose labels the tree must not see."""
    p = only(pages, key, url)
    host, path = url_parts(p[url])
    p = p.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"segs": segments(F.col("path")), "rule": rule, "by_rule": verdict})
    hidden = F.coalesce(hide, F.lit(False)) if hide is not None else F.lit(False)
    p = p.withColumn("label", F.when(~hidden, F.col("by_rule")))
    says = lambda v: (F.coalesce("label", F.lit("")) == v).cast("long")
    tree = template_tree(p.select("host", "segs", says("block").alias("blocked"), says("allow").alias("allowed")))
    judged = spread_join(tree.select("host", "segs", "template"), judge_templates(tree), ["host", "template"])
    out = spread_join(p, judged, ["host", "segs"], counts=tree.select("host", "segs", F.col("n").alias("hot_n")))
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity", "rejected")


def evaluate(pages: DataFrame, key: str = "page_id", url: str = "url", folds: int = 5) -> DataFrame:
    """One row on the urls that rules cover and whose crc32(key as text) modulo ``folds`` is 0, judged by the tree without their labels: blocked and allowed ones, and how many of each it blocks."""
    hide = F.crc32(F.encode(F.col("key").cast("string"), "UTF-8")) % folds == 0
    judged = judge(pages, key, url, hide=hide).withColumn("key", F.col(key)).where(F.col("rule").isNotNull() & hide)
    is_ = lambda v, caught: F.count_if((F.col("verdict") == v) & (F.col("rejected") | F.lit(not caught)))
    return judged.agg(is_("block", False).alias("blocked"), is_("block", True).alias("blocked_found"), is_("allow", False).alias("allowed"), is_("allow", True).alias("allowed_blocked"))
