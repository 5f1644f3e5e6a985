"""URL filters: explicit host and path rules, then a tree of path templates judged by labelled purity.

Per host, path segments that vary are generalised into ``*``: by their shape (digits, long hexadecimal, long text) and by statistics (more
than ``max_children`` siblings, or a share under ``min_share`` of them). The tree goes as deep as the paths; stretches that all paths of a branch share are
passed in one round. Sibling branches of ``TOLD`` labels or more whose rates do not differ
significantly from their pooled rate are merged and share their figures.

Labels are given as a column, or come from the rules' own verdicts. Rules say what is bad on two paths, not that the rest of a host is, so a url that no
rule fits is a weak negative then: ``weak`` of a label. A template's purity (the share of blocked labels) is smoothed along its way down the tree: from the
host's domain over its sibling hosts, to the host, to each branch, every node pulls the estimate towards its own labels, and all that lies above counts as
``STRENGTH`` labels, so a path's own labels come first and one with few takes the purity of its nearest ancestors. It is rejected if that
reaches ``threshold`` and some node on the way has ``min_labels`` labels. Every step is a grouped count, so a host with a third of all rows is summed before it is shuffled.
DataFrame functions only.

Defined cases: a null url or one without ``://`` has an empty host and path and matches no rule; repeated rows are each judged alike; without
labels everything unmatched is allowed; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import ascii_lower, stored, table
from tracefold.llm.conversation_trie import common_prefix

# Fixed values, the given rules: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
VARIABLE = r"^(?:.*[0-9].*|[0-9a-fA-F-]{12,}|.{40,})$"
#: Weight of what lies above a node, in labels; the purity without any label; the significance bound of merging.
STRENGTH, PRIOR, Z = 1.0, 0.5, 1.96
#: Labels from which on a branch can be told to be like its siblings.
TOLD = 5
#: The label, in parts of one, that a url without a rule is: a negative.
WEAK = 0.25
#: Marks of a domain's node, and of what lies above a host's root.
DOMAIN, ABOVE = "domain:", "^"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (``host`` + ``path`` as text) and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def path_templates(paths: DataFrame, max_children: int = 32, min_share: float = 0.01) -> DataFrame:
    """Distinct paths (``host, path, n, labelled, blocked``) with their ``template``, an array of segments.

    A round passes, in every branch at once, the segments that all of its paths share (an only child is kept) and then decides about one segment where they part.
    """
    parts = F.array_remove(F.split("path", "/"), "")
    shaped = F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))
    df = paths.withColumn("segments", shaped).withColumn("template", F.array().cast("array<string>"))
    at, many, done = F.size("template"), F.size("segments"), None
    while True:
        rest = F.slice("segments", at + 1, F.greatest(many - at, F.lit(0)))
        spans = df.groupBy("host", "template").agg(F.min(rest).alias("first"), F.max(rest).alias("last"))
        spans = stored(spans.select("host", "template", common_prefix(F.col("first"), F.col("last")).cast("int").alias("shared")), "url-shared")
        df = stored(df.join(spans, ["host", "template"]).withColumn("template", F.concat("template", F.slice("segments", at + 1, F.col("shared")))).drop("shared"), "url-paths")
        # paths that end here are finished; only deeper ones go on
        ended = df.where(at >= many).drop("segments")
        done = ended if done is None else done.unionByName(ended)
        df = df.where(at < many).withColumn("seg", F.get("segments", at))
        if df.isEmpty():
            return done
        counts = df.where(F.col("seg") != "*").groupBy("host", "template", "seg").agg(F.sum("n").alias("seg_n"))
        sums = counts.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("seg_n").alias("all_n"))
        often = (F.col("children") <= max_children) & (F.col("seg_n") >= min_share * F.col("all_n"))
        kept = counts.join(sums, ["host", "template"]).where(often).select("host", "template", "seg", F.lit(True).alias("keep"))
        # a table of its own, so that Spark can split the paths of one branch
        df = df.join(stored(kept, "url-kept"), ["host", "template", "seg"], "left")
        df = stored(df.withColumn("template", F.concat("template", F.array(F.when(F.col("keep"), F.col("seg")).otherwise("*")))).drop("keep", "seg"), "url-paths")


def _name(segments: Column) -> Column:
    return F.concat_ws("", F.transform(segments, lambda s: F.concat(F.lit("/"), s)))


def _domain(host: Column) -> Column:
    """The host's last two labels, which sibling hosts share."""
    return F.concat(F.lit(DOMAIN), F.array_join(F.slice(F.reverse(F.split(host, r"\.")), 1, 2), "."))


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """``owner, node, labelled, blocked``: the figures of every branch of the tree, similar labelled siblings sharing theirs.

    Nodes are a domain's, over all its hosts (``owner`` is the domain), a host's root and all prefixes of its templates.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.size("template")), lambda i: F.struct(_name(F.slice("template", 1, i)).alias("node"), F.when(i > 0, _name(F.slice("template", 1, i - 1))).otherwise(ABOVE).alias("parent")))
    rows = leaves.where("labelled > 0").select("host", "labelled", "blocked", F.explode(prefixes).alias("p"))
    nodes = rows.groupBy("host", "p.node", "p.parent").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    pooled = nodes.where(F.col("parent") != ABOVE).groupBy("host", "parent").agg(F.sum("labelled").alias("pool_n"), F.sum("blocked").alias("pool_b"))
    rate = (F.col("pool_b") + 0.5) / (F.col("pool_n") + 1.0)
    similar = (F.col("labelled") >= TOLD) & (F.abs(F.col("blocked") / F.col("labelled") - rate) <= Z * F.sqrt(rate * (1 - rate) / F.col("labelled")))
    marked = nodes.join(pooled, ["host", "parent"], "left").withColumn("branch", F.when(F.coalesce(similar, F.lit(False)), "~").otherwise(F.col("node")))
    branches = marked.groupBy("host", "parent", "branch").agg(F.sum("labelled").alias("b_labelled"), F.sum("blocked").alias("b_blocked"))
    figures = [F.col("b_labelled").alias("labelled"), F.col("b_blocked").alias("blocked")]
    own = marked.select("host", "parent", "branch", "node").join(branches, ["host", "parent", "branch"]).select(F.col("host").alias("owner"), "node", *figures)
    domains = nodes.where("node = ''").groupBy(_domain(F.col("host")).alias("owner")).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    return own.unionByName(domains.select("owner", F.lit("").alias("node"), "labelled", "blocked"))


def template_purity(templates: DataFrame, min_labels: int) -> DataFrame:
    """``host, template, labelled, evidence, purity`` for each template: its own labels, the most labels of a node on its way, and its smoothed purity."""
    leaves = stored(templates.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "url-templates")
    nodes = stored(tree_nodes(leaves), "url-nodes")
    way = F.concat(
        F.array(F.struct(_domain(F.col("host")).alias("owner"), F.lit("").alias("node"), F.lit(-1).alias("at"))),
        F.transform(F.sequence(F.lit(0), F.size("template")), lambda i: F.struct(F.col("host").alias("owner"), _name(F.slice("template", 1, i)).alias("node"), i.alias("at"))),
    )
    steps = leaves.select("host", "template", F.col("labelled").alias("own"), F.explode(way).alias("w")).select("host", "template", "own", "w.*")
    met = steps.join(nodes, ["owner", "node"], "left").groupBy("host", "template", "own").agg(
        F.array_sort(F.collect_list(F.when(F.col("labelled") > 0, F.struct("at", "labelled", "blocked")))).alias("chain"))
    down = F.aggregate("chain", F.lit(PRIOR), lambda p, s: (s["blocked"] + STRENGTH * p) / (s["labelled"] + STRENGTH))
    evidence = F.coalesce(F.array_max(F.transform("chain", lambda s: s["labelled"])), F.lit(0))
    return met.select("host", "template", F.col("own").alias("labelled"), evidence.alias("evidence"), down.alias("purity"))


def filter_urls(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", rules=RULES, label_col: str | None = None, threshold: float = 0.75, min_labels: int = 5, weak: float | None = None) -> DataFrame:
    """Per row: ``host, path, rule, verdict, template, labelled, evidence, purity``. ``label_col``: true for blocked; null, unlabelled.

    ``weak``: the part of a negative label that a row without one stands for; by default ``WEAK`` for the rules' labels, none beside given ones.
    """
    host, path = split_url(F.col(url_col))
    label = F.col(label_col).cast("boolean") if label_col else F.lit(None).cast("boolean")
    rows = pages.select(F.col(key_col), host.alias("host"), path.alias("path"), label.alias("label"))
    name, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": ruled})
    label = F.col("label") if label_col else F.col("ruled") == "block"
    weak = (0.0 if label_col else WEAK) if weak is None else weak
    labelled = F.count(label) + weak * F.count_if(label.isNull())
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), labelled.cast("double").alias("labelled"), F.count_if(label).cast("double").alias("blocked"))
    tree = path_templates(paths)
    purity = template_purity(tree, min_labels)
    judged = stored(tree.select("host", "path", "template").join(purity, ["host", "template"]).withColumn("template", _name(F.col("template"))), "url-judged")
    out = rows.join(judged, ["host", "path"], "left")
    reject = (F.col("evidence") >= min_labels) & (F.col("purity") >= threshold)
    verdict = F.coalesce("ruled", F.when(reject, "block").otherwise("allow"))
    return out.select(key_col, "host", "path", "rule", verdict.alias("verdict"), "template", "labelled", "evidence", F.round("purity", 9).alias("purity"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say, which has SQL: ``page_id, host, path, rule, ruled``."""
    return op10_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES = {"op10_url_filter": op10_url_filter, "url_rules": url_rules}
_FITTING = "\n UNION ALL ".join(
    f"SELECT u, '{h}{p}' AS rule, '{v}' AS ruled FROM s WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in RULES
)
SQL = {
    "url_rules": rf"""
WITH d AS (SELECT DISTINCT url AS u FROM pages),
r AS (SELECT u, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM d),
s AS (SELECT u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS ({_FITTING}),
b AS (SELECT u, arg_max(rule, len(rule)) AS rule, arg_max(ruled, len(rule)) AS ruled FROM f GROUP BY u)
SELECT page_id, host, path, rule, ruled FROM pages JOIN s ON s.u IS NOT DISTINCT FROM pages.url LEFT JOIN b ON b.u = s.u
""",
}
