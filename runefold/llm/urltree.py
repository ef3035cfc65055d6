"""Operator 10: URL filter by path-template trees.

For each host, path segments that look variable (numbers, hex strings, dates, long slugs) become wildcards, which
gives templates. Templates that differ in one literal segment, at any depth, are branches of one node; labelled branches
whose shares do not differ significantly from the node's pooled share are merged into a wildcard branch (of several
nodes, that of the deepest segment). A template without labels backs off to the labelled share of the deepest node that
it is a branch of, then to that of the path prefixes above it, the longest first. A host without such nodes backs off to the
domains above it (of at most ``LABELS`` labels, the longest first, at last all hosts): to the labelled share of the same
template, if it has a literal segment, among the hosts there. Only nodes with labels in at least ``BRANCHES`` branches
(segments, or subdomains) count: labels of one branch say nothing of its siblings. A template is rejected if its smoothed
labelled purity (share of "block" among its labelled URLs) is at least ``PURITY``.

Everything is counted over all rows by (host, template), with map-side partial sums, so a hot host is a few counters.

Defined results: a null URL, or one without ``://``, has an empty host and path, no template and verdict ``allow``. The longest
fitting rule wins; of two of one length, the one that comes later by name. Null keys are kept. Very long URLs are read whole.
Repeated rows count as often as they occur and give repeated rows. An empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

PURITY = 0.8
#: Unlabelled rows that the smoothing adds to each template, half of them blocked.
PRIOR = 2.0
#: Standard errors by which a branch may differ from the pooled share and still be merged.
SIMILAR = 2.0
#: Labelled branches that a node has at least, for branches to be merged or judged by it.
BRANCHES = 2
#: Labels of the longest domain over whose hosts templates are pooled.
LABELS = 3
#: Kinds of nodes, the nearest last: a path prefix, a template with a segment left open, a template over a domain.
PREFIX, OPEN, DOMAIN = 0, 1, 2
#: The level of nodes within a host, above any number of a domain's labels.
HOST = LABELS + 1


@dataclass(frozen=True)
class Rule:
    action: str  # block or allow
    name: str  # host and path, like net/

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"^(?s).*?://", ""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def matched(rules: list[Rule], host: Column, path: Column) -> Column:
    """Name of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def template(path: Column) -> Column:
    """The path with variable segments as wildcards; a file's extension stays."""
    ext = r"(\.[A-Za-z][A-Za-z0-9]{0,4})?(?=/|$)"
    out = path
    for pattern, wild in (
        (r"/[0-9]{4}-[0-9]{2}-[0-9]{2}", "/{date}"),
        (r"/[0-9]+", "/{n}"),
        (r"/(?=[0-9A-Fa-f-]*[0-9])[0-9A-Fa-f-]{8,}", "/{hex}"),
        (r"/[^/.{}]*[0-9][^/.{}]*", "/{id}"),
        (r"/[^/.{}]{24,}", "/{slug}"),
    ):
        out = F.regexp_replace(out, pattern + ext, wild + "$1")
    return out


def branches(counts: DataFrame) -> DataFrame:
    """host, __template, __n, __b, __place, __level, __kind, __at, __key, __branch: each node that a template is a branch of.

    Nodes within the host are the template with its literal segment ``__at`` left open and the prefixes of ``__at``
    segments; above the host, the template in each domain. Keys are digests, so that a path of many segments stays small.
    """
    rest = "array_join(slice(__s, i + 2, size(__s)), '/')"
    start = "array_join(slice(__s, 1, i), '/')"
    within = f"host as place, {HOST} as level"
    opened = f"struct({within}, {OPEN} as kind, i as at, md5(concat('w', i, '/', size(__s), '/', {start}, '/{{*}}/', {rest})) as key, __s[i] as branch)"
    above = f"struct({within}, {PREFIX} as kind, i as at, md5(concat('p', i, '/', {start})) as key, __s[i] as branch)"
    every = "sequence(0, size(__s) - 1)"
    literal = f"filter({every}, i -> __s[i] <> '' and __s[i] not like '{{%')"
    domain = "array_join(slice(__l, size(__l) - k + 1, k), '.') as place, k as level"
    child = "if(k < size(__l), __l[size(__l) - 1 - k], '') as branch"
    pooled = f"transform(sequence(0, least({LABELS}, size(__l))), k -> struct({domain}, {DOMAIN} as kind, 0 as at, md5(concat('t', __template)) as key, {child}))"
    found = counts.withColumns({"__s": F.split(F.expr("substr(__template, 2)"), "/"), "__l": F.split("host", "[.]")})
    found = found.withColumn("e", F.explode(F.expr(f"concat(transform({literal}, i -> {opened}), transform({every}, i -> {above}), if(size({literal}) > 0, {pooled}, array()))")))
    return found.select("host", "__template", "__n", "__b", *[F.col(f"e.{c}").alias(f"__{c}") for c in ("place", "level", "kind", "at", "key", "branch")])


def node_name() -> Column:
    """The node ``node`` of ``__template`` as text."""
    s = "split(substr(__template, 2), '/')"
    start = f"concat('/', array_join(concat(slice({s}, 1, node.at), array('{{*}}')), '/'))"
    rest = f"transform(slice({s}, node.at + 2, size({s})), x -> concat('/', x))"
    domain = "concat(if(node.place = '', '*', concat('*.', node.place)), __template)"
    return F.expr(f"case node.kind when {DOMAIN} then {domain} when {OPEN} then concat({start}, array_join({rest}, '')) else concat({start}, '*') end")


def judge(df: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", label: str | None = None) -> DataFrame:
    """key, host, path, rule, verdict, template, purity of every row.

    Labelled URLs are those that ``label`` (a column with ``block`` or ``allow``) labels; without it, those a rule
    decides.
    """
    known = F.col(f"`{label}`") if label else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias("__url"), known.alias("__label"))
    host, path = parse(F.col("__url"))
    rows = rows.select(key, "__label", host.alias("host"), path.alias("path"))
    action = F.lit(None).cast("string")
    for rule in rules:
        action = F.when(F.col("rule") == rule.name, F.lit(rule.action)).otherwise(action)
    rows = rows.withColumn("rule", matched(rules, F.col("host"), F.col("path"))).withColumn("__action", action)
    rows = rows.withColumn("__template", template(F.col("path")))
    labelled = F.coalesce("__label", "__action") if label is None else F.col("__label")
    counts = rows.where(F.col("host") != "").groupBy("host", "__template").agg(
        F.count(labelled).alias("__n"), F.sum(F.when(labelled == "block", 1).otherwise(0)).alias("__b")
    )
    counts = stored(counts, "templates")
    tree = branches(counts)
    at = ["__place", "__level", "__key"]
    known = tree.where("__n > 0").groupBy(*at, "__branch", "__kind").agg(F.sum("__n").alias("__n"), F.sum("__b").alias("__b"))
    nodes = known.groupBy(*at).agg(F.sum("__n").alias("__nn"), F.sum("__b").alias("__nb"), F.count(F.lit(1)).alias("__branches"))
    nodes = nodes.where(F.col("__branches") >= BRANCHES)
    pooled = F.col("__nb") / F.col("__nn")
    error = F.sqrt(pooled * (1 - pooled) / F.greatest("__n", F.lit(1)))
    similar = (F.col("__n") > 0) & (F.abs(F.col("__b") / F.greatest("__n", F.lit(1)) - pooled) <= SIMILAR * error + 1e-9)
    # merged branches share one purity: that of all branches that are alike
    alike = known.where(F.col("__kind") == OPEN).join(nodes, at).where(similar).groupBy(*at)
    alike = alike.agg(F.sum("__n").alias("__an"), F.sum("__b").alias("__ab"), F.count(F.lit(1)).alias("__alike")).where(F.col("__alike") >= BRANCHES)
    nodes = stored(nodes.join(alike, at, "left"), "nodes")
    merged = (F.col("__kind") == OPEN) & F.col("__alike").isNotNull() & similar
    share = F.when(F.col("__n") > 0, F.struct(F.col("__an").alias("n"), F.col("__ab").alias("b"))).otherwise(F.struct(F.col("__nn").alias("n"), F.col("__nb").alias("b")))
    asking = tree.where((F.col("__n") == 0) | (F.col("__kind") == OPEN))
    judged = spread_join(asking, nodes, at).where((F.col("__n") == 0) | merged)
    named = F.struct(*[F.col(f"__{c}").alias(c) for c in ("level", "kind", "at", "place")], share.alias("share"))
    judged = judged.groupBy("host", "__template").agg(F.max(named).alias("node"))
    tree = counts.join(judged, ["host", "__template"], "left")
    n, b = F.coalesce("node.share.n", "__n"), F.coalesce("node.share.b", "__b")
    purity = (b + PRIOR / 2) / (n + PRIOR)
    name = F.when(F.col("node").isNull(), F.col("__template")).otherwise(node_name())
    tree = stored(tree.select("host", "__template", name.alias("template"), purity.alias("purity")), "purities")
    out = spread_join(rows, tree, ["host", "__template"], "left")
    rejected = F.coalesce(F.col("purity") >= PURITY, F.lit(False))
    verdict = F.coalesce(F.col("__action"), F.when(rejected, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
