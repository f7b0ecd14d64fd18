"""URL filter by a path-template tree, in DataFrame functions only.

Urls are counted by host and generalised path segments before anything else, so later steps see
distinct paths.  Level by level, each host's tree is built from the root:

* a segment with a digit in it becomes a wildcard of its shape, ``{n}``, ``{hex}`` or ``{mixed}``;
* the literal segments below a node become one wildcard ``*`` if they are too many to be fixed names;
* a literal branch whose labelled rate is compatible with that of its siblings together (Hoeffding
  bounds overlap) is merged with them into ``{same}``.

A template is judged by its smoothed labelled purity: the share of blocked urls below it, drawn
towards its parent's, the root towards that of the last two labels of the host, and those towards the
rate over all urls.  Explicit rules label the urls they fit and always decide them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueforge.llm.stages import stage

DEPTH = 4  # levels; what follows is part of the last segment
MOST_NAMES = 30  # literal segments below a node, beyond which they are values
SMOOTHING = 4.0
THRESHOLD = 0.5
CONFIDENCE = 0.05
SALTS = 64


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    rule: str  # host/path

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (
    Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def split_url(url: str = "url") -> tuple[Column, Column]:
    """(host, path): host up to / ? # or end, A-Z lower-cased; path up to ? or #.  Both empty without ://."""
    rest = F.expr(f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path; null if none does.

    Rules are configuration: they are written into the expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):  # later ones are asked first
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def segments(depth: int = DEPTH) -> Column:
    """The path's segments with those that hold digits replaced by their shape; the last holds the tail."""
    shape = (
        "case when x rlike '^[0-9]+$' then '{n}' when x rlike '^[0-9]+[.][A-Za-z0-9]+$' then '{n}.*' "
        "when length(x) >= 8 and x rlike '^[0-9A-Fa-f-]+$' then '{hex}' when x rlike '[0-9]' then '{mixed}' else x end"
    )
    parts = "split(trim(BOTH '/' FROM path), '/+', -1)"
    tail = f"if(size({parts}) > {depth}, array_append(slice({parts}, 1, {depth - 1}), array_join(slice({parts}, {depth}, size({parts})), '/')), {parts})"
    return F.expr(f"transform({tail}, x -> {shape})")


def _hot_join(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Joins one row per key to many rows; a hot key's rows are spread by salt, its row is copied to each salt."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    used = salted.select(*keys, "_salt").distinct()
    copies = used.join(per_key, keys)
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def _radius(n: Column, confidence: float) -> Column:
    """Half-width of the Hoeffding bound of a rate over n trials."""
    return F.sqrt(F.log(F.lit(2.0 / confidence)) / (2 * n))


def build_templates(counted: DataFrame, depth: int, most_names: int, confidence: float) -> DataFrame:
    """Adds ``t``, the template's segments, to rows (host, s, n, good, bad) of distinct generalised paths."""
    rows = counted.withColumn("t", F.expr("cast(array() as array<string>)"))
    for level in range(depth):
        here = rows.withColumn("seg", F.get("s", F.lit(level)))
        deeper = here.filter("seg is not null").drop("s")
        branch = deeper.groupBy("host", "t", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
        node = branch.groupBy("host", "t").agg(
            F.sum("good").alias("node_good"), F.sum("bad").alias("node_bad"), F.count_if(~F.startswith("seg", F.lit("{"))).alias("names")
        )
        marked = _hot_join(branch, node, ["host", "t"])
        literal = ~F.startswith("seg", F.lit("{"))
        own, rest = F.col("good") + F.col("bad"), F.col("node_good") + F.col("node_bad") - F.col("good") - F.col("bad")
        gap = F.abs(F.col("bad") / own - (F.col("node_bad") - F.col("bad")) / F.nullif(rest, F.lit(0)))
        alike = F.coalesce(gap <= _radius(own, confidence) + _radius(rest, confidence), F.lit(False))
        name = F.when(literal & (F.col("names") > most_names), F.lit("*"))
        name = F.when((own > 0) & literal & (F.col("names") <= most_names) & alike, F.lit("{same}")).otherwise(name)
        named = marked.select("host", "t", "seg", F.coalesce(name, "seg").alias("name"))
        joined = _hot_join(here, named, ["host", "t", "seg"])
        rows = joined.withColumn("t", F.when(F.col("name").isNull(), F.col("t")).otherwise(F.array_append("t", F.col("name")))).drop("seg", "name")
        rows = stage(rows, f"templates-{level}")
    return rows


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    labels: DataFrame | None = None,
    depth: int = DEPTH,
    most_names: int = MOST_NAMES,
    smoothing: float = SMOOTHING,
    threshold: float = THRESHOLD,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, badness) of every row of (page_id, url).

    Training labels are the verdicts of the rules on the urls they fit, and the rows of ``labels``
    (host, path, good, bad counts) if given.  Urls that no rule fits are blocked if their
    template's smoothed share of blocked labels exceeds ``threshold``.  Null urls and those without
    ``://`` have empty host and path and are judged as such.  Repeated rows each keep a row; null
    ids are kept; further columns are ignored.
    """
    host, path = split_url()
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(rules))
    urls = urls.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("by_rule"), segments(depth).alias("s"))
    urls = stage(urls, "urls")
    flag = lambda v: F.count_if(F.col("by_rule") == v)
    counted = urls.groupBy("host", "s").agg(F.count("*").alias("n"), flag("allow").alias("good"), flag("block").alias("bad"))
    if labels is not None:
        extra = labels.select("host", segments(depth).alias("s"), F.lit(0).cast("bigint").alias("n"), "good", "bad")
        both = counted.unionByName(extra)
        counted = both.groupBy("host", "s").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    rows = build_templates(counted, depth, most_names, confidence)

    # labels below every node: each path counts for all its prefixes
    prefixes = rows.select("host", "good", "bad", F.explode(F.expr("transform(sequence(0, size(t)), i -> slice(t, 1, i))")).alias("node"))
    nodes = prefixes.groupBy("host", "node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    total = rows.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (total[1] + smoothing / 2) / (total[0] + total[1] + smoothing)
    site = F.substring_index("host", ".", -2)
    sites = rows.groupBy(site.alias("site")).agg(F.sum("good").alias("site_good"), F.sum("bad").alias("site_bad"))
    drawn = lambda good, bad, prior: (F.col(bad) + smoothing * prior) / (F.col(good) + F.col(bad) + smoothing)
    templates = rows.select("host", "t").distinct()
    chain = templates.select("host", "t", F.posexplode(F.expr("transform(sequence(0, size(t)), i -> slice(t, 1, i))")).alias("level", "node"))
    counts = _hot_join(chain, nodes, ["host", "node"]).groupBy("host", "t").agg(
        F.sort_array(F.collect_list(F.struct("level", "good", "bad"))).alias("levels")  # depth + 1 rows
    )
    placed = _hot_join(counts.withColumn("site", site), sites, ["site"])
    start = drawn("site_good", "site_bad", F.lit(float(overall)))
    badness = F.aggregate("levels", start, lambda p, x: (x["bad"] + smoothing * p) / (x["good"] + x["bad"] + smoothing))
    judged = placed.select("host", "t", badness.alias("badness"))
    by_path = _hot_join(rows.select("host", "s", "t"), judged, ["host", "t"])
    out = _hot_join(urls, by_path, ["host", "s"])
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("badness") > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"),
        "badness",
    )
