"""URL filters: a tree of path templates per host.

A path segment that varies (numbers, long identifiers, or many different words in one
place) becomes a wildcard. Branches of one node whose labelled share of bad pages does
not differ significantly from their siblings' are merged into a wildcard as well. A
template is rejected by its labelled purity, smoothed towards its host and all hosts.

Everything happens on counts per (host, shape of the path), which map-side aggregation
leaves of any number of pages; pages meet their template in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

# The rules of the registered query, as (verdict, rule).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
DEPTH = 6
WIDTH = 16
SIGNIFICANT = 1.96
SMOOTHING = 8.0
REJECT_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    host, path = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # later and longer ones win
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def path_shape(path: Column) -> Column:
    """DEPTH segments with numbers and long identifiers as wildcards; the rest as ``**``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    number = F.transform(parts, lambda x: F.regexp_replace(x, r"^\d+(\.\w+)?$", "{n}$1"))
    shape = F.transform(number, lambda x: F.when((F.length(x) >= 24) | x.rlike(r"^[0-9a-fA-F-]{12,}$"), F.lit("{id}")).otherwise(x))
    return F.when(F.size(shape) > DEPTH, F.concat(F.slice(shape, 1, DEPTH), F.array(F.lit("**")))).otherwise(shape)


def _share(bad: str, seen: str, prior: Column) -> Column:
    return (F.col(bad) + SMOOTHING * prior) / (F.col(seen) + SMOOTHING)


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape) -> template, labelled, purity of ``shapes`` (host, shape, pages, seen, bad)."""
    rows = shapes.withColumn("template", F.lit(""))
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    for depth in range(1, deepest + 1):
        here = rows.withColumn("part", F.get("shape", F.lit(depth - 1)))
        nodes = here.filter("part is not null").groupBy("host", "template", "part").agg(
            F.sum("pages").alias("pages"), F.sum("seen").alias("own_seen"), F.sum("bad").alias("own_bad")
        )
        level = nodes.groupBy("host", "template").agg(
            F.count("*").alias("branches"), F.sum("own_seen").alias("all_seen"), F.sum("own_bad").alias("all_bad")
        )
        # Two-proportion z test of a branch against its siblings; no label is no evidence.
        rest_seen, rest_bad = F.col("all_seen") - F.col("own_seen"), F.col("all_bad") - F.col("own_bad")
        pooled = (F.col("all_bad") + 0.5) / (F.col("all_seen") + 1)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("own_seen") + 1 / rest_seen))
        z = F.when((F.col("own_seen") > 0) & (rest_seen > 0), F.abs(F.col("own_bad") / F.col("own_seen") - rest_bad / rest_seen) / spread)
        own = (F.col("branches") == 1) | (F.coalesce(z, F.lit(0.0)) >= SIGNIFICANT)
        branch = nodes.join(level, ["host", "template"]).select(
            "host",
            "template",
            "part",
            F.when(own & ((F.col("branches") <= WIDTH) | (F.col("own_seen") >= SMOOTHING)), F.col("part")).otherwise("*").alias("kept_part"),
        )
        rows = here.join(branch, ["host", "template", "part"], "left").withColumn(
            "template", F.when(F.col("kept_part").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "kept_part"))
        )
        rows = materialize(rows.select("host", "shape", "pages", "seen", "bad", "template"), "level")
    overall = rows.agg(((F.sum("bad") + 0.5) / (F.sum("seen") + 1)).alias("prior"))  # one row
    hosts = rows.groupBy("host").agg(F.sum("seen").alias("h_seen"), F.sum("bad").alias("h_bad"))
    hosts = hosts.crossJoin(F.broadcast(overall)).select("host", _share("h_bad", "h_seen", F.col("prior")).alias("host_share"))
    found = rows.groupBy("host", "template").agg(F.sum("seen").alias("labelled"), F.sum("bad").alias("t_bad"))
    found = found.join(hosts, "host").select(
        "host", "template", "labelled", (1 - _share("t_bad", "labelled", F.col("host_share"))).alias("purity")
    )
    return rows.select("host", "shape", "template").join(found, ["host", "template"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, labelled, purity for every row of ``pages``.

    ``pages`` has page_id and url; further columns are ignored. ``labels`` is (page_id,
    bad 0 or 1), one row per page at most; without it the pages that a rule decides are
    the labelled ones. A rule's verdict goes first; else a template whose smoothed share
    of good pages is below a half is blocked. Without any label all else is allowed.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said).withColumn("shape", path_shape(F.col("path")))
    if labels is None:
        rows = rows.withColumn("bad", F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("long")))
    else:
        rows = rows.join(labels.select("page_id", F.col("bad").cast("long").alias("bad")), "page_id", "left")
    shapes = materialize(
        rows.groupBy("host", "shape").agg(
            F.count("*").alias("pages"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
        ),
        "shapes",
    )
    known = rows.drop("bad").join(templates(shapes), ["host", "shape"])
    return known.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when((F.col("labelled") > 0) & (F.col("purity") < REJECT_AT), "block").otherwise("allow")).alias("verdict"),
        "template",
        "labelled",
        F.round("purity", 6).alias("purity"),
    )
