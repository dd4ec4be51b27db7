"""URL filter by rules and a tree of path templates per host.

Path segments of a host that vary become wildcards, branches whose labelled rates cannot be
told apart are merged, and a template is rejected when the smoothed share of bad labelled
pages is high. Rules decide first. Column expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import stage

#: (verdict, host and path): a rule fits its host and all subdomains where the path starts alike.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """A segment stays literal when it holds at least `min_support` pages at its place (below the
    same parent segment), whatever the size of its host. Branches are merged when their bad
    rates differ by less than `max_z` standard errors. `prior` labelled pages at the parent's
    rate smooth a rate."""

    min_support: int = 3
    max_z: float = 1.96
    prior: float = 10.0
    min_purity: float = 0.5


def host_column(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; "" without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _SMALL)


def path_column(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    parts = [(v, r, r[: r.index("/")], r[r.index("/") :]) for v, r in rules]
    for v, r, rule_host, rule_path in sorted(parts, key=lambda x: (len(x[1]), len(x[2]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, r).otherwise(rule)
        verdict = F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape_column(path: Column) -> Column:
    """Path whose numbers and long hexadecimal names are placeholders."""
    hexed = F.regexp_replace(path, "(?<=/)[0-9a-fA-F-]{12,}(?=[./]|$)", "{x}")
    return F.regexp_replace(hexed, "[0-9]+", "{n}")


def templates(counted: DataFrame, s: Settings) -> DataFrame:
    """(host, shape, template) from counted shapes (host, shape, n): variable segments as `*`."""
    # slash-separated segments with their place and the segment before them
    segments = F.split("shape", "/")
    places = counted.select("host", "shape", "n", F.posexplode(segments).alias("at", "segment"))
    places = places.withColumn("before", F.when(F.col("at") > 0, F.get(F.split("shape", "/"), F.col("at") - 1)).otherwise(""))
    own = places.groupBy("host", "at", "before", "segment").agg(F.sum("n").alias("n"))
    literal = own.where(F.col("n") >= s.min_support)
    named = places.drop("n").join(literal.select("host", "at", "before", "segment", F.lit(True).alias("kept")), ["host", "at", "before", "segment"], "left")
    name = F.when(F.col("kept") | (F.col("segment") == ""), F.col("segment")).otherwise("*")
    whole = named.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("at", name.alias("name")))).alias("parts"))
    return whole.select("host", "shape", F.array_join(F.col("parts.name"), "/").alias("template"))


def merge_similar(stats: DataFrame, s: Settings) -> DataFrame:
    """(host, template, merged): templates that share a wider one join it when their bad rates
    are within `max_z` standard errors of the rate of the wider template's other pages.

    A wider template has one literal segment (one without placeholder or wildcard) as `*`; of
    several to join, the one of most branches is taken, then the one nearest to the root.
    """
    segments = F.split("template", "/")
    spots = F.filter(F.transform(segments, lambda x, i: F.when((x != "") & ~x.rlike("[{*]"), i)), lambda i: i.isNotNull())
    wide = stats.withColumn("spot", F.explode(spots))
    wide = wide.withColumn("wider", F.array_join(F.transform(segments, lambda x, i: F.when(i == F.col("spot"), "*").otherwise(x)), "/"))
    sums = wide.groupBy("host", "wider").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("k"))
    both = wide.join(sums.where("k > 1"), ["host", "wider"])
    l1, b1 = F.col("labelled"), F.col("bad")
    l2, b2 = F.col("l") - l1, F.col("b") - b1
    pooled = F.try_divide("b", "l")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), l1) + F.try_divide(F.lit(1), l2)))
    gap = F.try_divide(F.abs(F.try_divide(b1, l1) - F.try_divide(b2, l2)), error)
    # null where a side has no label or all labels agree: nothing sets the branches apart
    alike = both.where(F.coalesce(gap, F.lit(0.0)) < s.max_z)
    best = alike.groupBy("host", "template").agg(F.max(F.struct("k", F.negative("spot").alias("near"), "wider")).alias("m"))
    return stats.join(best, ["host", "template"], "left").select("host", "template", F.coalesce("m.wider", "template").alias("merged"))


def template_purity(stats: DataFrame, s: Settings) -> DataFrame:
    """(host, template, purity): share of bad labelled pages, smoothed to the host's, and that to all."""
    hosts = stats.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    total = stats.agg(F.sum("labelled"), F.sum("bad")).first()
    base = float((total[1] or 0) + 1) / float((total[0] or 0) + 10)  # one in ten before any label
    rate = (F.col("hb") + s.prior * base) / (F.col("hl") + s.prior)
    purity = (F.col("bad") + s.prior * rate) / (F.col("labelled") + s.prior)
    return stats.join(hosts, "host").select("host", "template", purity.alias("purity"))


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, settings: Settings | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of `pages` (page_id, url).

    labels (page_id, bad): labelled pages; `bad` true or false. Rows with a null are left out,
    a page labelled several times is bad if one label says so. A null url, or one without
    `://`, has an empty host and path and is judged like other pages of that host. A null
    page_id has no label. Repeated rows count as pages; other columns are not read. Without
    labels every template has the same purity and none is rejected. Empty tables give none.
    """
    s = settings or Settings()
    url = F.col("url")
    rows = pages.select("page_id", host_column(url).alias("host"), path_column(url).alias("path"))
    rows = rows.withColumn("shape", shape_column(F.col("path")))
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = rows.join(known, "page_id", "left")
    counted = seen.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    counted = stage(counted, "shapes")
    named = stage(counted.join(templates(counted, s), ["host", "shape"]), "templates")
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    stats = named.groupBy("host", "template").agg(*sums)
    merged = stage(named.join(merge_similar(stats, s), ["host", "template"]), "merged").drop("template").withColumnRenamed("merged", "template")
    judged = merged.join(template_purity(merged.groupBy("host", "template").agg(*sums), s), ["host", "template"])
    judged = stage(judged.select("host", "shape", "template", "purity"), "judged")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") >= s.min_purity, "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity"
    )
