"""URL filter: rules first, then a tree of path templates judged by labelled purity.

Rules give labels: the addresses that they fit are allowed or blocked, and are
the labelled sample for the others.  Per host, paths make a tree of segments,
walked from the root by tables:

1. *Generalise.*  A segment that looks variable (digits, hexadecimal, long or
   with many digits) is a wildcard of its kind.  A branch with many children
   that rarely repeat has all of them made one wildcard.
2. *Merge.*  Of the branches left below one parent, those whose share of blocked
   labels does not differ significantly from that of all of them together (z
   test on labelled rows) are merged into one.  A branch without labels differs
   from nothing, so it is one of them.
3. *Judge.*  A template, the sequence of generalised segments, is rejected if
   its share of blocked among its labelled rows reaches the threshold.  The share is
   smoothed towards that of the node above, and so on up the path, then towards
   the host's, the domain's (its last two names) and that of all labelled rows: few
   labels, or none, leave a template with what is known of its neighbourhood.

Shares are whole numbers of a billion parts, rounded down at every step.

After the first aggregation every table has one row per host and shape of path,
not per address, and counts are added up in each task before any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import LOWER, UPPER, stored


#: Parts of a whole that shares are counted in.
WHOLE = 1_000_000_000


@dataclass(frozen=True)
class TemplateRule:
    """Depth of the tree, and the numbers of its tests.

    Segments beyond ``depth`` are one tail.  Children of a node become one
    wildcard if there are more than ``children`` and fewer than
    ``rows_per_child`` rows for each.  ``deviations`` is the z value from which
    branches differ, ``strength`` the pseudo-rows of each step of smoothing.
    """

    depth: int = 4
    children: int = 20
    rows_per_child: int = 5
    deviations: int = 3
    strength: int = 10
    threshold_percent: int = 50


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    after = F.substring_index(_after(url), "/", 1)
    plain = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.translate(plain, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    after = _after(url)
    plain = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.substr(plain, F.char_length(F.substring_index(plain, "/", 1)) + 1)


def _after(url: Column) -> Column:
    filled = F.coalesce(url, F.lit(""))
    at = F.locate("://", filled)
    return F.when(at > 0, F.substr(filled, at + 3)).otherwise("")


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest (verdict, host, path) that fits, or null.

    A rule fits its host and all subdomains, and paths that begin with its own.
    Longest is by the rule's text; of equals the first in the alphabet counts.
    The rules are a literal list.
    """
    choice = None
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    for verdict, own, start in ordered:
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        value = F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, value) if choice is None else choice.when(fits, value)
    return choice if choice is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _segment(text: Column) -> Column:
    """A segment, or the wildcard of its kind where it looks variable."""
    digits = F.char_length(F.regexp_replace(text, "[^0-9]", ""))
    ending = F.regexp_extract(text, r"\.[A-Za-z]{2,5}$", 0)
    stem = F.substr(text, F.lit(1), F.char_length(text) - F.char_length(ending))
    return (
        F.when(stem.rlike("^[0-9]+$"), F.concat(F.lit("{number}"), ending))
        .when(stem.rlike("^[0-9A-Fa-f-]{8,}$") & (digits > 0), F.concat(F.lit("{hex}"), ending))
        .when((F.char_length(stem) > 32) | (digits >= 4), F.concat(F.lit("{mixed}"), ending))
        .otherwise(text)
    )


def shape_of(path: Column, rule: TemplateRule) -> Column:
    """The path's segments up to the depth, variable ones as wildcards, and a mark of a tail."""
    pieces = F.filter(F.split(path, "/"), lambda s: s != "")
    head = F.transform(F.slice(pieces, 1, rule.depth), _segment)
    tail = F.when(F.size(pieces) > rule.depth, "/{tail}").otherwise("")
    return F.concat(F.array_join(head, "/"), tail)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]


def _smoothed(towards: Column, rule: TemplateRule) -> Column:
    """The share of blocked among labelled rows, with so many pseudo-rows of the share above."""
    blocked = F.col("blocked").cast("decimal(18,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    above = towards.cast("decimal(10,0)") * F.lit(rule.strength).cast("decimal(9,0)")
    rows = F.col("labelled") + F.lit(rule.strength)
    return F.floor((blocked + above) / rows.cast("decimal(18,0)")).cast("bigint")


def _level(shapes: DataFrame, at: int, rule: TemplateRule) -> DataFrame:
    """``shapes`` with the segment at ``at`` added to ``template`` in its generalised form."""
    segment = F.get(F.split("shape", "/"), F.lit(at))
    here = shapes.withColumn("segment", F.when(segment != "", segment))
    nodes = stored(
        here.filter("segment IS NOT NULL").groupBy("host", "template", "share", "segment").agg(
            *_sums()), "template-nodes",
    )
    parents = stored(
        nodes.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"),
            F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"),
        ), "template-parents",
    )
    b, m, every_b, every_m = (
        F.col(c).cast("double") for c in ("blocked", "labelled", "all_blocked", "all_labelled")
    )
    # z test of a branch's share b / m against B / M of all branches, without division.
    off = b * every_m - every_b * m
    alike = off * off <= rule.deviations**2 * m * every_b * (every_m - every_b)
    crowded = (F.col("children") > rule.children) & (
        F.col("all_n") < rule.rows_per_child * F.col("children"))
    several = F.col("children") > 1
    forms = stored(
        nodes.join(parents, ["host", "template"]).select(
            "host", "template", "share", "segment", "n", "labelled", "blocked",
            F.when(crowded | several & alike, "*").otherwise(F.col("segment")).alias("form"),
        ), "template-forms",
    )
    below = forms.groupBy("host", "template", "share", "form").agg(*_sums()).select(
        "host", "template", "form", _smoothed(F.col("share"), rule).alias("next"))
    named = stored(
        forms.join(below, ["host", "template", "form"]).select(
            "host", "template", "segment", "form", "next"), "template-names")
    return here.join(named, ["host", "template", "segment"], "left").select(
        "host", "shape", "n", "labelled", "blocked",
        F.concat("template", F.when(F.col("form").isNull(), "").otherwise(
            F.concat(F.lit("/"), "form"))).alias("template"),
        F.coalesce("next", "share").alias("share"),
    )


def judged_templates(rows: DataFrame, rule: TemplateRule = TemplateRule()) -> DataFrame:
    """(host, shape, template, verdict) from rows with ``host``, ``shape`` and ``label``.

    ``label`` is block, allow or null.
    """
    shapes = stored(
        rows.groupBy("host", "shape").agg(
            F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"),
            F.count_if(F.col("label") == "block").alias("blocked"),
            F.lit("").alias("template"),
        ), "path-shapes",
    )
    hosts = stored(shapes.groupBy("host").agg(*_sums()), "hosts")
    every = hosts.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0)))
    blocked, labelled = every.first()
    share = F.lit(WHOLE * blocked // max(1, labelled)).cast("bigint")
    domain = F.substring_index("host", ".", -2)
    domains = hosts.groupBy(domain.alias("domain")).agg(*_sums()).select(
        "domain", _smoothed(share, rule).alias("above"))
    named = hosts.withColumn("domain", domain).join(domains, "domain")
    shapes = shapes.join(named.select("host", _smoothed(F.col("above"), rule).alias("share")), "host")
    for at in range(rule.depth + 1):
        shapes = stored(_level(shapes, at, rule), "path-shapes")
    own = shapes.groupBy("host", "template", "share").agg(*_sums())
    rejected = _smoothed(F.col("share"), rule) * 100 >= F.lit(WHOLE * rule.threshold_percent)
    verdicts = stored(
        own.select("host", "template", F.when(rejected, "block").otherwise("allow").alias("verdict")),
        "templates")
    return shapes.select("host", "shape", "template").join(verdicts, ["host", "template"])


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], rule: TemplateRule = TemplateRule(), *,
    key: str = "page_id", url: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: the key, ``host``, ``path``, ``rule``, ``verdict``, ``template``.

    Where a rule fits, its verdict holds; else that of the address's template.
    Null addresses and those without ``://`` have an empty host and path, and
    are judged as one template.  Repeated rows count and are judged each.
    """
    places = pages.select(
        F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    chosen = ruled(F.col("host"), F.col("path"), rules)
    rows = places.select(
        "key", "host", "path", shape_of(F.col("path"), rule).alias("shape"),
        chosen.getField("rule").alias("rule"), chosen.getField("verdict").alias("label"),
    )
    # Read from a table, so that adaptive execution can split a host with very many rows.
    templates = stored(judged_templates(rows, rule), "judged-templates")
    return rows.join(templates, ["host", "shape"]).select(
        F.col("key").alias(key), "host", "path", "rule",
        F.coalesce("label", "verdict").alias("verdict"), "template",
    )
