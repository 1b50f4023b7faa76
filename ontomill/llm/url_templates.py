"""URL filters by a tree of path templates for every host.

A path is its segments. Segments that look variable (numbers, dates, long ids) become
``*`` at once. Then the tree of each host is walked from the root down:

* a node with very many, seldom seen children is generalised: all its children are ``*``;
* children whose share of bad labels is statistically that of their node (within
  ``SIMILAR`` standard errors) are merged into ``*``; those that differ stay apart.

Rows are reduced to distinct (host, path) pairs before the tree is built and each level
is a few grouped counts, so a host with a third of all pages costs no more than others.
A template is rejected if its share of bad labels, smoothed by the share of all labels,
passes ``MAX_BAD``. Explicit rules for hosts and paths win over the templates.

Labels belong to pages (``page_labels``): where a rule fits its verdict is the label, any
other page is bad if its main text fails the base quality rule.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.llm import html_text, quality
from ontomill.sources.scratch import Scratch

#: Levels of the tree; deeper segments belong to the last level together.
DEPTH = 8
#: A node is generalised if it has this many children or more ...
MANY_CHILDREN = 16
#: ... seen fewer times than this on average.
FEW_PAGES = 4
SIMILAR = 2.0
#: Weight of the share of all labels, in labelled pages.
SMOOTHING = 10
MAX_BAD = 0.5
_VARIABLE = r"^(\d[\d_.-]*|[0-9a-fA-F-]{12,}|.*\d{4,}.*)(\.[A-Za-z]{1,5})?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits.

    A rule is ``(verdict, host/path)``. It fits its host and all subdomains if the path
    starts with that of the rule.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(
            slash + own_path
        )
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    named = F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(s.rlike(_VARIABLE), F.lit("*")).otherwise(s),
    )
    tail = F.array_join(F.slice(named, DEPTH, F.greatest(F.size(named) - DEPTH + 1, F.lit(0))), "/")
    return F.when(
        F.size(named) > DEPTH, F.concat(F.slice(named, 1, DEPTH - 1), F.array(tail))
    ).otherwise(named)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, shape, template, n, labelled, bad, purity)`` for each path shape of a host.

    ``pages`` has page_id, host and shape (the segments as an array); ``labels`` has
    page_id and bad (0 or 1; null is no label). ``purity`` is the smoothed share of good
    labels of the template that the shape belongs to.
    """
    scratch = Scratch(pages.sparkSession)
    known = labels.filter("bad in (0, 1) and page_id is not null")
    known = known.groupBy(F.col("page_id").alias("_labelled_page")).agg(F.max("bad").alias("bad"))
    shapes = (
        pages.join(known, F.col("page_id") == F.col("_labelled_page"), "left")
        .groupBy("host", "shape")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("bad").alias("labelled"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        )
    )
    shapes = scratch.cut(shapes.withColumn("segments", F.col("shape")))
    deepest = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        node = F.array_join(F.slice("segments", 1, level), "/")
        named = shapes.filter(F.size("segments") > level).select(
            "host", node.alias("node"), F.col("segments")[level].alias("child"), "n", "labelled", "bad"
        )
        children = scratch.cut(named.groupBy("host", "node", "child").agg(*_sums()))
        nodes = children.groupBy("host", "node").agg(
            F.count(F.lit(1)).alias("_children"),
            F.sum("n").alias("_n"),
            F.sum("labelled").alias("_labelled"),
            F.sum("bad").alias("_bad"),
        )
        share = (F.col("_bad") + SMOOTHING / 2) / (F.col("_labelled") + SMOOTHING)
        own = F.col("bad") / F.greatest("labelled", F.lit(1))
        error = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))
        many = (F.col("_children") >= MANY_CHILDREN) & (
            F.col("_n") < FEW_PAGES * F.col("_children")
        )
        alike = (F.col("_children") > 1) & (
            (F.col("labelled") == 0) | (F.abs(own - share) <= SIMILAR * error)
        )
        merged = (
            children.join(scratch.cut(nodes), ["host", "node"])
            .filter((many | alike) & (F.col("child") != "*"))
            .select("host", "node", "child", F.lit(True).alias("_star"))
        )
        shapes = scratch.cut(
            shapes.withColumn("node", node)
            .withColumn("child", F.get("segments", F.lit(level)))
            .join(scratch.cut(merged), ["host", "node", "child"], "left")
            .withColumn(
                "segments",
                F.when(
                    F.col("_star"),
                    F.concat(
                        F.slice("segments", 1, level),
                        F.array(F.lit("*")),
                        F.slice("segments", level + 2, DEPTH),
                    ),
                ).otherwise(F.col("segments")),
            )
            .drop("node", "child", "_star")
        )
    all_, bad = shapes.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = (bad or 0) / all_ if all_ else 0.0
    found = shapes.groupBy("host", "segments").agg(*_sums())
    smoothed = (F.col("bad") + SMOOTHING * prior) / (F.col("labelled") + SMOOTHING)
    found = found.withColumn("purity", 1 - smoothed)
    return (
        shapes.select("host", "shape", "segments")
        .join(scratch.cut(found), ["host", "segments"])
        .select(
            "host",
            "shape",
            F.concat(F.lit("/"), F.array_join("segments", "/")).alias("template"),
            "n",
            "labelled",
            "bad",
            "purity",
        )
    )


def held_out(page_id: Column) -> Column:
    """Whether the label of a page is kept from learning, a third of all; null ids are not."""
    crc = F.crc32(page_id.cast("long").cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 1, F.lit(False))


def page_labels(pages: DataFrame, rules: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """``(page_id, bad)`` of every page with an id, from its url and html.

    A page that a rule fits is bad (1) if the rule blocks it, else good (0). Any other is
    bad if its main text has under 50 words or over half of them in repeated windows, so
    null and empty html are bad. Repeated rows have a label each; other columns are ignored.
    """
    known = pages.filter("page_id is not null")
    said = rule_of(*host_and_path(F.col("url")), rules)[1]
    ruled = known.filter(said.isNotNull()).select("page_id", (said == "block").cast("int").alias("bad"))
    texts = html_text.extract(known.filter(said.isNull())).select(
        F.col("page_id").alias("doc_id"), "text"
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = quality.quality(texts).select(
        F.col("doc_id").alias("page_id"), failed.cast("int").alias("bad")
    )
    return ruled.unionByName(judged)


def judge(pages: DataFrame, labels: DataFrame, rules: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity, template_verdict)`` of every page.

    ``verdict`` is the rule's, or that of the template where no rule fits.

    Null urls and urls without ``://`` have empty host and path and are judged like any
    other template. Null ids and repeated rows stay as they are; columns beside page_id
    and url are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    shaped = parsed.withColumn("shape", _segments(F.col("path")))
    found = scratch.cut(templates(shaped.select("page_id", "host", "shape"), labels))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < 1 - MAX_BAD, "block").otherwise("allow")
    return (
        shaped.join(found.select("host", "shape", "template", "purity"), ["host", "shape"], "left")
        .withColumn("rule", rule)
        .withColumn("template_verdict", own)
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce(said, "template_verdict").alias("verdict"),
            "template",
            "purity",
            "template_verdict",
        )
    )
