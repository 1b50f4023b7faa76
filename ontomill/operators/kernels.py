"""The seven ways in which edges are applied to facts.

``ci`` has columns ``(cls, individual)``, ``pi`` ``(prop, domain, range)`` and
``sa`` ``(ind, same)``. Results may hold repeated rows; callers take the distinct
rows once, after all shapes are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.operators.joins import key_join


def _end(side: Column) -> Column:
    return F.when(side == "domain", F.col("domain")).otherwise(F.col("range"))


def _other_end(side: Column) -> Column:
    return F.when(side == "domain", F.col("range")).otherwise(F.col("domain"))


def class_to_class(ci: DataFrame, edges: DataFrame) -> DataFrame:
    reached = key_join(ci, edges.withColumnRenamed("src", "cls"), ["cls"])
    return reached.select(F.col("dst").alias("cls"), "individual")


def class_pair_to_class(ci: DataFrame, edges: DataFrame, second: DataFrame) -> DataFrame:
    """``ci`` supplies the c1 members, ``second`` the c2 members."""
    half = key_join(ci, edges.withColumnRenamed("c1", "cls"), ["cls"])
    half = half.select(F.col("c2").alias("cls"), "individual", "dst")
    # Both keys together identify a row of ``second``; no class can make a hub.
    return half.join(second, ["cls", "individual"]).select(F.col("dst").alias("cls"), "individual")


def property_to_class(pi: DataFrame, edges: DataFrame) -> DataFrame:
    reached = key_join(pi, edges, ["prop"])
    return reached.select(F.col("dst").alias("cls"), _end(F.col("side")).alias("individual"))


def property_to_property(pi: DataFrame, edges: DataFrame) -> DataFrame:
    reached = key_join(pi, edges.withColumnRenamed("src", "prop"), ["prop"])
    return reached.select(
        F.col("dst").alias("prop"),
        F.when(F.col("flip"), F.col("range")).otherwise(F.col("domain")).alias("domain"),
        F.when(F.col("flip"), F.col("domain")).otherwise(F.col("range")).alias("range"),
    )


def link_ends(pi: DataFrame, ends: DataFrame) -> DataFrame:
    """``(prop, side, node, other)`` for each end that ``ends`` (prop, side) names."""
    return key_join(pi, ends.dropDuplicates(), ["prop"]).select(
        "prop",
        "side",
        _end(F.col("side")).alias("node"),
        _other_end(F.col("side")).alias("other"),
    )


def guarded_property_to_class(ci: DataFrame, edges: DataFrame, pi: DataFrame) -> DataFrame:
    guards = key_join(ci, edges, ["cls"]).select(
        "prop", "side", F.col("individual").alias("node"), "dst"
    )
    ends = link_ends(pi, edges.select("prop", "side"))
    reached = key_join(ends, guards, ["prop", "side", "node"])
    return reached.select(F.col("dst").alias("cls"), F.col("other").alias("individual"))


def guarded_ends(ci: DataFrame, edges: DataFrame, pi: DataFrame) -> DataFrame:
    """Ends ``(prop, side, node, other)`` of links whose subject is in the guard class."""
    guards = key_join(ci, edges, ["cls"]).select("prop", F.col("individual").alias("node"))
    ends = link_ends(pi, edges.select("prop", F.lit("domain").alias("side")))
    return key_join(ends, guards, ["prop", "node"], "left_semi").select(
        "prop", "side", "node", "other"
    )


def same_values(ends: DataFrame) -> DataFrame:
    """sameAs links among the values that share one single-valued end.

    The values of an end are linked to the smallest of them, in both directions. A
    group of n values thus takes 2(n - 1) links where all pairs would take n(n - 1);
    every pair is reached through the smallest value (``same_pairs`` lists them).
    """
    smallest = (
        ends.groupBy("prop", "side", "node")
        .agg(F.min("other").alias("least"), F.max("other").alias("most"))
        .filter(F.col("least") < F.col("most"))
        .select("prop", "side", "node", "least")
    )
    spokes = (
        key_join(ends, smallest, ["prop", "side", "node"])
        .filter(F.col("other") != F.col("least"))
        .select(F.explode(F.array(_pair("other", "least"), _pair("least", "other"))).alias("_p"))
    )
    return spokes.select("_p.ind", "_p.same")


def same_pairs(ends: DataFrame) -> DataFrame:
    """All ordered pairs of different values of one single-valued end.

    The result is quadratic in the number of values of an end, as asked for.
    """
    right = ends.withColumnRenamed("other", "same")
    pairs = key_join(ends.withColumnRenamed("other", "ind"), right, ["prop", "side", "node"])
    return pairs.filter(F.col("ind") != F.col("same")).select("ind", "same")


def _pair(ind: str, same: str) -> Column:
    return F.struct(F.col(ind).alias("ind"), F.col(same).alias("same"))


def same_to_class(ci: DataFrame, sa: DataFrame) -> DataFrame:
    links = sa.select(F.col("ind").alias("individual"), "same")
    return key_join(links, ci, ["individual"]).select("cls", F.col("same").alias("individual"))


def same_to_property(pi: DataFrame, sa: DataFrame, side: str = "domain") -> DataFrame:
    """Replace the ``side`` end of each link by the individuals equal to it."""
    links = sa.select(F.col("ind").alias(side), "same")
    moved = key_join(pi, links, [side]).drop(side).withColumnRenamed("same", side)
    return moved.select("prop", "domain", "range")
