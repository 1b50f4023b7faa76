"""Counts and ordinals over knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontomill.functions.terms import axiom_type
from ontomill.kb import KnowledgeBase
from ontomill.operators.joins import new_rows
from ontomill.sources.scratch import Scratch

def class_counts(kb: KnowledgeBase) -> DataFrame:
    """``(cls, n)``: members of each class."""
    return _count(kb["class_individuals"], "cls")


def property_counts(kb: KnowledgeBase) -> DataFrame:
    """``(prop, n)``: links of each property."""
    return _count(kb["prop_individuals"], "prop")


def same_as_counts(kb: KnowledgeBase) -> DataFrame:
    """``(ind, n)``: sameAs rows of each individual."""
    return _count(kb["same_as"], "ind")


def _count(table: DataFrame, key: str) -> DataFrame:
    return table.dropDuplicates().groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def axiom_counts(triples: DataFrame) -> DataFrame:
    """``(axiom_type, n)``: triples by the kind of axiom they state."""
    triples = triples.dropDuplicates()  # an ontology is a set of axioms
    kinds = triples.select(axiom_type(triples).alias("axiom_type"))
    kinds = kinds.filter(F.col("axiom_type").isNotNull())
    return kinds.groupBy("axiom_type").agg(F.count(F.lit(1)).alias("n"))


def ordinals(table: DataFrame, key: str, *by: str) -> DataFrame:
    """Add ``num`` to the distinct rows: 1, 2, … within each ``key``, in the order of ``by``."""
    return number_rows(table.dropDuplicates(), key, *by)


def number_rows(rows: DataFrame, key: str, *by: str, total: str | None = None) -> DataFrame:
    """Add ``num``: 1, 2, … within each ``key``, in the order of ``by``; rows without a key are
    left out. ``total`` names a further column, for the number of rows of the key.

    The rows of one key are numbered in pieces: the table is written in the order of
    ``(key, by)``, each piece is numbered for itself, and the sizes of the earlier pieces
    of the key are added. No key is sorted in one task. A key is in several pieces only if one
    piece ends with it and the next begins with it, so there are fewer such keys than pieces.
    """
    scratch = Scratch(rows.sparkSession)
    ranged = rows.repartitionByRange(key, *by).withColumn("_piece", F.spark_partition_id())
    ranged = scratch.cut(ranged.filter(F.col(key).isNotNull()))
    ends = ranged.groupBy("_piece").agg(F.array(F.min(key), F.max(key)).alias("_ends"))
    ends = ends.select("_piece", F.explode(F.array_distinct("_ends")).alias(key))
    parted = scratch.cut(ends.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key))
    sizes = ranged.join(parted, key).groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    # At most two rows a piece.
    whole = Window.partitionBy(key)
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.cut(
        sizes.select(
            key,
            "_piece",
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_size").over(whole).alias("_all_of_key"),
        )
    )
    inside = Window.partitionBy(key, "_piece")
    numbered = ranged.withColumn("_num", F.row_number().over(inside.orderBy(*by)))
    if total is not None:
        numbered = numbered.withColumn("_here", F.count(F.lit(1)).over(inside))
    numbered = numbered.join(offsets, [key, "_piece"], "left")
    added = [(F.col("_num") + F.coalesce("_before", F.lit(0))).alias("num")]
    if total is not None:
        added.append(F.coalesce("_all_of_key", "_here").alias(total))
    return numbered.select(*rows.columns, *added)


def last_numbers(numbered: DataFrame, key: str) -> DataFrame:
    """``(key, last)``: the highest ``num`` of each key."""
    return numbered.groupBy(key).agg(F.max("num").alias("last"))


def insert_numbered(
    batch: DataFrame, numbered: DataFrame, last: DataFrame, key: str, *by: str
) -> tuple[DataFrame, DataFrame]:
    """``(inserted, last)``: the rows of ``batch`` that are new, with numbers that go on where
    their key's ended, and the last numbers with them.

    Rows numbered before keep their numbers and are not numbered again; ``last`` is one row
    a key. A batch that repeats a row, or a row that is there already, adds nothing for it.
    Within a batch numbers follow the order of ``by``.
    """
    fresh = new_rows(batch.select(key, *by), [numbered.select(key, *by)])
    inserted = (
        number_rows(fresh, key, *by)
        .join(last, key, "left")
        .select(key, *by, (F.col("num") + F.coalesce("last", F.lit(0))).alias("num"))
    )
    inserted = Scratch(batch.sparkSession).cut(inserted)
    ends = last.unionByName(last_numbers(inserted, key)).groupBy(key)
    return inserted, ends.agg(F.max("last").alias("last"))
