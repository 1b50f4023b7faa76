"""Joins on shared columns, and rows that are new.

Joins are plain equi-joins: Spark broadcasts a side that its own estimate allows, and
adaptive execution splits the partitions of a key with very many rows. Nothing here
looks at sizes or forces a plan, so every input is read as often on large data as on
small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the shared columns ``on``; ``how`` is inner, left_semi or left_anti."""
    return left.join(right if how == "inner" else right.select(*on), on, how)


def new_rows(candidates: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Distinct candidate rows that are in none of the ``known`` tables."""
    fresh = candidates.dropDuplicates()
    for table in known:
        fresh = fresh.join(table, candidates.columns, "left_anti")
    return fresh


def new_rows_in_buckets(candidates: DataFrame, known: list[DataFrame]) -> DataFrame:
    """``new_rows`` for known tables that are bucketed by all their columns.

    Candidates are made distinct, which shuffles them into the buckets, and are then
    merged with each known table in place. The row number, which the optimiser may
    not move a join across, keeps it from checking every source of candidates for
    itself before they are made distinct.
    """
    columns = candidates.columns
    fresh = candidates.dropDuplicates().withColumn("_row", F.monotonically_increasing_id())
    for table in known:
        fresh = fresh.join(table.hint("merge"), columns, "left_anti")
    return fresh.filter(F.col("_row") >= 0).select(*columns)


def insert_new(candidates: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(inserted, table)``: the candidates not yet in ``current``, and both together."""
    inserted = new_rows(candidates.select(*current.columns), [current])
    return inserted, current.unionByName(inserted)
