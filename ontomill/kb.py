"""A knowledge base: one DataFrame per table of ``ontomill.schema``."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontomill.schema import TABLES, columns


class KnowledgeBase:
    """Named DataFrames with fixed schemas. Tables not given are empty."""

    def __init__(
        self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]
    ):
        """``tables`` holds DataFrames, or functions that make one when first asked for."""
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise KeyError(f"unknown tables: {sorted(unknown)}")
        self.spark = spark
        self._tables = dict(tables)

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows: list[tuple]) -> KnowledgeBase:
        """Build a knowledge base from small literal row lists (axioms, fixtures)."""
        return cls(
            spark,
            {n: partial(local_frame, spark, r, TABLES[n]) for n, r in rows.items() if r},
        )

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> KnowledgeBase:
        """Read the tables that ``write`` stored under ``path``."""
        return cls(
            spark,
            {name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in TABLES.items()},
        )

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables.get(name)
        if table is None:
            return local_frame(self.spark, [], TABLES[name])
        if callable(table):
            table = self._tables[name] = table()
        return _conform(name, table)

    def has(self, *names: str) -> bool:
        """Whether every named table was given (a table not given is empty)."""
        return all(name in self._tables for name in names)

    def has_any(self, *names: str) -> bool:
        """Whether one of the named tables was given."""
        return any(name in self._tables for name in names)

    def replace(self, **tables: DataFrame | Callable[[], DataFrame]) -> KnowledgeBase:
        return KnowledgeBase(self.spark, {**self._tables, **tables})

    def union(self, other: KnowledgeBase) -> KnowledgeBase:
        merged = dict(self._tables)
        for name in other._tables:
            merged[name] = self[name].unionByName(other[name]) if name in merged else other[name]
        return KnowledgeBase(self.spark, merged)

    def write(self, path: str) -> None:
        """Store every table as a set of rows in Parquet, replacing what is there.

        Rows are range-partitioned and sorted by all columns, so the row-group
        statistics prune scans for one class or property, and a class or property
        with very many members is spread over several files.
        """
        for name in TABLES:
            df = self[name].dropDuplicates()
            if name in self._tables:
                df = df.repartitionByRange(*columns(name)).sortWithinPartitions(*columns(name))
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def local_frame(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A small literal table. Through Arrow, the planner knows its rows and their size."""
    arrow = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}
    fields = pa.schema([(f.name, arrow[f.dataType]) for f in schema.fields])
    named = [dict(zip(schema.fieldNames(), row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, schema=fields))


def _conform(name: str, df: DataFrame) -> DataFrame:
    if df.columns == columns(name) and [f.dataType for f in df.schema] == [
        f.dataType for f in TABLES[name]
    ]:
        return df
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
