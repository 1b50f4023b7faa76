"""Tables written in the shared checkpoint folder to cut the lineage of loops.

A written table survives the loss of an executor, carries exact sizes for the
planner, and is read back with column pruning and filter push-down.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontomill.kb import local_frame

#: ``Scratch.settle`` keeps up to this many rows as literals.
LITERAL_ROWS = 5_000


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or by ``setCheckpointDir``.

    Only a local session may run without one; it then gets a new folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="ontomill-")
        context.setCheckpointDir(root)
    return root


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Let Spark use the order of bucket files, so that merging them needs no sort.

    Holds for ``Scratch.write_bucketed``, which writes one sorted file per bucket; Spark
    looks at the number of files itself.
    """
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def watch_rows(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted while a job reads them; ``rows_seen`` has the number."""
    watched = Observation()
    return df.observe(watched, F.count(F.lit(1)).alias("rows")), watched


def rows_seen(watched: Observation) -> int | None:
    """The rows that a finished job led past ``watched``; None if the planner left that part
    of the job out."""
    seen = _figures(watched)
    return None if seen is None else seen["rows"]


def _figures(watched: Observation) -> dict | None:
    try:
        return watched.get
    except Py4JJavaError:  # there is no row of figures
        return None


class Scratch:
    """A new folder of written tables for one run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.run = uuid.uuid4().hex
        self.path = f"{checkpoint_root(spark)}/ontomill-{self.run}"
        self._written = 0
        self._bucketed: dict[str, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as a scan of the written files."""
        self._written += 1
        path = f"{self.path}/cut-{self._written:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut_rows(self, df: DataFrame) -> tuple[DataFrame, int]:
        """As ``cut``, with the number of rows, which the same job counts."""
        written, figures = self.cut_figures(df, rows="count(1)")
        return written, figures["rows"]

    def cut_figures(self, df: DataFrame, **figures: str) -> tuple[DataFrame, dict]:
        """As ``cut``, with figures given as SQL aggregates, which the same job works out."""
        aggregates = [F.expr(value).alias(name) for name, value in figures.items()]
        watched = Observation()
        written = self.cut(df.observe(watched, *aggregates))
        seen = _figures(watched)
        return written, written.agg(*aggregates).first().asDict() if seen is None else seen

    def settle(self, df: DataFrame) -> tuple[DataFrame, list | None]:
        """``df`` worked out: literal rows, also returned, if few; else a written table.

        It is written once either way; at most ``LITERAL_ROWS`` rows come to the driver.
        """
        written = self.cut(df)
        rows = written.limit(LITERAL_ROWS + 1).collect()
        if len(rows) <= LITERAL_ROWS:
            return local_frame(self.spark, rows, df.schema), rows
        return written, None

    def write_bucketed(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """Write ``df`` hashed by ``keys`` into as many buckets as a shuffle has partitions.

        A later join on ``keys`` reads the buckets in place of a shuffle, and a filter
        on the first key skips most of each bucket, as its rows are sorted. ``keys``
        should identify a row, so that no bucket can be much larger than another.
        """
        table = self._table(name)
        (
            df.write.format("parquet")
            .bucketBy(self.buckets, *keys)
            .sortBy(*keys)
            .option("path", self.path_of(name))
            .saveAsTable(table)
        )
        self._bucketed[name] = table
        return self.spark.table(table)

    def read_bucketed(self, path: str, name: str, schema: T.StructType, keys: list[str], buckets: int) -> DataFrame:
        """The bucketed files that another run wrote at ``path``, used where they are."""
        table = self._table(name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(f"`{key}`" for key in keys)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet"
            f" CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self._bucketed[name] = table
        return self.spark.table(table)

    def _table(self, name: str) -> str:
        return f"spark_catalog.default.ontomill_{self.run}_{name}"

    def path_of(self, name: str) -> str:
        return f"{self.path}/{name}"

    def delete(self, name: str) -> None:
        """Delete a bucketed table of this run, files included; nothing may read it any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._bucketed.pop(name)}")
        delete_folder(self.spark, self.path_of(name))

    def forget_tables(self) -> None:
        """Drop the catalog entries of the bucketed tables; the files stay."""
        for table in self._bucketed.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._bucketed = {}

    def close(self) -> None:
        """Delete all that this run wrote; frames that read it cannot be used any more."""
        self.forget_tables()
        delete_folder(self.spark, self.path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
