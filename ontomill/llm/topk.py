"""Exact top-k inner products by tiled matrix products.

Queries are taken in blocks of a fixed size. For each block the table is scanned once:
every task multiplies tiles of its rows with the block, keeps the best k of each query
tile by tile, and gives one list for each query. Lists are merged by Spark: the best k
of each query and task before the shuffle, the best k of each query after it.

A block holds at most ``BLOCK_NUMBERS`` numbers, which bounds what is broadcast. The
work is the product that is asked for, queries times rows; rows are never shuffled.

Components are turned into integers, so scores are exact: products run in float64 while
all sums stay below 2**53, and in Python integers otherwise. Scores beyond 64 bits are
set to the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontomill.llm.common import slices

#: Numbers in one block of queries: 32 MB as float64.
BLOCK_NUMBERS = 4_000_000
TILE_ROWS = 4_096
TILE_QUERIES = 1_024
SCALE = 256
_EXACT = 2.0**53
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector without null, NaN or infinite components."""
    bad = F.exists(
        "_vector",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("_vector"),
        )
        .filter(F.col("vec_id").isNotNull() & F.col("_vector").isNotNull())
        .filter(~bad)
    )


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``floor(256 x)``, padded with zeros to ``width`` (or cut if longer)."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    at = 0
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; int64, or Python integers held within 64 bits."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if most * max(1, queries.shape[1]) < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries).dot(whole(rows).T) if queries.shape[1] else None
    if exact is None:
        return np.zeros((len(queries), len(rows)), np.int64)
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the k largest scores, ties to the smaller id; ids may differ by row."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _tile_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``_best`` of a tile whose ids ascend: only what reaches the k-th score is sorted."""
    n = scores.shape[1]
    if n <= 4 * k:
        return _best(scores, np.broadcast_to(ids, scores.shape), k)
    limit = np.partition(scores, n - k, axis=1)[:, n - k]
    above = scores > limit[:, None]
    level = scores == limit[:, None]
    need = k - above.sum(axis=1)
    keep = above | (level & (np.cumsum(level, axis=1) <= need[:, None]))
    columns = np.nonzero(keep)[1].reshape(len(scores), k)
    return _best(np.take_along_axis(scores, columns, 1), ids[columns], k)


def _search(block: Broadcast, k: int):
    """The best k of one task's rows for every query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = block.value
        tops = [
            np.full((len(names), k), _LEAST, np.int64),
            np.full((len(names), k), _MOST, np.int64),
            np.zeros((len(names), k), bool),
        ]

        def merge(which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
            found = (scores, ids, np.ones(scores.shape, bool))
            joined = [np.concatenate([top[which], new], axis=1) for top, new in zip(tops, found)]
            order = np.lexsort((joined[1], -joined[0], ~joined[2]), axis=1)[:, :k]
            for top, values in zip(tops, joined):
                top[which] = np.take_along_axis(values, order, 1)

        for part in slices(batches, TILE_ROWS):
            ids = part.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            rows = _matrix(part.column(1), queries.shape[1])[order]
            for at in range(0, len(names), TILE_QUERIES):
                asked = names[at : at + TILE_QUERIES]
                scores = _products(queries[at : at + TILE_QUERIES], rows)
                place = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
                own = ids[place] == asked
                for q in np.flatnonzero(own):  # a query is no candidate of its own
                    rest = np.flatnonzero(ids != asked[q])
                    if len(rest):
                        merge(np.array([at + q]), *_best(scores[q : q + 1, rest], ids[None, rest], k))
                others = np.flatnonzero(~own)
                if len(others):
                    merge(at + others, *_tile_best(scores[others], ids, k))
        scores, ids, filled = tops
        yield pa.record_batch(
            [
                pa.array(np.repeat(names, k)[filled.ravel()]),
                pa.array(ids[filled]),
                pa.array(scores[filled]),
            ],
            names=["query_id", "vec_id", "score"],
        )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best k of ``vectors`` for each query.

    Both have ``vec_id`` and ``embedding``. Vectors that are null or hold null or
    non-finite components take no part; an empty vector is all zeros, and a shorter
    vector counts as filled up with zeros. Equal scores go to the smaller id. Rows that
    repeat an id are each a candidate; a query is asked once for each id. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = usable(queries).dropDuplicates(["vec_id"])
    width = asked.agg(F.max(F.size("_vector"))).first()[0]
    if width is None:
        return _empty(spark)
    size = max(1, BLOCK_NUMBERS // max(1, width))
    by_key = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, after = None, None
    while True:
        block = asked if after is None else asked.filter(F.col("vec_id") > after)
        taken = block.orderBy("vec_id").limit(size).toArrow().combine_chunks()
        if not taken.num_rows:
            break
        names = taken.column(0).to_numpy()
        column = taken.column(1)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        shared = spark.sparkContext.broadcast((names, _matrix(column, width)))
        part = rows.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
        after = int(names[-1])
        if taken.num_rows < size:
            break
    if found is None:
        return _empty(spark)
    return (
        found.withColumn("rank", F.row_number().over(by_key))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _empty(spark) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
