"""Hard negatives by exact inner products of Kronecker-packed integers.

A tile of candidates is packed by component: the j-th components of all of them, raised
by a bias so that none is negative, are laid into separate fields of one wide integer.
Multiplying this integer by the anchor's j-th component, raised likewise, multiplies
every field at once, and the sum over j holds all inner products of the tile, one a
field. Fields are whole bytes, wide enough for the largest sum, so nothing carries over
from one field to the next; packing and unpacking are views of an array. What the biases
added is taken off again:

    sum (a+A)(x+X) = sum a x + X sum (a+A) + A sum (x+X) - n A X

Python's integers have no limit, so scores are exact however large the components are.

Anchors are taken in blocks of bounded size. For a block the table is scanned twice: for
the positives of each anchor, then, knowing their scores, for the negatives that go with
them. Rows are never shuffled; each task gives its best few for every anchor, which are
merged by anchor. A block's result is written and its broadcasts are freed before the
next block begins.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontomill.llm.common import slices
from ontomill.sources.scratch import Scratch

SCALE = 256
#: Numbers in one block of anchors: 8 MB as int64.
BLOCK_NUMBERS = 1_000_000
#: Candidates in one wide integer.
TILE_ROWS = 2_048
#: Components and biases below this, in vectors of up to ``_WIDTH``, keep all in 64 bits.
_PLAIN, _WIDTH = 2**24, 2**13
_LEAST, _MOST = -(2**63), 2**63 - 1


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, vector)`` of the rows with an id, a label and finite components."""
    bad = F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return (
        rows.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )
        .filter("vec_id is not null and label is not null and vector is not null")
        .filter(~bad)
    )


# ---- packed products ----


def integers(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``floor(256 x)``, filled up with zeros to ``width``; Python integers in an
    object array where products might not fit 64 bits. 256 x beyond all doubles counts as
    the largest double."""
    counts = np.diff(column.offsets.to_numpy())
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        flat = SCALE * column.flatten().to_numpy(zero_copy_only=False)
    flat = np.floor(np.clip(flat, -most, most))
    wide = width > _WIDTH or (len(flat) and np.abs(flat).max() >= _PLAIN)
    whole = np.array([int(x) for x in flat], object) if wide else flat.astype(np.int64)
    out = np.zeros((len(counts), width), object if wide else np.int64)
    out[np.arange(width) < counts[:, None]] = whole
    return out


def _bias(values: np.ndarray) -> int:
    return max(0, -int(values.min())) if values.size else 0


class _Block:
    """Anchors ready to be multiplied: raised components, ids and labels."""

    def __init__(self, taken: pa.Table, width: int):
        vectors = integers(taken.column("vector").combine_chunks(), width)
        self.wide = vectors.dtype == object
        self.bias = _bias(vectors)
        raised = vectors + self.bias
        self.most = int(raised.max()) if raised.size else 0
        self.anchors = raised.tolist()
        self.labels = taken.column("label").to_numpy()
        self.width = width


class Tile:
    """Candidates packed into one wide integer a component, for the anchors of a block."""

    def __init__(self, vectors: np.ndarray, block: _Block):
        if block.wide:
            vectors = vectors.astype(object)
        self.rows, self.width = vectors.shape
        self.bias, self.anchor_bias = _bias(vectors), block.bias
        raised = vectors + self.bias
        most = int(raised.max()) if raised.size else 0
        # A sum of products, and a packed component, must stay below 256**field.
        largest = max(1, most, self.width * most * block.most)
        field = (largest.bit_length() + 7) // 8
        self.field = next((n for n in (1, 2, 4, 8) if n >= field), field)
        self.packed = [self._pack(raised[:, j]) for j in range(self.width)]
        self.sums = raised.sum(axis=1) if self.width else np.zeros(self.rows, vectors.dtype)

    def _pack(self, values: np.ndarray) -> int:
        if self.field < 8 and values.dtype != object:
            return int.from_bytes(values.astype(f"<u{self.field}").tobytes(), "little")
        return int.from_bytes(b"".join(int(v).to_bytes(self.field, "little") for v in values), "little")

    def _unpack(self, total: int) -> np.ndarray:
        data = total.to_bytes(self.rows * self.field, "little")
        if self.field < 8:
            return np.frombuffer(data, f"<u{self.field}").astype(self.sums.dtype)
        ends = range(0, len(data), self.field)
        return np.array([int.from_bytes(data[i : i + self.field], "little") for i in ends], object)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner product of every row with an anchor, given raised by its bias; numbers
        beyond 64 bits are set to the nearest of 64 bits."""
        total = 0
        for factor, packed in zip(anchor, self.packed):
            if factor:
                total += factor * packed
        exact = (
            self._unpack(total)
            - self.bias * sum(anchor)
            - self.anchor_bias * self.sums
            + self.width * self.bias * self.anchor_bias
        )
        return np.clip(exact, _LEAST, _MOST).astype(np.int64) if exact.dtype == object else exact


# ---- tasks ----


def _tiles(batches: Iterator[pa.RecordBatch], width: int):
    """``(ids, labels, vectors)`` of at most ``TILE_ROWS`` rows at a time, ids ascending."""
    for part in slices(batches, TILE_ROWS):
        ids = part.column(0).to_numpy()
        order = np.argsort(ids, kind="stable")
        yield ids[order], part.column(1).to_numpy()[order], integers(part.column(2), width)[order]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first ``k`` as ``(-score, id)``: higher scores first, ties by smaller id."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        reach = np.flatnonzero(scores >= limit)
        scores, ids = scores[reach], ids[reach]
    order = np.lexsort((ids, -scores))[:k]
    return list(zip((-scores[order]).tolist(), ids[order].tolist()))


def _positives(shared: Broadcast, k: int):
    """The first ``k`` rows of the anchor's label, for each anchor, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        by_label = defaultdict(list)
        for i, label in enumerate(block.labels.tolist()):
            by_label[label].append(i)
        best: dict[int, list] = defaultdict(list)
        for ids, labels, vectors in _tiles(batches, block.width):
            for label in np.unique(labels).tolist():
                asked = by_label.get(label)
                if not asked:
                    continue
                own = np.flatnonzero(labels == label)
                tile = Tile(vectors[own], block)
                for i in asked:
                    scores = tile.scores(block.anchors[i])
                    best[i] = sorted(best[i] + _first(scores, ids[own], k))[:k]
        rows = [(i, vec_id, -score) for i, found in best.items() for score, vec_id in found]
        yield _batch(rows, ["anchor", "vec_id", "score"])

    return run


def _negatives(shared: Broadcast, asked: Broadcast, k: int):
    """The first ``k`` rows of other labels within the bounds of each positive, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        bounds: dict[int, list] = asked.value
        best: dict[tuple[int, int], list] = {}
        for ids, labels, vectors in _tiles(batches, block.width):
            tile = Tile(vectors, block)
            for i, limits in bounds.items():
                scores = tile.scores(block.anchors[i])
                # Within the limits of some positive, before each is looked at.
                near = scores >= min(least for least, _, _ in limits)
                near &= scores <= max(most for _, most, _ in limits)
                near = np.flatnonzero(near & (labels != block.labels[i]))
                if not len(near):
                    continue
                scores, names = scores[near], ids[near]
                for limit in limits:
                    fits = np.flatnonzero((scores >= limit[0]) & (scores <= limit[1]))
                    if len(fits):
                        found = best.get((i, limit), []) + _first(scores[fits], names[fits], k)
                        best[i, limit] = sorted(found)[:k]
        rows = [
            (i, limit[2], vec_id, -score)
            for (i, limit), found in best.items()
            for score, vec_id in found
        ]
        yield _batch(rows, ["anchor", "positive_score", "vec_id", "score"])

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=names)


# ---- the operator ----


def _limits(score: int, low: int, high: int) -> tuple[int, int, int]:
    """``(least, most, score)``: the scores s with ``low * score <= 100 s <= high * score``."""
    return max(_LEAST, -(-low * score // 100)), min(_MOST, high * score // 100), score


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Both inputs have ``vec_id``, ``label`` and ``embedding``; ``anchors`` are rows of
    ``rows``. Scores are inner products of the components ``floor(256 x)``. The positives
    of an anchor are its first other rows of the same label; for each of them the first
    rows of other labels follow whose score lies between ``low`` and ``high`` per cent of
    the positive's. Higher scores come first, ties by the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part.
    An empty vector is all zeros; a shorter one counts as filled up with zeros. Rows that
    repeat an id are rows of their own, as candidates and as anchors (each anchor row
    gives its own result rows). Scores beyond 64 bits are set to the nearest of 64 bits.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    table = usable(rows)
    asked = usable(anchors).groupBy("vec_id", "label", "vector").agg(F.count("*").alias("copies"))
    count, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long,"
            " positive_score long, negative_score long",
        )
    # Components beyond the longest anchor meet zeros only.
    blocks = math.ceil(count * max(1, width) / BLOCK_NUMBERS)
    asked = scratch.cut(
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)))
    )
    table = table.withColumn("vector", F.slice("vector", 1, width))
    parts = [
        _mine_block(scratch, table, asked.filter(F.col("block") == n), width, positives, negatives, low, high)
        for n in range(blocks)
    ]
    found = [part for part in parts if part is not None]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _mine_block(
    scratch: Scratch,
    table: DataFrame,
    asked: DataFrame,
    width: int,
    positives: int,
    negatives: int,
    low: int,
    high: int,
) -> DataFrame | None:
    spark = scratch.spark
    taken = asked.toArrow()
    if not taken.num_rows:
        return None
    block = _Block(taken, width)
    shared = spark.sparkContext.broadcast(block)
    # One more than asked for: an anchor is among the rows of its label, and is left out.
    near = table.mapInArrow(
        _positives(shared, positives + 1), "anchor long, vec_id long, score long"
    )
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives + 1)
    chosen = _without_anchor(near.toArrow().to_pylist(), taken, block, positives)
    bounds: dict[int, list] = defaultdict(list)
    for i, _, score in chosen:
        limit = _limits(score, low, high)
        if limit[0] <= limit[1] and limit not in bounds[i]:
            bounds[i].append(limit)
    asked_of = spark.sparkContext.broadcast({i: limits for i, limits in bounds.items() if limits})
    far = table.mapInArrow(
        _negatives(shared, asked_of, negatives),
        "anchor long, positive_score long, vec_id long, score long",
    )
    best = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vec_id")
    far = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    pairs = _frame_of(spark, chosen, taken)
    mined = (
        pairs.join(far, ["anchor", "positive_score"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
    written = scratch.cut(mined)
    shared.unpersist()
    asked_of.unpersist()
    return written


def _without_anchor(near: list[dict], taken: pa.Table, block: _Block, k: int) -> list[tuple]:
    """``(anchor, positive_id, score)`` of the first ``k`` rows besides the anchor.

    The anchor's own row has its id and the score with itself; rows that agree in both
    are alike in the result, so any one of them may be left out.
    """
    ids = taken.column("vec_id").to_pylist()
    by_anchor: dict[int, list] = defaultdict(list)
    for row in near:
        by_anchor[row["anchor"]].append((row["place"], row["vec_id"], row["score"]))
    chosen = []
    for i, found in by_anchor.items():
        found.sort()
        own = [a - block.bias for a in block.anchors[i]]
        own = min(_MOST, sum(a * a for a in own))
        at = next((n for n, (_, v, s) in enumerate(found) if v == ids[i] and s == own), None)
        rest = found if at is None else found[:at] + found[at + 1 :]
        chosen += [(i, v, s) for _, v, s in rest[:k]]
    return chosen


def _frame_of(spark, chosen: list[tuple], taken: pa.Table) -> DataFrame:
    """The positives of a block as a table; no more than the block's anchors times k rows."""
    ids, copies = taken.column("vec_id").to_pylist(), taken.column("copies").to_pylist()
    rows = [(i, ids[i], copies[i], positive, score) for i, positive, score in chosen]
    names = ["anchor", "anchor_id", "copies", "positive_id", "positive_score"]
    return spark.createDataFrame(pa.Table.from_batches([_batch(rows, names)]))
