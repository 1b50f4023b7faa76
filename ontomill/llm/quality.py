"""Quality rules by compression bands.

A text is compressed with zstandard, whole and in fixed chunks. Repetitive text
compresses too well and noise hardly at all; what is usual depends on the length, as a
long text shares more. A band is the lowest and highest ratio (bytes in / bytes out)
that is let pass for texts of a length, interpolated between lengths on a logarithmic
scale. A text is rejected if the whole lies outside its band, or if more than
``MAX_BAD_CHUNKS`` of its chunks do; the last chunk is judged by its own length.

``fit`` learns the bands from all labelled good texts: the ``TAIL`` quantiles of each length
class, moved outwards by ``MARGIN`` of their distance from the class's median. ``BANDS``
holds wide limits for lengths with too few labelled texts. Quantiles are exact: texts are
numbered in order by Spark, and only those at the places asked for come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.common import rows_where, slices
from ontomill.operators.stats import number_rows
from ontomill.sources.scratch import Scratch

#: (bytes, lowest ratio, highest ratio); shorter texts than the first are not judged.
#: Used without labels, and as the shape of the limits beside and beyond learned lengths.
BANDS = (
    (64, 0.50, 1.90),
    (128, 0.70, 2.05),
    (300, 0.95, 2.15),
    (1_000, 1.20, 2.30),
    (3_000, 1.35, 2.50),
    (10_000, 1.40, 2.75),
    (100_000, 1.40, 3.30),
)
CHUNK_BYTES = 2_048
MAX_BAD_CHUNKS = 0.34
LEVEL = 3
#: Texts of a length class at least; classes are the same number of texts each.
CLASS_ROWS, MOST_CLASSES = 100, 12
#: Share of a class beyond each limit before the margin, and the margin.
TAIL, MARGIN = 0.005, 0.5

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks int, n_bad_chunks int, in_band boolean"
)
_SPACES = "\t\n\x0b\x0c\r "
#: The symbols that the count of symbols is about.
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits by length; the same for whole texts and chunks."""

    rows: tuple = BANDS
    chunk_bytes: int = CHUNK_BYTES
    max_bad_chunks: float = MAX_BAD_CHUNKS

    def fits(self, n_bytes: int, ratio: float) -> bool:
        if n_bytes < self.rows[0][0]:
            return True
        at = max(i for i, row in enumerate(self.rows) if row[0] <= n_bytes)
        size, low, high = self.rows[at]
        if at + 1 < len(self.rows):
            onward = self.rows[at + 1]
            share = math.log(n_bytes / size) / math.log(onward[0] / size)
            low, high = low + share * (onward[1] - low), high + share * (onward[2] - high)
        return low <= ratio <= high

    def limits(self, n_bytes: float) -> tuple[float, float]:
        at = np.log([row[0] for row in self.rows])
        return tuple(
            float(np.interp(math.log(n_bytes), at, [row[i] for row in self.rows])) for i in (1, 2)
        )


def _places(rows: int, shares: list[float]) -> list[tuple[int, int, float]]:
    """For each share the numbers, from 1, of the two rows that its quantile lies between,
    and how far from the first."""
    at = [share * (rows - 1) for share in shares]
    return [(int(a) + 1, min(int(a) + 1, rows - 1) + 1, a - int(a)) for a in at]


def _quantiles(
    rows: DataFrame, column: str, sizes: list[int], shares: list[float]
) -> list[list[float]]:
    """The quantiles of ``column`` in each class, ``_class`` being its place in ``sizes``."""
    places = [_places(n, shares) for n in sizes]
    asked = [(c, num) for c, own in enumerate(places) for num in sorted({n for a, b, _ in own for n in (a, b)})]
    asked = rows.sparkSession.createDataFrame(asked, "_class int, num long")
    numbered = number_rows(rows.select("_class", column), "_class", column)
    found = numbered.withColumn("num", F.col("num").cast("long")).join(F.broadcast(asked), ["_class", "num"])
    value = {(r["_class"], r["num"]): r[column] for r in found.collect()}
    return [
        [value[c, a] + share * (value[c, b] - value[c, a]) for a, b, share in own]
        for c, own in enumerate(places)
    ]


def learned(good: DataFrame, wide: Bands = Bands()) -> Bands:
    """Bands from the ``size`` and ``ratio`` of good texts; ``wide`` if these are too few.

    Ratios grow with the length within a class too, so quantiles are taken of their
    distance from the line through the classes' medians. Beyond the middle of the first
    and the last class the limits run in parallel to those of ``wide``.
    """
    scratch = Scratch(good.sparkSession)
    judged = good.filter(F.col("size") >= wide.rows[0][0]).select("size", "ratio")
    judged, rows = scratch.cut_rows(judged)
    count = min(MOST_CLASSES, rows // CLASS_ROWS)
    if count < 2:
        return wide
    sizes = [rows // count + (c < rows % count) for c in range(count)]
    ends = np.cumsum(sizes)
    whole = judged.withColumn("_all", F.lit(0))
    numbered = number_rows(whole, "_all", "size", "ratio")
    before = [(F.col("num") > int(end)).cast("int") for end in ends[:-1]]
    classed = scratch.cut(numbered.select("size", "ratio", sum(before, F.lit(0)).alias("_class")))
    logs = classed.select("_class", F.log("size").alias("log"))
    middle = np.array([m for (m,) in _quantiles(logs, "log", sizes, [0.5])])
    middle, firsts = np.unique(middle, return_index=True)
    lasts = [*firsts[1:], count]
    names = [c for c, (a, b) in enumerate(zip(firsts, lasts)) for _ in range(a, b)]
    sizes = [sum(sizes[a:b]) for a, b in zip(firsts, lasts)]
    named = F.get(F.array(*map(F.lit, names)), F.col("_class")).alias("_class")
    classed = classed.select("size", "ratio", named)
    centre = np.array([m for (m,) in _quantiles(classed, "ratio", sizes, [0.5])])

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            logs = np.log(part.column(0).to_numpy(zero_copy_only=False).astype(float))
            away = part.column(1).to_numpy(zero_copy_only=False) - np.interp(logs, middle, centre)
            yield pa.record_batch([part.column(2), pa.array(away)], names=["_class", "away"])

    away = classed.mapInArrow(distance, "_class int, away double")
    limits = _quantiles(away, "away", sizes, [TAIL, 1 - TAIL])
    bands = [
        (float(size), float(typical + low * (1 + MARGIN)), float(typical + high * (1 + MARGIN)))
        for (low, high), size, typical in zip(limits, np.exp(middle), centre)
    ]
    first, last = bands[0], bands[-1]
    beyond = []
    for end, keep in ((first, lambda n: n < first[0]), (last, lambda n: n > last[0])):
        by = [end[i + 1] - limit for i, limit in enumerate(wide.limits(end[0]))]
        beyond.append([(n, a + by[0], b + by[1]) for n, a, b in wide.rows if keep(n)])
    return replace(wide, rows=(*beyond[0], *bands, *beyond[1]))


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * np.int64(len(names)) + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def _dup_lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            if line in seen:
                again += 1
            seen.add(line)
    return again


def measure(text: str | None, compressor, bands: Bands) -> tuple:
    """The values of ``COLUMNS``; null and empty texts count nothing and are in band."""
    if not text:
        return 0, 0, 0, 0, 0, None, 0, 0, True
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    ratio = len(data) / len(compressor.compress(data))
    chunks = bad = 0
    if len(data) > bands.chunk_bytes:
        for at in range(0, len(data), bands.chunk_bytes):
            chunk = data[at : at + bands.chunk_bytes]
            chunks += 1
            bad += not bands.fits(len(chunk), len(chunk) / len(compressor.compress(chunk)))
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        _dup_lines(text),
        _repeat_words(words),
        ratio,
        chunks,
        bad,
        bands.fits(len(data), ratio) and bad <= bands.max_bad_chunks * chunks,
    )


def learnable(labels: DataFrame) -> DataFrame:
    """``_id`` of the good texts that may be learned from, once each.

    Ids whose crc32 as text leaves 1 when divided by 3 are held out; an id that any
    label calls bad is not good.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality").filter(
        "_id is not null and quality in (0, 1)"
    )
    known = known.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1)
    return known.groupBy("_id").agg(F.min("quality").alias("_good")).filter("_good = 1").select("_id")


def fit(docs: DataFrame, good: DataFrame, wide: Bands = Bands()) -> Bands:
    """The bands learned from all documents named in ``good`` (``_id``).

    Every text is compressed where it lies; only ids, sizes and ratios are shuffled, and
    rows that are alike in the three count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for part in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            sizes = [len(t) for t in texts]
            ratios = [len(t) / len(compressor.compress(t)) for t in texts]
            yield pa.record_batch(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(ratios, pa.float64())],
                names=["_id", "size", "ratio"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").filter("_id is not null")
    measured = texts.mapInArrow(run, "_id long, size long, ratio double")
    return learned(measured.join(good, "_id", "left_semi").dropDuplicates(), wide)


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``doc_id`` and ``COLUMNS`` of every row; nothing is shuffled.

    Null ids and repeated rows stay as they are; columns beside id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for part in slices(batches):
            rows = [measure(t, compressor, bands) for t in part.column(1).to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.record_batch([part.column(0), *columns], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def good_rows(docs: DataFrame, bands: Bands, max_repeated: int) -> DataFrame:
    """The rows in band with at most ``max_repeated`` of a hundred words repeated."""

    def fits():
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def judge(texts: list) -> list[bool]:
            found = [measure(text, compressor, bands) for text in texts]
            return [m[-1] and 100 * m[4] <= max_repeated * m[0] for m in found]

        return judge

    return rows_where(docs, ["text"], fits)
