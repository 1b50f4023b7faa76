"""Repeated passages removed: windows of words that start in an earlier document too.

1. *Count-min prefilter.* Every partition counts its windows in a sketch of ``DEPTH``
   rows of counters that stop at 2, as more is not needed to call a window repeated.
   Sketches are sent as gaps between counters in use, cut into sections, and each
   section is merged in a task of its own. Counters only overestimate, so no repeated
   window is lost.
2. *Exact grouping* of the windows estimated repeated. A task already settles what it
   sees itself: of the documents that hold a window, all but the smallest repeat it. So
   each task sends a window on for one document only, however many hold it, and the
   rows of one window are at most one for each task that meets it.
3. The documents that are not the smallest of a window get the places of the words it
   covers, and the texts are joined with these places once.

The width of the sketch follows the length of all texts up to ``MAX_BITS``, which bounds
what is broadcast (``DEPTH`` bits for each counter, 64 MiB at most). Beyond that more
windows pass the filter and the result stays the same. Windows are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.common import WordHasher, mix64, slices, window_hashes, words_of
from ontomill.sources.scratch import Scratch

DEPTH = 2
MIN_BITS, MAX_BITS = 16, 28
#: Counters in one section of a sketch row, as a power of two.
SECTION_BITS = 18
#: Characters of text for each word, to estimate the number of windows.
CHARS_PER_WORD = 6
#: Windows that a task takes together.
CHUNK_WINDOWS = 600_000


@lru_cache(maxsize=1)
def _hasher() -> WordHasher:
    return WordHasher()


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each window in one row of the sketch."""
    own = hashes if row == 0 else mix64(hashes + np.uint64(row))
    return (own >> np.uint64(64 - bits)).astype(np.uint32)


def pack_gaps(places: np.ndarray) -> bytes:
    """Sorted distinct places as gaps in bytes; 255 stands for "255 and more follows"."""
    gaps = np.diff(places.astype(np.int64), prepend=0)
    counts = gaps // 255 + 1
    out = np.full(int(counts.sum()), 255, np.uint8)
    out[np.cumsum(counts) - 1] = gaps % 255
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def _chunks(
    batches: Iterator[pa.RecordBatch], size: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of many documents at a time: hash, document, place of the first word."""
    hashes, docs, places, n = [], [], [], 0
    for part in slices(batches):
        found = _hasher().of_texts(part.column(1).to_pylist())
        for doc, words in zip(part.column(0).to_pylist(), found):
            if doc is None or len(words) < size:
                continue
            own = window_hashes(words, size)
            hashes.append(own)
            docs.append(np.full(len(own), doc, np.int64))
            places.append(np.arange(len(own), dtype=np.int32))
            n += len(own)
            if n >= CHUNK_WINDOWS:
                yield np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
                hashes, docs, places, n = [], [], [], 0
    if n:
        yield np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)


def _sketches(size: int, bits: int):
    """Sections of partition sketches: counters at 1 or more, and those at 2 or more."""
    section_bits = min(SECTION_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, _ in _chunks(batches, size):
            for row in range(DEPTH):
                cells, counts = np.unique(_cells(hashes, row, bits), return_counts=True)
                again = cells[counts > 1]
                edges = np.arange(0, (1 << bits) + 1, 1 << section_bits, dtype=np.int64)
                starts, starts2 = np.searchsorted(cells, edges), np.searchsorted(again, edges)
                names, once, twice = [], [], []
                for k in np.flatnonzero(np.diff(starts)):
                    base = np.int64(edges[k])
                    names.append((row << 32) + int(k))
                    once.append(pack_gaps(cells[starts[k] : starts[k + 1]] - base))
                    twice.append(pack_gaps(again[starts2[k] : starts2[k + 1]] - base))
                yield pa.record_batch(
                    [pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                    names=["section", "once", "twice"],
                )

    return run


def _merge_sections(width: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(width, bool), np.zeros(width, bool)
        for once, twice in zip(group["once"], group["twice"]):
            places = unpack_gaps(once)
            again[places[seen[places]]] = True
            seen[places] = True
            again[unpack_gaps(twice)] = True
        packed = np.packbits(again, bitorder="little").tobytes()
        return pd.DataFrame({"section": group["section"].iloc[:1], "repeated": [packed]})

    return run


def sketch(docs: DataFrame, size: int, bits: int) -> list[bytes]:
    """For each row of the merged sketch a bit for every counter that reached 2.

    ``DEPTH * 2**bits`` bits come to the driver, a bound that no input exceeds.
    """
    section_bits = min(SECTION_BITS, bits)
    sections = (
        docs.mapInArrow(_sketches(size, bits), "section long, once binary, twice binary")
        .groupBy("section")
        .applyInPandas(_merge_sections(1 << section_bits), "section long, repeated binary")
    )
    rows = [bytearray(1 << (bits - 3)) for _ in range(DEPTH)]
    step = 1 << (section_bits - 3)
    for found in sections.toLocalIterator():
        row, k = found["section"] >> 32, found["section"] & 0xFFFFFFFF
        rows[row][k * step : (k + 1) * step] = found["repeated"]
    return [bytes(row) for row in rows]


def _repeated(hashes: np.ndarray, merged: list[bytes], bits: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for row, data in enumerate(merged):
        cells = _cells(hashes, row, bits)
        own = np.frombuffer(data, np.uint8)[cells >> np.uint32(3)]
        out &= (own >> (cells & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return out


def _by_doc(docs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else []
    for at, end in zip(starts, [*starts[1:], len(docs)]):
        yield int(docs[at]), pack_gaps(np.unique(places[at:end]))


_FIRST = "window long, doc long, place int, places binary"


def _settled_and_open(size: int, bits: int, merged: Broadcast):
    """Rows for windows estimated repeated: open ones, and places that are settled.

    Open: ``window, doc, place`` for the smallest document of the task with the window.
    Settled: ``doc, places`` of the others, under a window that only spreads the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, docs, places in _chunks(batches, size):
            keep = _repeated(hashes, merged.value, bits)
            hashes, docs, places = hashes[keep], docs[keep], places[keep]
            if not len(hashes):
                continue
            order = np.lexsort((docs, hashes))
            hashes, docs, places = hashes[order], docs[order], places[order]
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            least = docs[first][np.cumsum(first) - 1]
            later = docs > least
            yield pa.record_batch(
                [
                    pa.array(hashes[~later].view(np.int64)),
                    pa.array(docs[~later]),
                    pa.array(places[~later]),
                    pa.nulls(int((~later).sum()), pa.binary()),
                ],
                names=["window", "doc", "place", "places"],
            )
            settled = list(_by_doc(docs[later], places[later]))
            if settled:
                owners = np.array([doc for doc, _ in settled], np.int64)
                yield pa.record_batch(
                    [
                        pa.array(mix64(owners.view(np.uint64)).view(np.int64)),
                        pa.array(owners),
                        pa.nulls(len(settled), pa.int32()),
                        pa.array([data for _, data in settled], pa.binary()),
                    ],
                    names=["window", "doc", "place", "places"],
                )

    return run


def _group_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window and document: the places of all but the smallest document."""
    window, least = None, None
    for batch in batches:
        settled = batch.filter(pa.compute.is_valid(batch.column(3)))
        if settled.num_rows:
            yield settled.select(["doc", "place", "places"])
        rows = batch.filter(pa.compute.is_null(batch.column(3)))
        if not rows.num_rows:
            continue
        windows, docs, places = (rows.column(i).to_numpy() for i in range(3))
        first = np.concatenate([[True], windows[1:] != windows[:-1]])
        head = docs[first]
        if window is not None and windows[0] == window:
            head[0] = least
        smallest = head[np.cumsum(first) - 1]
        window, least = windows[-1], smallest[-1]
        later = docs > smallest
        yield pa.record_batch(
            [
                pa.array(docs[later]),
                pa.array(places[later]),
                pa.nulls(int(later.sum()), pa.binary()),
            ],
            names=["doc", "place", "places"],
        )


def repeated_places(docs: DataFrame, size: int) -> DataFrame:
    """``(doc, place, places)``: where repeated windows start, one by one or packed."""
    length = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = math.ceil(math.log2(2 * length / CHARS_PER_WORD + 1)) if length else 0
    bits = min(MAX_BITS, max(MIN_BITS, bits))
    merged = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, bits))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        docs.mapInArrow(_settled_and_open(size, bits, merged), _FIRST)
        .repartition(parts, "window")
        .sortWithinPartitions("window", "doc")
        .mapInArrow(_group_windows, "doc long, place int, places binary")
    )


def _removal(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n_words, n_removed, kept = [], [], []
            texts, packed = part.column(1).to_pylist(), part.column(3).to_pylist()
            for text, single, parts in zip(texts, part.column(2), packed):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int32)
                alone = [single.values.to_numpy()] if single.is_valid else []
                for places in (*alone, *map(unpack_gaps, parts or ())):
                    places = places[places + size <= len(words)]
                    np.add.at(gone, places, 1)
                    np.add.at(gone, places + size, -1)
                stays = np.cumsum(gone[:-1]) == 0
                n_words.append(len(words))
                n_removed.append(int((~stays).sum()))
                left = words if stays.all() else [words[i] for i in np.flatnonzero(stays)]
                kept.append(b" ".join(left).decode())
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return run


def remove_repeated(docs: DataFrame, size: int = 13) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``: what is left of every text.

    A word goes if it lies in a window of ``size`` words that also starts in a document
    with a smaller id. ``text`` is the other words joined by one space; it is empty for
    null and empty texts. Texts are judged as they came, not by what is left of them.
    Rows with a null id lose nothing and take nothing from others. Rows that share an id
    are one document: a repeated row stays and loses the same words; if their texts
    differ, places found in one hold for all. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession)
    found = scratch.cut(repeated_places(own, size))
    gathered = found.groupBy("doc").agg(
        F.collect_list("place").alias("single"), F.collect_list("places").alias("packed")
    )
    return (
        own.join(gathered.withColumnRenamed("doc", "_doc"), F.col("doc_id") == F.col("_doc"), "left")
        .select("doc_id", "text", "single", "packed")
        .mapInArrow(_removal(size), "doc_id long, n_words long, n_removed long, text string")
    )
