"""Best-fit packing of tokenised documents into sequences of a fixed length.

**Pieces.** A document is its token ids and an end id; only documents longer than a
sequence are cut, into full pieces and a last one.

**Hierarchical residual packing.** Every input partition packs its own pieces by
best-fit decreasing: the longest piece first, into the fullest bin that takes it. Bins
that are nearly full are done. The others go up a tree: the bins of ``FAN_IN``
partitions meet in one task and are packed again by best-fit decreasing, now whole
bins as items, until one group is left. After best-fit no two bins of a task fit
together, so all but one are more than half full and a merge can save at most one bin
for each task below it: only the ``CARRIED`` emptiest bins of a task go up, which
bounds every task above; the rest are emitted as they are. No piece is lost or cut by
this, and a level moves bin rows (ids and sizes), never pieces or tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.common import slices
from ontomill.sources.scratch import Scratch

#: A bin with this share of its room used is not touched again.
NEARLY_FULL = 0.995
#: Tasks whose open bins meet in one task of the next level.
FAN_IN = 16
#: Open bins that one task hands to the next level at most.
CARRIED = 2_048
#: Chunks of text whose ids a worker keeps.
MAX_CHUNKS = 600_000
#: Chunks that go to the tokenizer in one call.
CALL_CHUNKS = 2_000
#: Longer chunks are not kept.
MAX_CHUNK_BYTES = 64
#: UTF-8 of letters that the tokenizer neither parts nor composes, and marks it parts from them.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Words(dict):
    """Chunk without ASCII white space -> its ids as little-endian uint32 bytes.

    The tokenizer drops white space and lets no token reach over it, so the ids of a
    text are those of its chunks. The library lower-cases and normalises each chunk.
    A plain chunk is a word with marks after it. These are encoded apart, and a word once
    for all its marks and capitals; its last token is one that ends words.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; chunks not seen before go to the tokenizer many at a time."""
        if len(self) > 2 * MAX_CHUNKS // 3:
            self.clear()
        if len(self.plain) > MAX_CHUNKS // 3:
            self.plain.clear()
        split = [text.encode().split() if text else [] for text in texts]
        unseen = list(set().union(*split) - self.keys())
        chunks, words, others = [], [], []
        for chunk in unseen:
            word = chunk.rstrip(MARKS)
            if word.isalpha() or LETTERS.fullmatch(word):
                chunks.append(chunk)
                words.append(word.lower())
            else:
                others.append(chunk)
        new = list(set(words) - self.plain.keys())
        for at in range(0, len(new), CALL_CHUNKS):
            self._learn_plain(new[at : at + CALL_CHUNKS])
        marks = {chunk[len(word) :] for chunk, word in zip(chunks, words)} - self.keys()
        marks = list(marks.difference(others, [b""]))
        others += marks
        for at in range(0, len(others), CALL_CHUNKS):
            self._learn(others[at : at + CALL_CHUNKS])
        self[b""] = b""
        for chunk, word in zip(chunks, words):
            self[chunk] = self.plain[word] + self[chunk[len(word) :]]
        joined = [b"".join(map(self.__getitem__, chunks)) for chunks in split]
        for chunk in [*unseen, *marks]:
            if len(chunk) > MAX_CHUNK_BYTES:
                self.pop(chunk, None)
        for word in new:
            if len(word) > MAX_CHUNK_BYTES:
                del self.plain[word]
        return joined

    def _learn_plain(self, words: list[bytes]) -> None:
        """Encode plain words as one text; each ends where a token that ends words does."""
        found = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(found[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ending[ids]) + 1)).tolist()
        if len(cuts) != len(words):  # the vocabulary lacks an ending; ask for each alone
            for word in words:
                alone = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
                self.plain[word] = np.array(alone, "<u4").tobytes()
            return
        data, low = ids.tobytes(), 0
        for word, high in zip(words, cuts):
            self.plain[word] = data[low:high]
            low = high

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks as one text; a token belongs to the chunk it begins in."""
        written = [chunk.decode() for chunk in chunks]
        found = self.tokenizer.encode(" ".join(written), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        begins = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(found))
        if len(chunks) > 1 and (np.diff(begins) < 0).any():
            for chunk in chunks:  # the tokenizer moved characters; ask for each alone
                self._learn([chunk])
            return
        ends = np.cumsum([len(chunk) + 1 for chunk in written])
        ends[-1] = np.iinfo(np.int64).max
        cuts = (4 * np.searchsorted(begins, ends)).tolist()
        low = 0
        for chunk, high in zip(chunks, cuts):
            self[chunk] = ids[low:high]
            low = high


@lru_cache(maxsize=4)
def words_tokenizer(path: str) -> _Words:
    return _Words(path)


def pieces(docs: DataFrame, path: str, room: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document.

    A null or empty text is the end id alone. Rows with a null id keep it; repeated rows
    are packed each. ``with_ids`` adds the token ids themselves as array<int>.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = words_tokenizer(path)
        for part in slices(batches):
            rows: list[tuple] = []
            coded = tokenizer.encode_all(part.column(1).to_pylist())
            for doc, ids in zip(part.column(0).to_pylist(), coded):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    own = ids[at : at + 4 * room]
                    row = (doc, k, at // 4, len(own) // 4, zlib.crc32(own))
                    rows.append((*row, np.frombuffer(own, "<i4")) if with_ids else row)
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)]
            )

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing of ``sizes``: the bin of each item, and its offset there.

    Bins with the same room left are equal; the one used last is taken. A bit set of the
    remaining rooms finds the tightest bin in one step.
    """
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    rooms, used = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            own = by_room[left].pop()
            if not by_room[left]:
                rooms &= ~(1 << left)
        else:
            left, own, used = room, used, used + 1
        bins[i], offsets[i] = own, room - left
        if left - size:
            by_room[left - size].append(own)
            rooms |= 1 << (left - size)
    return bins, offsets


def _open_bins(fill: np.ndarray, room: int) -> np.ndarray:
    """Which bins go up: not nearly full, the emptiest first, ``CARRIED`` at most."""
    going = np.flatnonzero(fill < NEARLY_FULL * room)
    if len(going) > CARRIED:
        going = going[np.argsort(fill[going], kind="stable")[:CARRIED]]
    mask = np.zeros(len(fill), bool)
    mask[going] = True
    return mask


def _pack_partition(room: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)  # a few numbers for each piece of one partition
        if not frames or not sum(map(len, frames)):
            return
        own = pd.concat(frames, ignore_index=True)
        bins, own["_offset"] = best_fit(own["length"].to_numpy(), room)
        task = TaskContext.get().partitionId()
        fill = np.bincount(bins, weights=own["length"]).astype(np.int64)
        own["_bin"] = (np.int64(task) << 32) + bins
        own["_fill"] = fill[bins]
        own["_open"] = _open_bins(fill, room)[bins]
        yield own

    return run


def _pack_group(room: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_top", "_base", "_bin"], ignore_index=True)
        tops, first, inverse = np.unique(
            group["_top"].to_numpy(), return_index=True, return_inverse=True
        )
        bins, offsets = best_fit(group["_size"].to_numpy()[first], room)
        names = np.full(bins.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(names, bins, tops)
        fill = np.bincount(bins, weights=group["_size"].to_numpy()[first]).astype(np.int64)
        going = _open_bins(fill, room)
        mine = bins[inverse]
        return pd.DataFrame(
            {
                "_bin": group["_bin"],
                "_base": group["_base"] + offsets[inverse],
                "_top": names[mine],
                "_size": fill[mine],
                "_group": group["_group"] // FAN_IN,
                "_open": going[mine],
            }
        )

    return run


_TREE = "_bin long, _base long, _top long, _size long, _group long, _open boolean"


def pack(items: DataFrame, room: int) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: gapless places in few sequences.

    ``items`` has a column ``length`` (1 to ``room``) beside others, none of which may
    start with an underscore or be called like the new ones.
    """
    scratch = Scratch(items.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    local = scratch.cut(
        items.mapInPandas(
            _pack_partition(room),
            f"{fields}, _offset long, _bin long, _fill long, _open boolean",
        )
    )
    levels = []
    going = (
        local.filter("_open")
        .groupBy("_bin")
        .agg(F.max("_fill").alias("_size"))
        .select(
            "_bin",
            F.lit(0).cast("long").alias("_base"),
            F.col("_bin").alias("_top"),
            "_size",
            (F.shiftright("_bin", 32) / FAN_IN).cast("long").alias("_group"),
        )
    )
    top = going.agg(F.max("_group")).first()[0]
    while top is not None:
        level = scratch.cut(going.groupBy("_group").applyInPandas(_pack_group(room), _TREE))
        if top == 0:
            levels.append(level)
            break
        levels.append(level.filter(~F.col("_open")))
        going = level.filter("_open").drop("_open")
        top //= FAN_IN
    named = items.columns
    if not levels:
        return local.select(
            *named, F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset")
        )
    moved = levels[0]
    for level in levels[1:]:
        moved = moved.unionByName(level)
    return local.join(moved.select("_bin", "_base", "_top"), "_bin", "left").select(
        *named,
        F.coalesce("_top", "_bin").alias("sequence_id"),
        (F.col("_offset") + F.coalesce("_base", F.lit(0))).alias("offset"),
    )


def sequences(docs: DataFrame, path: str, room: int, end_id: int) -> DataFrame:
    """``(sequence_id, ids)``: the packed token ids themselves.

    A sequence holds at most ``room`` tokens, so its group is bounded.
    """
    packed = pack(pieces(docs, path, room, end_id, with_ids=True), room)
    return packed.groupBy("sequence_id").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
        ).alias("ids")
    )
