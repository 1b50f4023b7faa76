"""Small helpers shared by the operators: words, hashes, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handled at once inside a task; one batch of Arrow rows can be far larger.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def rows_where(docs: DataFrame, names: list[str], fits: Callable) -> DataFrame:
    """The rows of ``docs`` that ``fits``, as they are; nothing is shuffled.

    ``fits`` is made once a task: ``fits()(values of the first name, ...)`` gives a list
    of booleans.
    """
    at = [docs.columns.index(name) for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = fits()
        for part in slices(batches):
            stays = judge(*[part.column(i).to_pylist() for i in at])
            yield part.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8; none for null.

    ``bytes.split`` parts at exactly these six ASCII characters.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of many texts at once, the same in every process.

    A word's hash is a polynomial of random numbers for its bytes, taken from a running
    sum over the whole input and mixed with its length. ``fold`` counts A-Z as a-z.
    """

    #: Bytes hashed at once; only a longer word makes more.
    STEP = 1 << 18
    _BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64

    def __init__(self, fold: bool = False, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.numbers = rng.integers(1, 2**63, 256, dtype=np.uint64)
        if fold:
            self.numbers[65:91] = self.numbers[97:123]
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self._powers(self.STEP)

    def _powers(self, n: int) -> None:
        self.up, self.down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
        self.up[1:] = self._BASE
        self.down[1:] = pow(self._BASE, -1, 1 << 64)
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)

    def hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(hash, first byte)`` of every word in UTF-8 bytes."""
        space = self.space[data]
        found, places, at = [], [], 0
        while at < len(data):
            end = at + self.STEP
            if end < len(data) and not space[end]:
                gaps = np.flatnonzero(space[at:end])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # one word longer than a step
                    more = np.flatnonzero(space[end:])
                    end = end + int(more[0]) if len(more) else len(data)
            own, blank = data[at:end], space[at:end]
            if len(own) > len(self.up) - 1:
                self._powers(2 * len(own))
            edges = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
            starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(self.numbers[own] * self.up[: len(own)], out=sums[1:])
            value = (sums[ends] - sums[starts]) * self.down[starts]
            found.append(mix64(value + (ends - starts).astype(np.uint64)))
            places.append(starts + at)
            at = end
        if not found:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(found), np.concatenate(places)

    def of_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The word hashes of each text; none for null."""
        coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ends = np.cumsum([len(t) + 1 for t in coded])
        values, places = self.hashes(np.frombuffer(b"\n".join([*coded, b""]), np.uint8))
        return np.split(values, np.searchsorted(places, ends[:-1]))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of ``size`` consecutive word hashes.

    Windows are put together from windows of 1, 2, 4, ... words.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, covered, length, own = None, 0, 1, hashes
    while covered < size:
        if size & length:
            part = own[covered : covered + n]
            total = part.copy() if total is None else total * _factor(length) + part
            covered += length
        if 2 * length <= size:
            own = own[:-length] * _factor(length) + own[length:]
        length *= 2
    return mix64(total + np.uint64(size))


def _factor(words: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, words, 1 << 64))
