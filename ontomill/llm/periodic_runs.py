"""Stretches of words that repeat with a period, found on a grammar of the texts.

The word ids of a batch of texts are compressed by Re-Pair: pairs of neighbouring symbols
that occur more than once become nonterminals until no pair repeats. A round replaces
many pairs at once, namely those more frequent than the pairs they overlap with (ties go
by a hash of the pair), so there are few rounds and every step works on whole arrays.

A run has a lowest node of the derivation that covers it, a nonterminal or the text
itself, and crosses a boundary between two children there. So the runs that cross a
boundary are worked out once for each nonterminal, in the expansion of one occurrence,
and once for each boundary between the symbols that are left of a text. They are then
carried to all places where the nonterminal was put in; of runs with the same period, those
inside a longer one are dropped, and the maximal runs of the texts are left.

Runs that cross a boundary: a run of period q that is ``4 q`` long reaches ``2 q`` to one
side of the boundary, so the window of W words beginning or ending there, W the power of two
with W/2 < q <= W, lies in it and comes again at a distance of exactly q (a window as
long as the period recurs at multiples of it only). Windows get names by doubling, which
compare exactly, and only windows that recur in their text go on to the next length. The
same names give the length to which two places agree, hence how far the run reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.common import mix64

#: Characters of text handled at once; only a longer text makes more.
BATCH_CHARS = 1 << 20
LEAST_WORDS, LEAST_PERIODS = 6, 4


# ---- the grammar ----


@dataclass
class Grammar:
    """Nonterminals of a batch, and the symbols that are left of its texts.

    ``begin``, ``middle`` and ``end`` place one occurrence of each nonterminal's expansion
    and the boundary within it; the places of all occurrences of nonterminal i are
    ``places[first[i] : first[i + 1]]``. ``root`` holds where the symbols that are left begin,
    ``symbols`` which they are. A pair that lost a round to its neighbours may get a second
    nonterminal later; this costs space only.
    """

    begin: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    first: np.ndarray
    places: np.ndarray
    root: np.ndarray
    symbols: np.ndarray


def repair(words: np.ndarray, text_of: np.ndarray) -> Grammar:
    """Compress the word ids of many texts into one grammar; no pair spans two texts."""
    n = len(words)
    symbols = words.astype(np.int64)
    at = np.arange(n, dtype=np.int64)
    after = at + 1  # where each symbol's expansion ends
    fresh = int(words.max()) + 1 if n else 0
    # Pairs that occur once stay so; only the others are looked at again.
    open_ = np.flatnonzero(text_of[:-1] == text_of[1:]) if n else np.empty(0, np.int64)
    begin, middle, end, sizes, places = [], [], [], [], []
    while len(open_):
        left, right = symbols[open_], symbols[open_ + 1]
        keys = (left << 31) | right
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        kind = np.empty(len(keys), np.int64)
        kind[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
        # In a chain like a a a a every other pair counts, so that none overlap.
        chain = (left == right) & np.concatenate([[False], (open_[1:] == open_[:-1] + 1) & (keys[1:] == keys[:-1])])
        starts = np.maximum.accumulate(np.where(chain, 0, np.arange(len(keys))))
        usable = (np.arange(len(keys)) - starts) % 2 == 0
        counts = np.bincount(kind[usable], minlength=len(heads))
        repeated = usable & (counts[kind] > 1)
        pairs = np.flatnonzero(repeated)
        if not len(pairs):
            break
        # A pair is put in where neither pair that shares a symbol with it ranks higher.
        best = np.lexsort((mix64(ranked[heads].astype(np.uint64)), counts))
        rank = np.empty(len(heads), np.int64)
        rank[best] = np.arange(len(heads))
        mine, spot = rank[kind[pairs]], open_[pairs]
        joined = spot[1:] == spot[:-1] + 1
        wins = np.ones(len(pairs), bool)
        wins[1:] &= ~joined | (mine[1:] > mine[:-1])
        wins[:-1] &= ~joined | (mine[:-1] > mine[1:])
        chosen = pairs[wins]
        taken = np.bincount(kind[chosen], minlength=len(heads))
        chosen = chosen[taken[kind[chosen]] > 1]  # the highest rank is always among them
        # Replace them.
        kinds, first, number = np.unique(kind[chosen], return_index=True, return_inverse=True)
        spots = open_[chosen]
        by_kind = np.argsort(number, kind="stable")
        begin.append(at[spots[first]])
        middle.append(at[spots[first] + 1])
        end.append(after[spots[first] + 1])
        sizes.append(np.bincount(number, minlength=len(kinds)))
        places.append(at[spots[by_kind]])
        symbols[spots] = fresh + number
        after[spots] = after[spots + 1]
        fresh += len(kinds)
        stays = np.ones(len(symbols), bool)
        stays[spots + 1] = False
        # A pair may come to repeat if it does so now or holds a new symbol.
        look = np.zeros(len(symbols) + 1, bool)
        look[open_[counts[kind] > 1]] = True
        look[spots] = True
        look[np.maximum(spots - 1, 0)] = True
        look, symbols, at, after = look[:-1][stays], symbols[stays], at[stays], after[stays]
        look[-1] = False
        look[:-1] &= text_of[at[:-1]] == text_of[at[1:]]
        open_ = np.flatnonzero(look)

    def joined_up(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    first = np.concatenate([[0], np.cumsum(joined_up(sizes))]).astype(np.int64)
    return Grammar(
        joined_up(begin), joined_up(middle), joined_up(end), first, joined_up(places), at, symbols
    )


# ---- windows ----


class Names:
    """Names of the windows of 1, 2, 4, ... words that recur in their text.

    ``level[k][t]`` names the window of ``2**k`` words that begins at word t; two windows are
    the same words of the same text if and only if their names are equal. Windows that occur
    once are named -1.
    """

    def __init__(self, words: np.ndarray, text_of: np.ndarray, boundaries: np.ndarray):
        """``boundaries`` marks the places ``near`` is asked for."""
        self.level: list[np.ndarray] = []
        self.boundaries = boundaries
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(words)
        self.n = n
        if not n:
            return
        alive = np.arange(n)
        keys = text_of.astype(np.int64) * (int(words.max()) + 1) + words
        size = 1
        while len(alive):
            order = np.argsort(keys, kind="stable")  # places ascend within a key
            keys, places = keys[order], alive[order]
            same = keys[1:] == keys[:-1]
            more = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            names = np.full(n, -1, np.int64)
            names[places] = np.cumsum(np.concatenate([[True], ~same])) - 1
            names[places[~more]] = -1
            self.level.append(names)
            self._recurring(places, same, size)
            alive = np.sort(places[more])
            alive = alive[alive + size < n]
            alive = alive[names[alive + size] >= 0]
            alive = alive[text_of[alive] == text_of[alive + size]]
            keys = names[alive] * n + names[alive + size]
            size *= 2

    def _recurring(self, places: np.ndarray, same: np.ndarray, size: int) -> None:
        """Note the windows at a boundary that come again ``q`` words on, size/2 < q <= size,
        as ``(boundary, earlier place, q)``; the window begins or ends at the boundary."""
        earlier, later = places[:-1][same], places[1:][same]
        q = later - earlier
        fits = (2 * q > size) & (q <= size)
        earlier, later, q = earlier[fits], later[fits], q[fits]
        for at in (earlier, later, earlier + size, later + size):
            on = np.flatnonzero(self.boundaries[np.minimum(at, self.n)])
            if len(on):
                self.found.append((at[on], earlier[on], q[on]))

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All that was noted, without repeats."""
        if not self.found:
            none = np.empty(0, np.int64)
            return none, none, none
        rows = np.unique(np.column_stack([np.concatenate(c) for c in zip(*self.found)]), axis=0)
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def onward(self, x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For how many words from ``x`` and ``y`` on the texts agree, ``y`` not beyond ``end``."""
        length = np.zeros(len(x), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            fits = y + length + (1 << k) <= end
            a = self.level[k][np.where(fits, x + length, 0)]
            b = self.level[k][np.where(fits, y + length, 0)]
            length += (fits & (a >= 0) & (a == b)) * (1 << k)
        return length

    def backward(self, x: np.ndarray, y: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For how many words before ``x`` and ``y`` the texts agree, ``x`` not before ``begin``."""
        length = np.zeros(len(x), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            fits = x - length - (1 << k) >= begin
            a = self.level[k][np.where(fits, x - length - (1 << k), 0)]
            b = self.level[k][np.where(fits, y - length - (1 << k), 0)]
            length += (fits & (a >= 0) & (a == b)) * (1 << k)
        return length


# ---- runs ----


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of the runs of all texts, by start, then period.

    ``words`` are the word ids of the texts one after the other, text t those from
    ``bounds[t]`` to ``bounds[t + 1]``; starts are places in ``words``.
    """
    none = np.empty(0, np.int64)
    if not len(words):
        return none, none, none
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grammar = repair(words, text_of)
    # Boundaries: of nonterminals long enough to hold a run, and between the symbols left.
    long = np.flatnonzero(grammar.end - grammar.begin >= LEAST_WORDS)
    inner = grammar.root[1:][text_of[grammar.root[1:]] == text_of[grammar.root[:-1]]]
    begin = np.concatenate([grammar.begin[long], bounds[text_of[inner]]])
    middle = np.concatenate([grammar.middle[long], inner])
    end = np.concatenate([grammar.end[long], bounds[text_of[inner] + 1]])
    marked = np.zeros(len(words) + 1, bool)
    marked[middle] = True
    names = Names(words, text_of, marked)
    place, x, q = names.near()
    # The boundaries at each place: several nonterminals may be shown by the same words.
    order = np.argsort(middle, kind="stable")
    low = np.searchsorted(middle[order], place, "left")
    high = np.searchsorted(middle[order], place, "right")
    repeat = high - low
    which = order[np.repeat(low, repeat) + _counting(repeat)]
    x, q = np.repeat(x, repeat), np.repeat(q, repeat)
    inside = (x >= begin[which]) & (x + q < end[which])
    which, x, q = which[inside], x[inside], q[inside]
    start = x - names.backward(x, x + q, begin[which])
    stop = x + q + names.onward(x, x + q, end[which])
    holds = (stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)) & (start < middle[which])
    holds &= middle[which] < stop
    which, start, stop, q = which[holds], start[holds], stop[holds], q[holds]
    # To every place where the nonterminal was put in.
    is_rule = which < len(long)
    rule = long[which[is_rule]]
    copies = grammar.first[rule + 1] - grammar.first[rule]
    moved = grammar.places[np.repeat(grammar.first[rule], copies) + _counting(copies)]
    moved = moved - np.repeat(grammar.begin[rule], copies)
    starts = np.concatenate([start[~is_rule], np.repeat(start[is_rule], copies) + moved])
    stops = np.concatenate([stop[~is_rule], np.repeat(stop[is_rule], copies) + moved])
    periods = np.concatenate([q[~is_rule], np.repeat(q[is_rule], copies)])
    return _maximal(starts, stops, periods, len(words))


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _maximal(starts, stops, periods, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drop what lies within another stretch of the same period."""
    order = np.lexsort((-stops, starts, periods))
    starts, stops, periods = starts[order], stops[order], periods[order]
    reach = periods * (n + 1) + stops  # stretches of a smaller period reach less far
    before = np.concatenate([[-1], np.maximum.accumulate(reach)[:-1]])
    keep = reach > before
    starts, stops, periods = starts[keep], stops[keep], periods[keep]
    order = np.lexsort((periods, starts))
    return starts[order], (stops - starts)[order], periods[order]


def dropped(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts + periods, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:-1]) > 0


# ---- texts ----

_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def _split(texts: pa.Array) -> pa.ListArray:
    """The words of each text, parted at the six ASCII white-space characters."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = kept[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(full))


def _collapse(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """``(number of words, runs, text without the repeats)`` of each text."""
    lists = _split(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts, lengths, periods = find_runs(words, bounds)
    keep = ~dropped(len(words), starts, lengths, periods)
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    rest = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(keep)))
    text_of = np.searchsorted(bounds, starts, "right") - 1
    offsets = np.searchsorted(starts, bounds)
    runs = pa.StructArray.from_arrays(
        [pa.array(starts - bounds[text_of]), pa.array(lengths), pa.array(periods)],
        fields=list(_RUNS.value_type),
    )
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)
    return pa.array(np.diff(bounds)), runs, pc.binary_join(rest, " ")


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in portions of about ``BATCH_CHARS`` bytes of text, in the second column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        portion = np.cumsum(sizes.astype(np.int64)) // BATCH_CHARS
        edges = np.flatnonzero(np.diff(portion)) + 1
        edges = [0, *edges.tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, text)``: the periodic runs of every whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with
    smallest period q, at least 6 words and 4 q long, that no neighbouring word extends with
    that period. ``runs`` holds ``start``, ``length`` and ``period`` by start, then period;
    ``text`` the words that no run contains after its first period, joined by one space.

    A null or empty text, or one of white space, has no words and no runs. Null and repeated
    ids are rows like any other; texts that agree share one grammar within a batch. Other columns are ignored.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            n_words, found, rest = _collapse(part.column(1))
            yield pa.record_batch(
                [part.column(0), n_words, found, rest],
                names=["doc_id", "n_words", "runs", "text"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, "
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, text string",
    )
