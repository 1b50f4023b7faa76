"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

**Encoding.** A sequence of tokens is the BPE encoding of its bytes exactly if every
two neighbours are, i.e. if merging the bytes of the pair gives the pair back. So the
encoding of a string is a walk through a nondeterministic transducer that guesses
where tokens end: it follows the bytes of a token of the vocabulary and may close it if
its pair with the token before is a valid one. ``Transducer`` makes this machine
deterministic by subsets, one arc when it is first needed. A subset holds, for each
guess that is still alive, the tokens not yet written and what is read of the next;
tokens that all guesses share are written at once. A guess lives for one token at
most, so output follows input after a bounded lookahead, and the cost of a piece of
text is linear in its bytes, also for a piece of a million letters.

**Decoding.** ``Decoder`` is a UTF-8 state machine whose state is the unfinished
character; it takes tokens one at a time. Bytes that are no UTF-8 become U+FFFD, one
for each maximal broken part.

Both machines keep at most a fixed number of arcs and start afresh beyond that; the ids
of words are kept up to a fixed number of bytes.
"""

from __future__ import annotations

import base64
from array import array
from bisect import insort
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ontomill.llm.common import slices

#: Arcs, and pairs of tokens, kept by a machine before it starts afresh.
MAX_ARCS = 300_000
#: Bytes of words and their ids that a codec keeps; longer words are encoded each time.
MAX_CACHE_BYTES = 128 << 20
LONGEST_KEPT = 48
#: What a kept word takes beside its characters and ids: two objects and a place in a dict.
ENTRY_BYTES = 180
_NEVER = 1 << 60
#: Letters, and marks that the pattern always parts from letters before them.
_LETTERS = regex.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Transducer:
    """Encodes one piece of text, given as bytes, into token ids.

    Arcs lie in one dict: state * 256 + byte -> (tokens written, next state). A state is
    a number for ``(open, tokens)``. ``tokens[k]`` is the last token of the encoding of
    all bytes up to the k-th after those already written, which is unique. ``open`` is
    what the guess with the longest unfinished token has read of it; the unfinished
    tokens of the others are those of its ends that begin a token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.single = [bytes([byte]) for byte in range(256)]
        if not ranks.keys() >= set(self.single):
            raise ValueError("every single byte has to be a token")
        self.begun = {token[:n] for token in ranks for n in range(1, len(token))}
        self._restart()

    def _restart(self) -> None:
        self.arcs: dict[int, tuple[tuple[int, ...], int]] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.numbers: dict[tuple[bytes, tuple], int] = {}
        self.states: list[tuple[bytes, tuple]] = []
        self._state(b"", (-1,))

    def _state(self, begun: bytes, tokens: tuple) -> int:
        name = (begun, tokens)
        state = self.numbers.setdefault(name, len(self.states))
        if state == len(self.states):
            self.states.append(name)
        return state

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """The merges applied by rank, as defined, down to ``until`` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best = min(
                range(len(parts) - 1),
                key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60),
            )
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        data = self.bytes_of[token]
        if len(data) == 1:
            return None
        left, right = self.merged(data, until=2)
        return self.ranks[left], self.ranks[right]

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that lie at one edge of ``token`` while it is merged, byte first."""
        found = self.edges[side].get(token)
        if found is None:
            halves = self.halves(token)
            found = [*(self.edge(halves[side], side) if halves else []), token]
            self.edges[side][token] = found
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may come after ``left``; -1 stands for the start.

        Merges happen in the order of their ranks, and a token ranks after its parts. So
        the pair stays a pair unless, as both are built up, the two tokens that touch
        merge with a lower rank than the next merge on either side of the border.
        """
        if left < 0:
            return True
        return not self._joins(self.edge(left, 1), self.edge(right, 0))

    def _joins(self, ends: list[int], starts: list[int]) -> bool:
        i = j = 0
        while True:
            grow_left = ends[i + 1] if i + 1 < len(ends) else _NEVER
            grow_right = starts[j + 1] if j + 1 < len(starts) else _NEVER
            across = self.ranks.get(self.bytes_of[ends[i]] + self.bytes_of[starts[j]], _NEVER)
            if across < grow_left and across <= grow_right:
                return True
            if grow_left == grow_right == _NEVER:
                return False
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def arc(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        ranks, begun, pairs = self.ranks, self.begun, self.pairs
        data, tokens = self.states[state]
        data += self.single[byte]
        here = len(tokens)
        closed, alive = None, []  # where the guesses that go on began their token
        for k in range(len(data)):
            end = data[k:]
            if closed is None:  # one guess closes a token here, as the encoding is unique
                token = ranks.get(end)
                if token is not None:
                    left = tokens[here - len(end)]
                    pair = left << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.follows(left, token)
                    if fits:
                        closed = token
            if end in begun:
                alive.append(here - len(end))
        tokens = (*tokens, closed)
        first = alive[0] if alive else here
        settled = self._settled(tokens, [*alive, here]) if first else 0
        shared = self._back(tokens, settled) if settled else ()
        arc = shared, self._state(data[len(data) - here + first :], tokens[settled:])
        self.arcs[state << 8 | byte] = arc
        return arc

    def _settled(self, tokens: tuple, places: list[int]) -> int:
        """The last place that the encodings up to all ``places`` (ascending) pass."""
        size = self.size
        while len(places) > 1:
            top = places.pop()
            place = top - size[tokens[top]]
            if place not in places:
                insort(places, place)
            if not places[0]:
                return 0
        return places[0]

    def _back(self, tokens: tuple, place: int) -> tuple[int, ...]:
        """The tokens that lead to a place, in order."""
        out = []
        while place:
            out.append(tokens[place])
            place -= self.size[tokens[place]]
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)  # a piece that is a token is never taken apart
        if whole is not None:
            return (whole,)
        if len(self.arcs) > MAX_ARCS or len(self.pairs) > MAX_ARCS:
            self._restart()
        state, out, known, make = 0, [], self.arcs.get, self.arc
        for byte in piece:
            written, state = known(state << 8 | byte) or make(state, byte)
            if written:
                out += written
        tokens = self.states[state][1]
        return (*out, *self._back(tokens, len(tokens) - 1))


class _Rest(dict):
    """One unfinished character: token id -> (text, next state)."""

    __slots__ = ("decoder", "begun")

    def __init__(self, decoder: Decoder, begun: bytes):
        super().__init__()
        self.decoder, self.begun = decoder, begun

    def __missing__(self, token: int) -> tuple[str, _Rest]:
        text, begun = utf8_step(self.begun, self.decoder.bytes_of[token])
        arc = self[token] = (text, self.decoder.state(begun))
        return arc


def _continuation(begun: bytes) -> tuple[int, int, int]:
    """Bytes that a begun character still needs, and the bounds of the next one.

    (0, 0, 0) if ``begun`` begins no character. Fixed values: the table of well-formed
    UTF-8 byte sequences of the Unicode standard.
    """
    lead = begun[0]
    if 0xC2 <= lead <= 0xDF:
        need = 1
    elif 0xE0 <= lead <= 0xEF:
        need = 2
    elif 0xF0 <= lead <= 0xF4:
        need = 3
    else:
        return 0, 0, 0
    low, high = 0x80, 0xBF
    if len(begun) == 1:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
    return need - len(begun) + 1, low, high


def utf8_step(begun: bytes, data: bytes) -> tuple[str, bytes]:
    """Feed ``data`` after an unfinished character; the text so far, the new rest."""
    out, rest = [], begun
    for i in range(len(data)):
        byte = data[i : i + 1]
        if rest:
            need, low, high = _continuation(rest)
            if low <= byte[0] <= high:
                rest += byte
                if need == 1:
                    out.append(rest.decode())
                    rest = b""
                continue
            out.append("�")
            rest = b""
        if byte[0] < 0x80:
            out.append(byte.decode())
        elif _continuation(byte)[0]:
            rest = byte
        else:
            out.append("�")
    return "".join(out), rest


class Decoder:
    """Token ids to text, one token at a time."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.states: dict[bytes, _Rest] = {}

    def state(self, begun: bytes) -> _Rest:
        state = self.states.get(begun)
        if state is None:
            state = self.states[begun] = _Rest(self, begun)
        return state

    def _begin(self) -> _Rest:
        if sum(map(len, self.states.values())) > MAX_ARCS:
            self.states.clear()
        return self.state(b"")

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of each token as soon as its characters are complete."""
        state = self._begin()
        for token in ids:
            text, state = state[token]
            yield text
        if state.begun:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        state, out = self._begin(), []
        for token in ids:
            text, state = state[token]
            out.append(text)
        return "".join(out) + ("�" if state.begun else "")


class _Odd(Exception):
    """A blank with more white space after it: the text is not to be cut at blanks."""


class Codec(dict):
    """Whole texts to ids and back. As a dict: word -> ids of a blank and the word.

    A text is cut before blanks that another character than white space follows. No match
    of the pattern reaches over such a place and no lookahead sees past it, so the parts
    are encoded apart and often kept. Texts in which more white space follows a blank are
    cut into runs of white space, each with the run of other characters after it. Where
    the pattern parts marks from letters before them, as a few samples tell, a word is
    encoded once for all marks that follow it.

    What is kept has two halves, the younger of which is filled. When it holds half of
    ``MAX_CACHE_BYTES`` it becomes the older one, and what was not used since goes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.machine = Transducer(ranks)
        self.decoder = Decoder(self.machine.bytes_of)
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.pieces = regex.compile(pattern)
        self.chunks = regex.compile(r"\s*\S+|\s+")
        self.blank = regex.compile(r"\s|$")
        marked = [f" {word}{mark}" for word in ("a", "Zé", "ßÿÀ") for mark in (*_MARKS, _MARKS)]
        self.parts_marks = all(
            self.pieces.findall(word) == [word.rstrip(_MARKS), word[len(word.rstrip(_MARKS)) :]]
            for word in marked
        )

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if self.blank.match(word):
                raise _Odd
            letters = word.rstrip(_MARKS)
            if self.parts_marks and letters != word and _LETTERS.fullmatch(letters):
                found = self[letters] + self.chunk_ids(word[len(letters) :])
            else:
                found = self.chunk_ids(" " + word)
        if len(word) <= LONGEST_KEPT:
            self.held += ENTRY_BYTES + len(word) + len(found)
            if self.held > MAX_CACHE_BYTES // 2:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[word] = found
        return found

    def chunk_ids(self, chunk: str) -> bytes:
        ids = array("i")
        for piece in self.pieces.findall(chunk):
            ids.extend(self.machine.encode(piece.encode()))
        return ids.tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        begin, *words = text.split(" ")
        try:
            found = [self.chunk_ids(begin), *map(self.__getitem__, words)]
        except _Odd:
            found = [
                self[chunk[1:]] if chunk[0] == " " and not self.blank.match(chunk, 1) else self.chunk_ids(chunk)
                for chunk in self.chunks.findall(text)
            ]
        return np.frombuffer(b"".join(found), np.int32)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in each process."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return Codec(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` of every row; null and empty texts have no ids.

    ``path`` names a rank file that is installed on every executor. Rows keep their
    partition; nothing is shuffled. Repeated rows and null keys stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in slices(batches):
            arrays = [own.encode(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            flat = np.concatenate(arrays)
            yield pa.record_batch(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=[key, "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``(key, ids, text)``: the text of the ids of every row; null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = codec(path, pattern).decoder
        for part in slices(batches):
            texts = [decoder.decode(ids or ()) for ids in part.column(1).to_pylist()]
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(texts, pa.string())],
                names=[key, "ids", "text"],
            )

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, text string")


def round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    derive: Callable[[np.ndarray, str], tuple],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, *schema)``: what ``derive`` makes of the ids and the decoded text of every row.

    Encoding and decoding share one codec in a task, and ids do not leave it. Null and
    empty texts have no ids and decode to the empty text; rows stay as in ``encode``.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(field.name for field in StructType.fromDDL(schema))]
    kinds = [to_arrow_type(field.dataType) for field in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in slices(batches, 64):
            rows = []
            for value in part.column(1).to_pylist():
                ids = own.encode(value)
                rows.append(derive(ids, own.decoder.decode(ids.tolist())))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.record_batch([part.column(0), *columns], names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {schema}")
