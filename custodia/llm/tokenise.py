"""Encoding with a byte-level BPE vocabulary, pre-tokenised by array operations.

A batch of texts is one array of code points, and each has a class (letter, number, white space, other). The
pre-tokeniser as an automaton reads a code point in one of few states, the class that the open piece has. Each transition
function either keeps the state or resets it to the class of its own code point, whatever the state was. Composing such
functions gives the last reset, which is the code point before; so the scan over them needs no carry, and where a piece
begins is told by comparing neighbouring classes, for all positions at a time. Only the endings after an apostrophe look
further, by two code points. No expression engine and no loop over characters is needed.

The pieces are offsets into the UTF-8 buffer. They are coded through a dictionary so that the merges of a distinct piece
run once a batch, and a cache carries them on to later batches. ``token_offsets`` keeps the offset of every token, by
which any part of a text can be decoded by itself.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from custodia.llm.arrays import SPACE, chunks, code_point_classes, slices, texts_of

CACHE_PIECES = 1_000_000
#: The letters after an apostrophe that are pieces of their own.
ENDINGS_OF_ONE = "stmd"
ENDINGS_OF_TWO = ["re", "ve", "ll"]


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins, over the code points of several texts.

    ``text_starts`` are the ascending positions at which a text begins; no text is empty.
    """
    size = len(points)
    if not size:
        return np.zeros(0, np.int64)
    kind = code_point_classes()[points]
    at = np.arange(size, dtype=np.int32)
    first = np.zeros(size + 1, bool)
    first[text_starts] = True
    first[size] = True
    last = first[1:]
    first = first[:-1]

    before = np.empty(size, np.uint8)  # the class before, OTHER + 1 at the start of a text
    before[0] = 9
    before[1:] = kind[:-1]
    before[first] = 9
    run_start = before != kind

    blank = points == 0x20
    joins = np.zeros(size, bool)  # preceded by a blank that this piece takes along
    joins[1:] = blank[:-1] & ~first[1:] & (kind[1:] != SPACE)
    start = run_start & ~joins

    # White space before something else: all but its last character are one piece, the last stands alone or, if a blank, joins.
    space = kind == SPACE
    run_end = np.empty(size, bool)
    run_end[:-1] = kind[1:] != kind[:-1]
    run_end[-1] = True
    run_end |= last
    start |= space & run_end & ~last & ~run_start

    # An apostrophe at the start of a piece may begin an ending.
    marks = np.flatnonzero((points == 0x27) & start & ~last)
    if len(marks):
        bound = np.append(text_starts[1:], size)[np.searchsorted(text_starts, marks, side="right") - 1]
        one = points[marks + 1]
        two = np.where(marks + 2 < bound, points[np.minimum(marks + 2, size - 1)], 0)
        length = np.where(np.isin(one, [ord(c) for c in ENDINGS_OF_ONE]), 2, 0)
        for a, b in ENDINGS_OF_TWO:
            length = np.where((one == ord(a)) & (two == ord(b)), 3, length)
        hit = length > 0
        marks, length, bound = marks[hit], length[hit], bound[hit]
        start[marks + 1] = False
        long = length == 3
        start[marks[long] + 2] = False
        after = marks + length
        inside = after < bound
        after = after[inside]
        # what follows an ending is a piece of its own; white space keeps its own bounds
        start[after] = True
        # an apostrophe right after an ending can begin another one only if it was a start already: it was, its class differs
    return np.flatnonzero(start)


class Vocabulary:
    """The ranks of a vocabulary file and the merges of a piece."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cache: dict[bytes, list[int]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; the pair of lowest rank is merged first, the leftmost of equal ones."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        return self._merge_short(piece) if len(piece) <= 128 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        ranks, none = self.ranks, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for pieces of any length."""
        ranks, size = self.ranks, len(piece)
        end, following, previous = [i + 1 for i in range(size)], list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * size
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := following[i]) >= size or end[j] != stop or end[i] != j:
                continue
            alive[j] = False
            end[i] = stop
            following[i] = after = following[j]
            if after < size:
                previous[after] = i
                if (r := ranks.get(piece[i : end[after]])) is not None:
                    heapq.heappush(heap, (r, i, end[after]))
            if (b := previous[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < size:
            out.append(ranks[piece[i : end[i]]])
            i = following[i]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        cache, out = self.cache, []
        if len(cache) > CACHE_PIECES:
            cache.clear()
        for piece in pieces:
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    cache[piece] = ids
            out.append(ids)
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, read once in each Python worker."""
    return Vocabulary(path)


def encode_texts(texts: pa.StringArray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all ``texts`` in a row, the ids before each text, and the byte offset at which each piece begins.

    A null text counts as empty.
    """
    held = texts_of(texts)
    if not len(held.data):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    bounds = held.bounds
    filled = bounds[:-1][np.diff(bounds) > 0]
    begins = held.lead[piece_starts(held.points, np.searchsorted(held.lead, filled))]
    cuts = np.append(begins, len(held.data))
    pieces = slices(held.data, cuts)
    coded = pieces.dictionary_encode()
    ids = voc.encode_pieces(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(lengths.sum()))
    at = np.concatenate([[0], np.cumsum(lengths)])
    which = coded.indices.to_numpy()
    per_piece = lengths[which]
    ends = np.cumsum(per_piece)
    total = int(ends[-1])
    places = np.arange(total) + np.repeat(at[which] - (ends - per_piece), per_piece)
    before_piece = np.concatenate([[0], ends])
    return flat[places], before_piece[np.searchsorted(cuts, bounds)], begins


def _encode_batches(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            for part in chunks(batch, 1):
                ids, bounds, _ = encode_texts(part.column(1), voc)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "ids"])

    return encode


def _offset_batches(path: str):
    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        lengths = np.zeros(max(voc.ranks.values()) + 1, np.int64)
        for word, rank in voc.ranks.items():
            lengths[rank] = len(word)
        for batch in batches:
            for part in chunks(batch, 1):
                ids, bounds, _ = encode_texts(part.column(1), voc)
                ends = np.concatenate([[0], np.cumsum(lengths[ids])])
                begins = ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begins)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["id", "ids", "offsets"])

    return offsets


def token_offsets(df: DataFrame, key: str, text: str, vocabulary_path: str) -> DataFrame:
    """``key``, ``ids`` and ``offsets``, the byte of the UTF-8 text at which each token begins; cases as in ``token_ids``."""
    kind = dict(df.select(key).dtypes)[key]
    return df.select(df[key].alias("id"), df[text].cast("string").alias("text")).mapInArrow(_offset_batches(vocabulary_path), f"id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("id", key)


def token_ids(df: DataFrame, key: str, text: str, vocabulary_path: str) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text`` without special tokens, one row for each row of ``df``.

    Defined cases: a null and an empty text give an empty list; blank text is encoded as it is; the
    strings of special tokens are ordinary text. Rows may repeat and the key may be null. Very long
    texts are encoded whole. Other columns of ``df`` are never read. The files must be at
    ``vocabulary_path`` on every executor.
    """
    kind = dict(df.select(key).dtypes)[key]
    return df.select(df[key].alias("id"), df[text].cast("string").alias("text")).mapInArrow(_encode_batches(vocabulary_path), f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def decode(ids: list[int], voc: Vocabulary) -> str:
    """The text of ``ids``."""
    words = getattr(voc, "words", None)
    if words is None:
        words = voc.words = {v: k for k, v in voc.ranks.items()}
    return b"".join(words[i] for i in ids).decode("utf-8")
