"""Texts of an Arrow batch as arrays of bytes and code points."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
CHUNK_BYTES = 4_000_000
#: The characters of the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def code_point_classes() -> np.ndarray:
    """The class of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


class Texts(NamedTuple):
    """Several texts end to end. A null text is empty."""

    data: np.ndarray  #: UTF-8 bytes
    points: np.ndarray  #: code points
    lead: np.ndarray  #: the byte offset of each code point
    bounds: np.ndarray  #: the byte offset of each text, and the end

    @property
    def starts(self) -> np.ndarray:
        """The code point at which each text begins, and the number of code points."""
        return np.searchsorted(self.lead, self.bounds)


def texts_of(column: pa.Array) -> Texts:
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return Texts(data, points, np.flatnonzero((data & 0xC0) != 0x80), offsets - offsets[0])


def slices(data: np.ndarray, cuts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The slices of ``data`` between ascending byte offsets ``cuts``, without copying them one by one."""
    held = pa.py_buffer(np.ascontiguousarray(data))
    return pa.Array.from_buffers(kind or pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), held])


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``most`` bytes of text, or of one row."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
