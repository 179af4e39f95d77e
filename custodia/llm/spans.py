"""Long exact spans that several records share.

Windows are hashed only at positions that lie in a difference cover modulo a period v: for any two
places i and j there is an offset below v at which both lie in the cover. Two records that share
``min_chars`` code points therefore share the hash of at least one window of ``min_chars - v + 1``
code points, wherever the span begins in each. Such anchors are then extended: around each shared
anchor every window of the full length is hashed from its own bytes (128 bits) and must be shared too.

Only records with a shared anchor need their text again. A filter of fixed size over their keys, made of
bitmaps that Spark combines, goes to the scan and lets few others through; what passes meets its anchors in
a join by key. The plan is the same at every size.

Neither step forms pairs. Both ask which hashes occur in two records, by one shuffle on the hash and
one pass over sorted rows. A hash that many records of one chunk hold is settled inside the chunk
and sent on once, so that a piece held by a third of all records stays spread.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.arrays import Texts, chunks, texts_of
from custodia.session import cut

MIN_CHARS = 400
FILTER_BITS = 1 << 26  #: of the filter that is broadcast, 8 MB
FILTER_HASHES = 3
BITMAP_BITS = 32_768  #: of one bitmap of Spark
_BASE = 0x5851F42D4C957F2D
_ANCHORS, _WINDOWS = "key long, doc long, pos int", "key long, other long, doc long, pos int"


@functools.cache
def difference_cover(order: int) -> tuple[int, tuple[int, ...]]:
    """A period v = order² + order + 1 and order + 1 residues of which the differences are all of 0..v-1; order is a prime.

    The points of a line of the projective plane, numbered along the powers of x in GF(order)[x] modulo a cubic.
    """
    period = order * order + order + 1
    for c0 in range(1, order):
        for c1 in range(order):
            for c2 in range(order):
                a, b, c, found = 1, 0, 0, []
                for i in range(period):
                    if not c:
                        found.append(i)
                    a, b, c = (c * c0) % order, (a + c * c1) % order, (b + c * c2) % order
                if len(found) == order + 1 and len({(x - y) % period for x in found for y in found}) == period:
                    return period, tuple(found)
    raise ValueError(f"{order} is no prime")


def cover_for(min_chars: int) -> tuple[int, tuple[int, ...]]:
    """The widest cover that leaves a window of more than half of ``min_chars``."""
    fitting = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if 2 * (q * q + q + 1) <= min_chars]
    return difference_cover(fitting[-1]) if fitting else (1, (0,))


_powers: list[np.ndarray] = []


def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, x, np.uint64))]) for x in (_BASE, inverse)]
    return _powers[0], _powers[1]


def anchor_hashes(texts: Texts, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and position in its text of each window that begins on the cover."""
    period, residues = cover_for(min_chars)
    width = min_chars - period + 1
    starts = texts.starts
    sizes = np.diff(starts)
    kept = np.flatnonzero(sizes >= min_chars)
    none = np.zeros(0, np.int64)
    if not len(kept):
        return none, none, none
    places, rows = [], []
    for row in kept:
        size = int(sizes[row])
        local = (np.arange(0, size, period)[:, None] + np.array(residues)).ravel()
        local = local[local + width <= size]
        places.append(local)
        rows.append(np.full(len(local), row))
    local, rows = np.concatenate(places), np.concatenate(rows)
    at = local + starts[rows]
    power, inverse = _powers_to(len(texts.points) + 1)
    mixed = (texts.points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((mixed ^ (mixed >> np.uint64(29))) * power[: len(mixed)], dtype=np.uint64)])
    hashed = (sums[at + width] - sums[at]) * inverse[at]
    hashed ^= hashed >> np.uint64(32)
    return (hashed * np.uint64(0x94D049BB133111EB)).view(np.int64), rows, local


def _tagged(hashes: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows of one chunk. Those known to be shared inside it get ``-1 - pos`` and are sent to any place, but for one each."""
    pos = pos.astype(np.int32)
    if len(doc):
        order = np.lexsort((doc, *hashes))
        sorted_ones = [h[order] for h in hashes]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = np.logical_or.reduce([h[1:] != h[:-1] for h in sorted_ones])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(doc)) - 1
        known, spread = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        docs = doc[order]
        known[order] = np.repeat(docs[first] != docs[last], last - first + 1)
        spread[order] = ~fresh
        spread &= known
        # rows keep the order of the texts, in which neighbours compress well
        hashes = [np.where(spread, doc * np.int64(0x2545F491) + pos, hashes[0]), *(np.where(spread, np.int64(-1) - pos, h) for h in hashes[1:])]
        pos = np.where(known, -1 - pos, pos)
    names = ["key", "other"][: len(hashes)]
    return pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(doc), pa.array(pos)], [*names, "doc", "pos"])


def _anchors(min_chars: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                hashed, rows, local = anchor_hashes(texts_of(part.column(1)), min_chars)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield _tagged([hashed], ids[rows] if len(rows) else rows, local)

    return anchors


def window_starts(anchors: list[int], size: int, min_chars: int) -> np.ndarray:
    """The places at which a window of the full length around one of the anchors may begin."""
    period, _ = cover_for(min_chars)
    change = np.zeros(size + 2, np.int32)
    at = np.unique(np.asarray(anchors, np.int64))
    np.add.at(change, np.maximum(at - period + 1, 0), 1)
    np.add.at(change, at + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[: size + 1]) > 0)
    return starts[starts + min_chars <= size]


def _windows(min_chars: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                key, doc, pos = [], [], []
                ids = part.column(0).to_pylist()
                texts = part.column(1).to_pylist()
                for row, anchors in enumerate(part.column(2).to_pylist()):
                    raw = texts[row].encode("utf-32-le")
                    starts = window_starts(anchors, len(raw) // 4, min_chars)
                    view = memoryview(raw)
                    key.extend(xxhash.xxh3_128_digest(view[4 * s : 4 * (s + min_chars)]) for s in starts.tolist())
                    doc.append(np.full(len(starts), ids[row], np.int64))
                    pos.append(starts)
                halves = np.frombuffer(b"".join(key), dtype=np.int64).reshape(-1, 2)
                yield _tagged([halves[:, 0].copy(), halves[:, 1].copy()], np.concatenate(doc or [np.zeros(0, np.int64)]), np.concatenate(pos or [np.zeros(0, np.int64)]))

    return windows


def _shared(hashes: int):
    """Of rows sorted by hash and document, those of which the hash occurs in two documents.

    Between batches only the open hash and the rows of its first document are held.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] | None = None
        open_hash: tuple | None = None

        def out(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.where(pos < 0, -1 - pos, pos))], ["doc", "pos"])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(hashes + 2)]
            if not len(columns[0]):
                continue
            if pending is not None:
                columns = [np.concatenate(x) for x in zip(pending, columns)]
            keys, (doc, pos) = columns[:hashes], columns[hashes:]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(doc)) - 1
            found = doc[first] != doc[last]
            if open_hash == tuple(k[0] for k in keys):
                found[0] = True
            rows = np.repeat(found, last - first + 1)
            tail = first[-1]
            settled = bool(found[-1])
            open_hash = tuple(k[-1] for k in keys) if settled else None
            pending = None if settled else [x[tail:].copy() for x in columns]
            keep = rows | (pos < 0)
            if not settled:
                keep[tail:] = False
            yield out(doc[keep], pos[keep])
        if pending is not None and (pending[-1] < 0).any():
            known = pending[-1] < 0
            yield out(pending[-2][known], pending[-1][known])

    return shared


def _in_two(tagged: DataFrame, hashes: list[str]) -> DataFrame:
    sorted_rows = tagged.repartition(*hashes).sortWithinPartitions(*hashes, "doc")
    return sorted_rows.mapInArrow(_shared(len(hashes)), "doc long, pos int")


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The places of each key in a filter of ``bits`` bits, a power of two."""
    mixed = keys.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        return (np.stack([mixed + np.uint64(k) * step for k in range(FILTER_HASHES)], axis=1) & np.uint64(bits - 1)).astype(np.int64)


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter over whole numbers: ``bits`` bits in bytes, however many keys there are.

    Tasks set bits in bitmaps of a fixed size, Spark combines these, and the driver puts at most ``bits / 32,768`` of
    them in a row. Keys beyond what the filter holds well only make it let more through.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel())], ["place"])

    marked = keys.select(F.col(key).cast("long")).mapInArrow(places, "place long")
    bitmaps = marked.groupBy(F.expr(f"place div {BITMAP_BITS}").alias("bitmap")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bits"))
    out = np.zeros((max(bits // BITMAP_BITS, 1), BITMAP_BITS // 8), np.uint8)
    for row in bitmaps.toLocalIterator():
        out[row["bitmap"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()[: bits // 8]


def _passing(bits: np.ndarray):
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _places(batch.column(0).to_numpy(zero_copy_only=False), len(bits) * 8)
            yield batch.filter(pa.array(((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)))

    return passing


def shared_windows(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``key`` and ``start`` of each window of ``min_chars`` code points that stands in another record as well.

    Defined cases: ``key`` is a whole number; rows that repeat a key are one record, and what they share among
    themselves does not count. Null keys and null texts are left out; texts shorter than ``min_chars`` share nothing.
    Texts are compared as stored, whole, by code point. Other columns are never read.
    """
    texts = df.select(df[key].cast("long").alias("doc"), df[text].cast("string").alias("text")).where("doc is not null and length(text) >= %d" % min_chars)
    anchors = cut(_in_two(texts.mapInArrow(_anchors(min_chars), _ANCHORS), ["key"]).groupBy("doc").agg(F.collect_set("pos").alias("anchors")))
    passing = texts.mapInArrow(_passing(key_filter(anchors, "doc", filter_bits)), "doc long, text string")
    windows = passing.join(anchors, "doc").select("doc", "text", "anchors").mapInArrow(_windows(min_chars), _WINDOWS)
    return _in_two(windows, ["key", "other"]).distinct().select(F.col("doc").alias(key), F.col("pos").alias("start"))


def shared_spans(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key``, ``span_start`` and ``span_chars`` of each longest piece covered by shared windows; cases as in ``shared_windows``."""
    by_start = Window.partitionBy(key).orderBy("start")
    windows = shared_windows(df, key, text, min_chars)
    begins = windows.withColumn("begins", F.coalesce(F.col("start") - F.lag("start").over(by_start) > min_chars, F.lit(True)).cast("int"))
    numbered = begins.withColumn("span", F.sum("begins").over(by_start))
    return numbered.groupBy(key, "span").agg(F.min("start").cast("long").alias("span_start"), (F.max("start") - F.min("start") + min_chars).cast("long").alias("span_chars")).drop("span")


def shared_share(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """For each record ``chars``, ``shared_chars`` and ``share``, the part of it that stands elsewhere too; 0 for an empty text, null for none."""
    spans = shared_spans(df, key, text, min_chars).groupBy(key).agg(F.sum("span_chars").alias("shared_chars"))
    sizes = df.select(key, F.length(text).cast("long").alias("chars"))
    joined = sizes.join(spans, key, "left").withColumn("shared_chars", F.when(F.col("chars").isNotNull(), F.coalesce("shared_chars", F.lit(0))))
    return joined.select(key, "chars", "shared_chars", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).when(F.col("chars") == 0, F.lit(0.0)).alias("share"))
