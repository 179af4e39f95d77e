"""Held-out passages in a corpus, found with a generalised suffix automaton of the test items.

The automaton is built over word numbers from all items at once and sent to the executors; its size
is bounded by twice the items' words, and that many items are taken at a time that the bound holds.
Documents stream through it: the state after each word gives the length of the longest passage of
the items that ends there. From ``min_words`` on, the state and its suffix-link ancestors that hold at
least ``min_words`` words name every item in which these words stand, and how long its passage is.

``cleaned_documents`` removes what was found: every passage of at least ``min_words`` words, and the whole text of a
document of which such passages cover more than a given share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.arrays import LETTER, NUMBER, Texts, chunks, code_point_classes, slices, texts_of
from custodia.session import cut

MIN_WORDS = 13
BLOCK_WORDS = 100_000
MOST_COVERAGE = 0.5
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text or "")]


class Automaton:
    """A generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        holders: list[set[int]] = [set()]
        self.items: list[int] = []
        for item, words in items:
            place = len(self.items)
            self.items.append(item)
            last = 0
            for word in words:
                last = self._extend(last, self.number.setdefault(word, len(self.number)), holders)
                holders[last].add(place)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            holders[self.link[state]] |= holders[state]
        # the items in which the strings of a state stand, where these are long enough
        self.named = [tuple(sorted(held)) if self.length[state] >= min_words else () for state, held in enumerate(holders)]
        pairs = {(a, b) for _, words in items for a, b in zip(words, words[1:])}
        size = len(self.number)
        self.pairs = np.unique(np.fromiter((self.number[a] * size + self.number[b] for a, b in pairs), dtype=np.int64, count=len(pairs)))

    def _new(self, length: int, following: dict[int, int], link: int, holders: list[set[int]]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        holders.append(set())
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int, holders: list[set[int]]) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], holders)
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int, holders: list[set[int]]) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q, holders)
        new = self._new(self.length[last] + 1, {}, 0, holders)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q, holders)
        return new

    def matches(self, words: list[int], found: dict[int, int]) -> None:
        """Streams ``words``; ``found`` gets, for each item, the longest match that ends on words it holds."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= self.min_words:
                at, longest = state, length
                while longest >= self.min_words:  # shorter endings of the match stand in more items
                    for place in self.named[at]:
                        found[place] = max(found.get(place, 0), longest)
                    at = self.link[at]
                    longest = self.length[at]


    def spans(self, words: list[int]) -> list[tuple[int, int]]:
        """The places of the longest matches of at least the least length, as first word and word after the last; they may overlap."""
        state, length, out = 0, 0, []
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= self.min_words:
                if out and out[-1][0] == at - length + 1:
                    out[-1] = (out[-1][0], at + 1)
                else:
                    out.append((at - length + 1, at + 1))
        return out


def word_numbers(texts: Texts, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word of ``texts`` in the automaton, or -1, the text in which it stands, and the code points at which it begins and ends.

    Words are slices of the bytes; each distinct one is lower-cased and looked up once.
    """
    kind = code_point_classes()[texts.points]
    inside = (kind == LETTER) | (kind == NUMBER)
    starts = texts.starts
    edge = np.empty(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[[0, -1]] = True
    edge[starts] = True
    cuts = np.flatnonzero(edge)
    word = inside[cuts[:-1]]
    ends = np.append(texts.lead, len(texts.data))
    coded = slices(texts.data, ends[cuts]).filter(pa.array(word)).dictionary_encode()
    get = automaton.number.get
    numbers = np.fromiter((get(w.decode("utf-8").lower(), -1) for w in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
    rows = np.searchsorted(starts, cuts[:-1][word], side="right") - 1
    return (numbers[coded.indices.to_numpy()] if len(numbers) else numbers), rows, cuts[:-1][word], cuts[1:][word]


def _candidates(texts: Texts, automaton: Automaton) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of words in which every pair of neighbours is one of the items': the text, its first word there, and numbers, begins and ends of the words."""
    size, least = len(automaton.number), automaton.min_words
    if not len(texts.points):
        return
    numbers, rows, begins, ends = word_numbers(texts, automaton)
    if len(numbers) < least:
        return
    # a match of the least length needs that many words less one pairs of the items in a row
    pairs = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (rows[:-1] == rows[1:])
    codes = np.where(pairs, numbers[:-1] * size + numbers[1:], -1)
    places = np.minimum(np.searchsorted(automaton.pairs, codes), len(automaton.pairs) - 1)
    held = np.concatenate([[0], (automaton.pairs[places] == codes).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(held))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= least - 1:
            yield int(rows[a]), int(a), numbers[a : b + 1], begins[a : b + 1], ends[a : b + 1]


def _search(automaton: Automaton):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                docs, items, lengths = [], [], []
                found: dict[tuple[int, int], int] = {}
                for row, _, numbers, _, _ in _candidates(texts_of(part.column(1)), automaton):
                    near: dict[int, int] = {}
                    automaton.matches(numbers.tolist(), near)
                    for place, length in near.items():
                        found[row, place] = max(found.get((row, place), 0), length)
                for (row, place), length in found.items():
                    docs.append(row)
                    items.append(automaton.items[place])
                    lengths.append(length)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), part.column(0).take(pa.array(docs, pa.int64())), pa.array(lengths, pa.int32())], ["item", "doc", "words"])

    return search


def _blocks(items: Iterator, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, held = [], 0
    for item, text in items:
        words = words_of(text)
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words)
    if block:
        yield block


def _automata(items: DataFrame, item_key: str, item_text: str, min_words: int, block_words: int) -> Iterator[Automaton]:
    asked = items.where(items[item_key].isNotNull() & items[item_text].isNotNull()).select(items[item_key].cast("long").alias("item"), items[item_text].alias("text"))
    for block in _blocks(((r["item"], r["text"]) for r in asked.orderBy("item").toLocalIterator()), block_words):
        automaton = Automaton([x for x in block if len(x[1]) >= min_words], min_words)
        if automaton.items:
            yield automaton


def _over_blocks(texts: DataFrame, automata: Iterator[Automaton], task, layout: str) -> DataFrame | None:
    """The rows of all blocks. Those of a block are computed and kept before the next automaton is built, so the driver holds one or two."""
    out, last = None, None
    for automaton in automata:
        if last is not None:
            done = cut(last)
            out = done if out is None else out.unionAll(done)
        last = texts.mapInArrow(task(automaton), layout)
    return last if out is None else out.unionAll(last)


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each (item, document) of which ``min_words`` consecutive words of the item stand in the document.

    Returns ``item_key``, ``key`` and ``matched_words``, the longest such passage by words. Items are the
    stated query set; they are read in blocks of at most ``block_words`` words, each of which becomes an
    automaton of at most twice as many states, so what is sent to the executors has that bound whatever
    the number of items. The documents are scanned once for each block and never shuffled.

    Defined cases: null and empty texts, and texts of fewer than ``min_words`` words, match nothing.
    Items too short to hold ``min_words`` words are never found. Item keys are whole numbers; an item
    with a null key is left out. A key that stands twice gives its rows twice. Other columns are never read.
    """
    kind = dict(documents.select(key).dtypes)[key]
    texts = documents.select(documents[key].alias("doc"), documents[text].cast("string").alias("text"))
    found = _over_blocks(texts, _automata(items, item_key, item_text, min_words, block_words), _search, f"item long, doc {kind}, words int")
    if found is None:
        return documents.sparkSession.createDataFrame([], f"{item_key} long, {key} {kind}, matched_words int")
    return found.select(F.col("item").alias(item_key), F.col("doc").alias(key), F.col("words").alias("matched_words"))


def _find_spans(automaton: Automaton):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                texts = texts_of(part.column(1))
                docs, begins, ends = [], [], []
                for row, _, numbers, starts, stops in _candidates(texts, automaton):
                    for a, b in automaton.spans(numbers.tolist()):
                        docs.append(row)
                        begins.append(int(starts[a] - texts.starts[row]))
                        ends.append(int(stops[b - 1] - texts.starts[row]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs, pa.int64())), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["doc", "a", "b"])

    return find


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that do not touch, in order, which cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cleaned(most_coverage: float):
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                texts, removed, words, gone = [], [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    kept, at, lost = [], 0, 0
                    for a, b in united([(s["a"], s["b"]) for s in spans or []]):
                        kept.append(text[at:a])
                        lost += len(words_of(text[a:b]))
                        at = b
                    total = len(words_of(text))
                    drop = total > 0 and lost > most_coverage * total
                    texts.append(None if text is None else "" if drop else "".join(kept) + text[at:])
                    removed.append(lost)
                    words.append(total)
                    gone.append(drop)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(words, pa.int32()), pa.array(removed, pa.int32()), pa.array(gone)], ["doc", "text", "words", "leaked_words", "dropped"])

    return cleaned


def cleaned_documents(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, most_coverage: float = MOST_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key``, ``text`` without leaked passages, its ``words`` before, the ``leaked_words`` and whether it was ``dropped``.

    A passage of at least ``min_words`` words of an item is cut out, from its first word to its last; what several
    items or blocks find is united first. A document of which leaked words are more than ``most_coverage`` keeps an empty text.
    The texts of all documents meet the spans in one join by key.

    Defined cases: a null text stays null and an empty one empty; a text without such passage stays as it is. Keys are
    unique; a null key keeps its text. Other columns are never read.
    """
    kind = dict(documents.select(key).dtypes)[key]
    texts = documents.select(documents[key].alias("doc"), documents[text].cast("string").alias("text"))
    found = _over_blocks(texts, _automata(items, item_key, item_text, min_words, block_words), _find_spans, f"doc {kind}, a int, b int")
    if found is None:
        found = documents.sparkSession.createDataFrame([], f"doc {kind}, a int, b int")
    spans = found.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    out = texts.join(spans, "doc", "left").select("doc", "text", "spans").mapInArrow(_cleaned(most_coverage), f"doc {kind}, text string, words int, leaked_words int, dropped boolean")
    return out.withColumnRenamed("doc", key)
