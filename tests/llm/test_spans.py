from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from custodia.llm.spans import _places, cover_for, difference_cover, key_filter, shared_share, shared_spans, shared_windows


def brute(docs, n):
    texts = {}
    for key, text in docs:
        if key is not None and text is not None:
            texts.setdefault(key, []).append(text)
    holders = {}
    for key, all_texts in texts.items():
        for text in all_texts:
            for k in range(len(text) - n + 1):
                holders.setdefault(text[k : k + n], set()).add(key)
    shared = {w for w, keys in holders.items() if len(keys) > 1}
    return {(key, k) for key, all_texts in texts.items() for text in all_texts for k in range(len(text) - n + 1) if text[k : k + n] in shared}


@pytest.mark.parametrize("order", [2, 3, 5, 7, 13])
def test_every_difference_is_covered(order):
    period, residues = difference_cover(order)
    assert len(residues) == order + 1
    assert {(a - b) % period for a in residues for b in residues} == set(range(period))


def make(seed):
    random.seed(seed)
    text = lambda n: "".join(random.choice("ab中 é") for _ in range(n))
    common = [text(n) for n in (39, 40, 41, 90)]
    docs = []
    for key in range(60):
        body = text(random.randint(0, 60))
        for _ in range(random.randint(0, 2)):
            piece = random.choice(common)
            body += piece + text(random.randint(0, 30))
        docs.append((key, body))
    docs += [(100, common[3] * 2), (101, None), (None, common[3]), (102, ""), (103, text(20) * 3), docs[5]]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_like_brute_force(spark, seed):
    docs = make(seed)
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc long, text string, pos string")
    assert cover_for(40)[0] > 1
    for bits in (1 << 10, 1 << 26):  # a filter that lets nearly all through, and one that lets few
        got = {(r["doc"], r["start"]) for r in shared_windows(df, "doc", "text", 40, filter_bits=bits).collect()}
        assert got == brute(docs, 40)


def test_the_filter_holds_every_key(spark):
    keys = spark.range(0, 40_000, 7).select((F.col("id") * 1_000_003 - 5).alias("key"))
    bits = key_filter(keys, "key", 1 << 20)
    assert len(bits) == 1 << 17
    inside = lambda k: bool(((bits[p >> 3] >> (p & 7).astype("uint8")) & 1).all()) if (p := _places(np.array([k]), 1 << 20)[0]) is not None else False
    assert all(inside(r["key"]) for r in keys.collect())
    assert sum(inside(k) for k in range(10_000)) < 200


def test_exactly_the_length_and_a_hot_piece(spark):
    piece = "0123456789" * 4
    docs = [(k, f"{k:05d}" * 3 + piece + f"{k * 7:05d}") for k in range(300)] + [(900, piece[1:]), (901, piece[:-1])]
    df = spark.createDataFrame(docs, "doc long, text string")
    assert {r["doc"] for r in shared_windows(df, "doc", "text", 40).select("doc").distinct().collect()} == {k for k, _ in brute(docs, 40)}


def test_spans_and_shares(spark):
    docs = [(1, "x" * 5 + "abcdefghij" * 5), (2, "abcdefghij" * 5 + "y"), (3, "nothing"), (4, ""), (5, None)]
    df = spark.createDataFrame(docs, "doc long, text string")
    assert {(r["doc"], r["span_start"], r["span_chars"]) for r in shared_spans(df, "doc", "text", 40).collect()} == {(1, 5, 50), (2, 0, 50)}
    shares = {r["doc"]: (r["chars"], r["shared_chars"], r["share"]) for r in shared_share(df, "doc", "text", 40).collect()}
    assert shares == {1: (55, 50, 50 / 55), 2: (51, 50, 50 / 51), 3: (7, 0, 0.0), 4: (0, 0, 0.0), 5: (None, None, None)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc long, text string")
    assert shared_windows(df, "doc", "text", 40).collect() == []
