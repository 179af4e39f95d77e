from __future__ import annotations

import random

import regex

from custodia.llm.leakage import cleaned_documents, leaked_items, words_of


def brute(docs, items, n):
    grams = {}
    for item, text in items:
        w = words_of(text)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = set()
    for key, text in docs:
        w = words_of(text)
        for k in range(len(w) - n + 1):
            out |= {(i, key) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def found(spark, docs, items, n, **options):
    d = spark.createDataFrame(docs, "doc long, text string")
    e = spark.createDataFrame(items, "item long, text string")
    return {(r["item"], r["doc"]) for r in leaked_items(d, "doc", "text", e, "item", "text", n, **options).collect()}


def test_random_texts_like_brute_force(spark):
    random.seed(4)
    text = lambda n: " ".join(random.choice("a b c d e".split()) for _ in range(n))
    items = [(k, text(random.randint(0, 14))) for k in range(30)]
    docs = [(k, text(random.randint(0, 40))) for k in range(60)]
    for n in (3, 5):
        assert found(spark, docs, items, n) == brute(docs, items, n)
    assert found(spark, docs, items, 4, block_words=20) == brute(docs, items, 4)


def test_case_and_marks_only_separate(spark):
    items = [(1, "Alpha beta, GAMMA: delta 42 Straße")]
    docs = [(1, "x ALPHA-beta\n**gamma** (delta) 42/straße y"), (2, "alpha beta gamma delta 4 2 straße"), (3, None), (4, ""), (5, "alpha beta")]
    assert found(spark, docs, items, 6) == {(1, 1)}


def test_longest_match_and_empty_tables(spark):
    d = spark.createDataFrame([(7, "q a b c d e q")], "doc long, text string")
    e = spark.createDataFrame([(1, "z a b c d e f"), (2, "b c d"), (None, "a b c")], "item long, text string")
    rows = {(r["item"], r["matched_words"]) for r in leaked_items(d, "doc", "text", e, "item", "text", 3).collect()}
    assert rows == {(1, 5), (2, 3)}
    assert leaked_items(d, "doc", "text", e.limit(0), "item", "text", 3).collect() == []
    assert leaked_items(d.limit(0), "doc", "text", e, "item", "text", 3).collect() == []


def brute_clean(text, items, n, most):
    words = [(m.group().lower(), m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    grams = {tuple(w[k : k + n]) for _, t in items for w in [words_of(t)] for k in range(len(w) - n + 1)}
    gone, lost = set(), set()
    for k in range(len(words) - n + 1):
        if tuple(w for w, _, _ in words[k : k + n]) in grams:
            gone |= set(range(words[k][1], words[k + n - 1][2]))
            lost |= set(range(k, k + n))
    dropped = bool(words) and len(lost) > most * len(words)
    return ("" if dropped else "".join(c for k, c in enumerate(text) if k not in gone)), len(words), len(lost), dropped


def test_cleaned_documents_like_brute_force(spark):
    random.seed(8)
    text = lambda n: " ".join(random.choice(["a", "b.", "C", "(d", "é"]) for _ in range(n))
    items = [(k, text(random.randint(0, 14))) for k in range(12)]
    docs = [(k, text(random.randint(0, 40))) for k in range(60)] + [(100, ""), (101, "?!"), (102, "x" * 3)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc long, text string, a string")
    e = spark.createDataFrame(items, "item long, text string")
    for options in ({}, {"block_words": 20}):
        got = {r["doc"]: (r["text"], r["words"], r["leaked_words"], r["dropped"]) for r in cleaned_documents(d, "doc", "text", e, "item", "text", 6, 0.5, **options).collect()}
        assert got == {k: brute_clean(t, items, 6, 0.5) for k, t in docs}


def test_cleaned_documents_of_nulls_and_nothing(spark):
    d = spark.createDataFrame([(1, None), (None, "Zero One, two -- THREE five and some more words"), (2, "one two three")], "doc long, text string")
    e = spark.createDataFrame([(1, "one two three four")], "item long, text string")
    got = {(r["doc"], r["text"], r["leaked_words"], r["dropped"]) for r in cleaned_documents(d, "doc", "text", e, "item", "text", 3).collect()}
    assert got == {(1, None, 0, False), (None, "Zero One, two -- THREE five and some more words", 0, False), (2, "", 3, True)}
    assert cleaned_documents(d, "doc", "text", e.limit(0), "item", "text", 3).count() == 3
    assert cleaned_documents(d.limit(0), "doc", "text", e, "item", "text", 3).count() == 0
