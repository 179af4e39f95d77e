from __future__ import annotations

import random

import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")

from custodia.llm import tokenise as T  # noqa: E402

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def both():
    voc = T.Vocabulary(PATH)
    return voc, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=voc.ranks, special_tokens={})


def encoded(texts, voc):
    ids, bounds, _ = T.encode_texts(pa.array(texts, pa.string()), voc)
    return [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))]


def test_random_texts_like_the_published_encoder(both):
    voc, other = both
    random.seed(3)
    alphabet = "ab'stmdrevl  \n\t 12é中.,!-  '''<|endoftext|>  ​"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(5000)]
    texts += ["", " ", "\n", "a" * 5000, "'" * 300, " " * 1000 + "x", "中" * 2000, "'s's'll've", "\U0001f642‍'d", "<|endoftext|>"]
    assert encoded(texts, voc) == [other.encode_ordinary(t) for t in texts]


def test_ids_decode_to_the_text(both):
    voc, _ = both
    text = "Übergabe — 交接 don't\r\n\tx  "
    assert T.decode(encoded([text], voc)[0], voc) == text


def test_offsets_cut_the_bytes_into_pieces(both):
    voc, _ = both
    _, _, begins = T.encode_texts(pa.array(["don't go", None, "中 a"]), voc)
    assert begins.tolist() == [0, 3, 5, 8, 11]


def test_rows_nulls_repeats_and_clashing_names(spark, both):
    _, other = both
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", None), (4, "  ", "y"), (None, "a", "z"), (1, "hello world", "x"), (5, "lang " * 50_000, "q")]
    df = spark.createDataFrame(rows, "doc long, text string, ids string")
    got = T.token_ids(df, "doc", "text", PATH).collect()
    assert sorted((str(r["doc"]), list(r["ids"])) for r in got) == sorted((str(a), other.encode_ordinary(b or "")) for a, b, _ in rows)
    assert T.token_ids(df.limit(0), "doc", "text", PATH).collect() == []


def test_every_token_by_its_offset(spark, both):
    voc, _ = both
    rows = [(1, "Übergabe — don't\r\n\tx  中文"), (2, None), (3, ""), (4, " "), (5, "a" * 5000), (None, "b c")]
    words = {v: k for k, v in voc.ranks.items()}
    for r in T.token_offsets(spark.createDataFrame(rows, "doc long, text string"), "doc", "text", PATH).collect():
        held = (dict(rows)[r["doc"]] or "").encode()
        cuts = [*r["offsets"], len(held)]
        assert [held[a:b] for a, b in zip(cuts, cuts[1:])] == [words[i] for i in r["ids"]]
