"""Byte-level BPE against the library, by both folds, on fixed, random and odd texts."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from provenant.llm import byte_bpe as B

ODD = [None, "", " ", "\n\n  x", "a", "it's we'll I'd THEY'RE", "tail    　x", "日本語 ñandú \U0001F600\U0001F600", "=" * 3000, "ab" * 700, "<|endoftext|> x",
       "x" * 20000, "\x00\x01�￾", "a\r\n\tb   ", "1234567890 ٣٤ ⅷ²", " the the the", " the the the", "é‍​"]


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    pick = random.Random(5)
    alphabet = "aaabbcdeeethr  '.,\n0123ñ日é"
    texts = ODD + ["".join(pick.choice(alphabet) for _ in range(pick.randint(1, 400))) for _ in range(60)]
    rows = [(i, t, "clash", [1], "word") for i, t in enumerate(texts)] + [(None, "null id", "clash", [1], "word")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, data array<int>, word string").repartition(4)


def test_ids_equal_the_librarys_and_decode_to_the_text(docs, ranks, library):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = B.encode(docs, ranks).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row.ids == library.encode_ordinary(texts[row.doc_id])
    back = B.decode(B.encode(docs, ranks), ranks).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == texts


def test_digests(docs, ranks, library):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for row in B.digests(docs, ranks).collect():
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_both_folds_agree(spark, ranks, library):
    pick = random.Random(7)
    words = ["".join(pick.choice("aabcdehinorst") for _ in range(pick.randint(1, 150))) for _ in range(200)] + ["a" * n for n in range(1, 40)]
    own = B.Ranks(ranks)
    both = B._let(own.literal(), lambda t: F.struct(B._ids(own.short(F.col("w"), t)).alias("a"), B._ids(own.long(F.col("w"), t)).alias("b")))
    for row in spark.createDataFrame([(w,) for w in words], "w string").select("w", both.alias("x")).collect():
        assert row.x.a == row.x.b == library.encode_ordinary(row.w)


def test_words_are_cut_as_the_library_cuts_them(spark, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = ["a" + chr(c) + "b " + chr(c) + "1 " + chr(c) + chr(c) + "." for c in points]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in df.select("doc_id", B._words("text", B.word_pattern()).alias("w")).collect():
        assert library.encode_ordinary(texts[row.doc_id]) == [i for w in row.w for i in library._encode_single_piece(w)]


def test_memo_changes_nothing(docs, ranks, monkeypatch):
    with_memo = sorted(map(str, B.encode(docs, ranks).collect()))
    monkeypatch.setattr(B, "frequent_words", lambda docs, *a, **k: docs.select(F.lit("").alias("word")).where("false"))
    assert sorted(map(str, B.encode(docs, ranks).collect())) == with_memo


def test_frequent_words_are_chosen_by_count(spark):
    docs = spark.createDataFrame([(1, "a a a a b b c"), (2, None), (3, " a")], "doc_id long, text string")
    pattern = B.word_pattern()
    assert {r.word for r in B.frequent_words(docs, pattern).collect()} == {" a", " b"}
    assert {r.word for r in B.frequent_words(docs, pattern, most=1).collect()} == {" a"}
    assert B.frequent_words(docs, pattern, most=0).count() == 0


def test_empty_tables_null_ids_and_ids_outside(spark, docs, ranks):
    assert B.encode(docs.where("false"), ranks).count() == 0
    tokens = spark.createDataFrame([(1, None), (2, []), (3, [256, 257])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.data) for r in B.decode(tokens, ranks).collect()}
    pieces = {rank: piece for piece, rank in ranks.items()}
    assert got == {1: b"", 2: b"", 3: pieces[256] + pieces[257]}
    for bad in ([50256], [-1], [None]):
        with pytest.raises(PySparkException):
            B.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), ranks).collect()


def test_ranks_that_cannot_be_folded_are_refused():
    with pytest.raises(ValueError):
        B.Ranks({b"a": 0})
    with pytest.raises(ValueError):
        B.Ranks({bytes([b]): b for b in range(256)} | {b"abc": 256})
