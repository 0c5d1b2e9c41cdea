"""The batched merges of byte-level BPE against the library and the folds, without literals of words in the plan."""

import random

import public_tokenizers
import tiktoken

from provenant.llm import byte_bpe as B


def test_batched_and_long_merges_equal_the_library_and_the_folds(spark, monkeypatch):
    ranks = B.read_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(11)
    texts = [" ".join("".join(pick.choice("aabcdehinorst日é") for _ in range(pick.randint(1, 260))) for _ in range(9)) for _ in range(20)]
    texts += ["a" * 5000, "ab" * 900 + " " * 400, "", None, "the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in B.folded(docs.where("doc_id >= 18"), ranks).collect()} == {i: ids for i, ids in want.items() if i >= 18}

    def refused(*_, **__):
        raise AssertionError("words were counted and brought to the driver")

    monkeypatch.setattr(B, "frequent_words", refused)
    assert {r.doc_id: r.ids for r in B.encode(docs, ranks).collect()} == want
    monkeypatch.setattr(B, "SLAB_WORDS", 3)
    monkeypatch.setattr(B, "MERGED_ROWS", 2)
    assert {r.doc_id: r.ids for r in B.encode(docs, ranks).collect()} == want
