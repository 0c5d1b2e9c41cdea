"""Ranked lexical search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import lexical_search as L

TERM = re.compile(L.TERM)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items):
    terms = [(d, TERM.findall(low(t))) for d, t in docs]
    counted = [(d, len(x), Counter(x)) for d, x in terms]
    many, total = sum(n > 0 for _, n, _ in counted), sum(n for _, n, _ in counted)
    out = []
    for item, text in items:
        found = []
        own = set(TERM.findall(low(text)))
        for d, n, tf in counted:
            m = 10 + 90 * n * many // max(total, 1)
            score = 0
            for t in own & set(tf):
                df = sum(t in c for _, _, c in counted)
                score += math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        found.sort()
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(found[:10])]
    return sorted(out, key=str)


def ran(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7, [0]) for i, t in docs], "doc_id long, text string, item int, terms array<int>").repartition(3)
    i = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in L.search(d, i).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    pick = random.Random(11)
    words = [f"w{i}" for i in range(120)] + ["Ñandú", "日本", "a1", "THE"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(pick.choices(words, weights, k=pick.choice((1, 3, 10, 40, 200))))) for k in range(300)]
    docs += [(None, "w1 w2 the"), (5, docs[5][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "-- !?"), (903, "x" * 30000 + " w3 " * 9000)]
    docs += [(1000 + k, "w40 w41 w42") for k in range(30)]
    items = [(k, " ".join(pick.choices(words, k=pick.choice((1, 2, 5, 30))))) for k in range(25)]
    items += [(100, None), (101, "nowhere else"), (102, ""), (None, "W1 w1 the THE"), (3, "w9 repeated id"), (104, docs[7][1] + " " + docs[9][1]), (105, "w42,w41.w40")]
    return docs, items


def test_equals_a_plain_ranking(spark, tables):
    assert ran(spark, *tables) == plain(*tables)


def test_buckets_blocks_and_seeds_change_nothing(spark, tables, monkeypatch):
    expected = plain(*tables)
    for name, value in (("BUCKET", 16), ("BLOCK_TERMS", 20), ("SEED_OF", 2)):
        monkeypatch.setattr(L, name, value)
    assert ran(spark, *tables) == expected


def test_bounds_leave_out_vectors():
    pick = np.random.default_rng(1)
    terms = np.concatenate([np.sort(pick.choice(50, 5, replace=False)) for _ in range(400)])
    impacts = pick.integers(1, 1000, len(terms))
    bounds = np.arange(0, len(terms) + 1, 5)
    lengths = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, bounds[:-1]))
    bucket = L._Bucket(terms, impacts, bounds, lengths, 50)
    items = L.Items([np.array([3, 7, 9, 20])], np.arange(1, 51))
    exact = bucket.scores(items, 0, np.arange(400), np.zeros(50, dtype=np.int64))
    for least in (1, 1000, 10000, 30000):
        some = bucket.survivors(items, 0, least)
        assert set(np.flatnonzero(exact >= least)) <= set(some.tolist())
    assert len(bucket.survivors(items, 0, int(np.sort(exact)[-10]))) < 200


def test_empty_tables(spark, tables):
    docs, items = tables
    assert ran(spark, [], items) == [] and ran(spark, docs, []) == [] and ran(spark, [(1, None)], items) == []


def test_fewer_than_ten_and_a_term_in_every_document(spark):
    docs, items = [(1, "a b"), (2, "a c"), (3, "a")], [(1, "a"), (2, "a b c"), (3, "c")]
    assert ran(spark, docs, items) == plain(docs, items)
