"""Approximate search: recall and pruning on the given vectors, the bit bound, odd vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import retrieval
from provenant.plans import catalog_more

SF = "/root/testdata/sf0.1"


def test_recall_and_pruning_on_the_given_vectors(spark):
    rows = catalog_more.q_ann_recall(spark, SF).collect()
    corpus = catalog_more.corpus(spark, SF).count()
    assert len(rows) == catalog_more.ann_queries(spark, SF).count() >= 20
    assert sum(r["found"] for r in rows) >= 0.9 * sum(r["relevant"] for r in rows)
    assert sum(r["candidates"] for r in rows) < 0.2 * corpus * len(rows)


def test_a_tight_bound_loses_neighbours(spark):
    qs, index = catalog_more.ann_queries(spark, SF), catalog_more.ann_index(spark, SF)
    some = retrieval.ann_candidates(index, qs, 64, recall=0.05).count()
    assert some < retrieval.ann_candidates(index, qs, 64).count()


def test_scores_filters_and_order_are_exact(spark):
    pick = random.Random(2)
    rows = [(f"c{i}", "N" if i % 2 else "n", f"P{i % 3}", [pick.gauss(0, 1) for _ in range(16)], "m") for i in range(300)]
    rows += [("null", "N", "P0", None, "m"), ("short", "N", "P0", [1.0], "m"), ("zero", "N", "P0", [0.0] * 16, "m"), ("other", "N", "P0", rows[0][3], "m2"),
             ("copy", "N", "P0", rows[0][3], "m")]
    corpus = spark.createDataFrame(rows, "chunk_id string, country string, project_id string, embedding array<float>, embedding_model string")
    index = retrieval.with_signature(corpus, 16)
    queries = spark.createDataFrame([(0, rows[0][3], None, None, "m"), (1, rows[1][3], "n", "P1", "m"), (2, rows[2][3], "nowhere", None, "m")],
                                    "query_id int, embedding array<float>, country_filter string, project_filter string, embedding_model string")
    got = retrieval.ann_search(index, queries, 16, k=5, min_score=0.5, recall=0.999999).collect()
    exact = retrieval.semantic_search_batch(corpus.filter(F.size("embedding") == 16), queries, k=5, min_score=0.5) \
        .select("query_id", "rank", "chunk_id", "retrieval_score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact)) and len(got) > 2
    assert [r["chunk_id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))][:2] == ["c0", "copy"]


@pytest.mark.parametrize("score", [0.25, 0.5, 0.8])
def test_the_bit_bound_keeps_its_recall(score):
    pick = random.Random(4)
    p, bound = math.acos(score) / math.pi, retrieval.most_differing(score)
    differing = [sum(pick.random() < p for _ in range(512)) for _ in range(3000)]
    assert sum(d <= bound for d in differing) >= 0.93 * 3000


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "chunk_id string, country string, project_id string, embedding array<float>, embedding_model string")
    queries = spark.createDataFrame([(0, [1.0] * 16, None, None, "m")], "query_id int, embedding array<float>, country_filter string, project_filter string, embedding_model string")
    assert retrieval.ann_search(retrieval.with_signature(empty, 16), queries, 16).count() == 0


def test_blocks_find_what_every_pair_finds(spark, monkeypatch):
    """Odd vectors, copies with other ids, filters and repeated ids: the blocks' results are those of the plain cosine of all pairs."""
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 4)
    pick = random.Random(5)
    rows = [(f"c{i}", pick.choice(["N", "n", None]), f"P{i % 2}", [pick.gauss(0, 1) for _ in range(4)], "m") for i in range(120)]
    rows += [(f"copy{i}", "N", "P0", rows[0][3], "m") for i in range(40)] + [("long", "N", "P0", [3 * x for x in rows[1][3]], "m")]
    rows += [("null", "N", "P0", None, "m"), ("hole", "N", "P0", [1.0, None, 0.0, 0.0], "m"), ("nan", "N", "P1", [float("nan"), 1.0, 0.0, 0.0], "m"),
             ("zero", "N", "P0", [0.0] * 4, "m"), (None, "N", "P0", rows[2][3], "m"), ("other", "N", "P0", rows[0][3], "m2"), ("none", "N", "P0", rows[0][3], None)]
    corpus = spark.createDataFrame(rows, "chunk_id string, country string, project_id string, embedding array<float>, embedding_model string")
    asked = [(i, r[3], pick.choice([None, "N", "x"]), pick.choice([None, "P1"]), "m") for i, r in enumerate(rows[:10])]
    asked += [(20, rows[0][3], None, None, "m"), (21, None, None, None, "m"), (22, [0.0] * 4, None, None, "m"), (23, [float("inf"), 0.0, 0.0, 1.0], None, None, "m")]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>, country_filter string, project_filter string, embedding_model string")
    q = queries.withColumnsRenamed({"embedding": "e", "embedding_model": "qm"})
    every = corpus.join(q, (F.col("embedding_model") == F.col("qm"))
                        & (F.col("country_filter").isNull() | (F.lower("country") == F.lower("country_filter")))
                        & (F.col("project_filter").isNull() | (F.col("project_id") == F.col("project_filter")))) \
        .select("query_id", "chunk_id", retrieval.cosine(F.col("embedding"), F.col("e")).alias("s")).collect()
    got = {}
    for r in sorted(retrieval.semantic_search_batch(corpus, queries, k=5, min_score=0.3).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    want = {}
    for r in sorted((r for r in every if r["s"] is not None and not r["s"] < 0.3),
                    key=lambda r: (r["query_id"], -math.inf if math.isnan(r["s"]) else -r["s"], r["chunk_id"] is not None, r["chunk_id"] or "")):
        want.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {i: ids[:5] for i, ids in want.items()} and len(got) > 8


def test_vectors_of_one_row_group_are_many_tasks_work(spark, tmp_path):
    pick = random.Random(6)
    rows = [(f"c{i}", "N", "P", [pick.gauss(0, 1) for _ in range(16)], "m") for i in range(200)]
    corpus = spark.createDataFrame(rows, "chunk_id string, country string, project_id string, embedding array<float>, embedding_model string").coalesce(1)
    queries = corpus.limit(3).select(F.col("chunk_id").alias("query_id"), "embedding", F.lit(None).cast("string").alias("country_filter"),
                                     F.lit(None).cast("string").alias("project_filter"), "embedding_model")
    cores = spark.sparkContext.defaultParallelism
    index = retrieval.ann_index(corpus, str(tmp_path / "index"), 16)
    assert len(index.inputFiles()) >= cores
    pairs = retrieval.ann_candidates(index.coalesce(1), queries, 16, min_score=-0.9).select("chunk_id", F.spark_partition_id().alias("p"))
    assert pairs.select("p").distinct().count() >= cores


def test_vectors_of_another_length_still_fail(spark):
    corpus = spark.createDataFrame([("a", "N", "P", [1.0, 0.0], "m"), ("b", "N", "P", [1.0], "m")],
                                   "chunk_id string, country string, project_id string, embedding array<float>, embedding_model string")
    queries = spark.createDataFrame([(0, [1.0, 0.0], None, None, "m")], "query_id int, embedding array<float>, country_filter string, project_filter string, embedding_model string")
    with pytest.raises(Exception, match=retrieval.WRONG_DIMENSION):
        retrieval.semantic_search_batch(corpus, queries).collect()
