"""Feeds, landed records and chunks are computed once, and written results leave no shuffle files."""

import math
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from provenant.operators import evidence, retrieval, review
from provenant.operators.index import ChunkIndex
from provenant.operators.tables import shuffles_removed
from provenant.plans.ingest import build_ingestion
from provenant.sources import adapters
from provenant.streaming import jobs
from provenant.streaming.common import feed_in_slices


def counted(spark, df, column):
    """``df`` whose rows are counted whenever they are computed."""
    seen = spark.sparkContext.accumulator(0)

    def see(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(see, LongType()).asNondeterministic()(column)), seen


class Ended:
    def awaitTermination(self):
        return None

    def exception(self):
        return None


def test_a_feed_is_computed_once_for_all_slices(spark):
    df, seen = counted(spark, spark.range(40), "id")
    landing = tempfile.mkdtemp(prefix="provenant-feed-", dir="/tmp") + "/landing"
    ends = []
    feed_in_slices(df, landing, "id", lambda: ends.append(spark.read.parquet(landing).count()) or Ended(), 4, "parquet")
    assert seen.value == 40 and len(ends) == 4 and ends == sorted(set(ends)) and ends[-1] == 40
    assert spark.read.parquet(landing).columns == ["id"]


def test_rows_without_an_order_key_are_fed_and_columns_named(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (None, "d")], "k long, value string")
    landing = tempfile.mkdtemp(prefix="provenant-feed-", dir="/tmp") + "/landing"
    feed_in_slices(df, landing, F.col("k") * 2, Ended, 2, "text", columns=["value"])
    assert sorted(r.value for r in spark.read.text(landing).collect()) == ["a", "b", "c", "d"]


def _feeds(spark, rows=6):
    notices = spark.range(rows).select(*[F.lit("x").alias(c) for c in adapters.NOTICE_COLUMNS], F.col("id").alias("ingest_seq"))
    awards = spark.range(rows + 3).select(*[F.array(F.lit("s")).alias(c) if c in ("supp_name", "mjsecname") else F.lit("y").alias(c) for c in adapters.AWARD_COLUMNS],
                                          F.col("id").cast("string").alias("ingest_seq"))
    return notices.withColumn("raw_json", F.to_json(F.struct("id", "ingest_seq", F.when(F.col("ingest_seq") > 2, "z").alias("extra")))), \
        awards.withColumn("raw_json", F.to_json(F.struct("contr_id", "ingest_seq")))


def test_landed_facts_give_the_same_checksum_counts_and_fingerprint(spark):
    notices, awards = _feeds(spark)
    plain = build_ingestion(spark, notices, awards)
    checksum = evidence.run_checksum(plain).first()
    keys = evidence.schema_fingerprint(notices, awards).first()
    counts = sorted(map(tuple, plain.source_counts().collect()))
    noted, seen = counted(spark, notices, "ingest_seq")
    own = build_ingestion(spark, noted, awards, routed=True)
    landed = own.landed_facts()
    assert evidence.run_checksum(own, landed).first() == checksum
    assert evidence.fingerprint_of_keys(landed.select("keys")).first() == keys
    assert sorted(map(tuple, own.source_counts().collect())) == counts == [("award", 9), ("notice", 6)]
    assert own.landed_facts() is landed and seen.value <= 6  # no second pass over the source


def test_landed_facts_of_empty_feeds_and_records_without_text(spark):
    notices, awards = _feeds(spark)
    own = build_ingestion(spark, notices.limit(0), awards.limit(0))
    landed = own.landed_facts()
    assert sorted(map(tuple, own.source_counts().collect())) == [("award", 0), ("notice", 0)]
    assert evidence.run_checksum(own, landed).first() == evidence.run_checksum(own).first()
    none = notices.withColumn("raw_json", F.when(F.col("ingest_seq") > 1, F.col("raw_json")))
    own = build_ingestion(spark, none, awards)
    assert evidence.run_checksum(own, own.landed_facts()).first() == evidence.run_checksum(own).first()


def test_each_micro_batch_classifies_once(spark, monkeypatch):
    made = []

    def noted(*args, **kwargs):
        made.append(build_ingestion(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(jobs, "build_ingestion", noted)
    notices, awards = _feeds(spark)
    monkeypatch.setattr(jobs.adapters, "raw_notices", lambda spark, sf: notices)
    monkeypatch.setattr(jobs.adapters, "raw_awards", lambda spark, sf: awards)
    jobs.stream_ingest(spark, "none", slices=1)
    assert made
    for i in made:
        assert len(i.classified_notices.inputFiles()) > 0 and all("classified-" in f for f in i.classified_notices.inputFiles())


def test_review_issues_are_written_once(spark):
    rows = spark.createDataFrame([(1, "DQ-001", "notice", "n1")], "n long, control_id string, record_type string, record_id string")
    df, seen = counted(spark, rows, "n")
    issues = review.read_issues(df.withColumn("issue_id", F.col("n").cast("string")))
    assert issues.count() == issues.filter("issue_id = '1'").count() == 1 and seen.value == 1
    assert issues.columns == ["issue_id", "control_id", "record_type", "record_id"]


def test_one_row_an_id_is_embedded(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        model_name, dimensions = "counting-2", 2

        def encode(self, texts):
            seen.add(len(texts))
            return [[1.0, float(len(t))] for t in texts]

    own = ChunkIndex(spark, tempfile.mkdtemp(prefix="provenant-index-", dir="/tmp"), Counting(), buckets=2)
    schema = "chunk_id string, record_type string, record_id string, project_id string, text string, official_url string, country string"
    rows = [("c", "notice", "n", None, "t" * (k + 1), None, "X") for k in range(9)] + [("d", "notice", "n", None, "a", None, None)]
    own.index_documents(spark.createDataFrame(rows, schema), 1)
    assert {r.chunk_id: (r.text, [float(x) for x in r.embedding]) for r in own.documents().collect()} == {"c": ("t" * 9, [1.0, 9.0]), "d": ("a", [1.0, 1.0])}
    assert seen.value == 2


@pytest.mark.parametrize("query", [[0.0, 2.0, 0.0, 1.0], [0.0] * 4, [1.0, 1.0, 1.0, 1.0]])
def test_query_cosine_is_the_cosine(spark, query, monkeypatch):
    vectors = [[1.0, 2.0, 0.0, 4.0], [0.0] * 4, None, [1.0, None, 0.0, 0.0], [math.nan, 0.0, 1.0, 0.0], [math.inf, 0.0, 1.0, 0.0], [-1.0, -0.0, 3.0, 0.5]]
    df = spark.createDataFrame([(v,) for v in vectors], "embedding array<float>")
    plain = retrieval.dot(F.col("embedding"), F.col("embedding"))
    want = [r[0] for r in df.select(retrieval.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in query]))).collect()]
    for most in (64, 1):
        monkeypatch.setattr(retrieval, "SUMMED_VALUES", most)
        got = [r[0] for r in df.select(retrieval.query_cosine(F.col("embedding"), retrieval.norm(F.col("embedding")), query)).collect()]
        assert [repr(x) for x in got] == [repr(x) for x in want]
    assert [repr(r[0]) for r in df.select(F.sqrt(plain)).collect()] == [repr(r[0]) for r in df.select(retrieval.norm(F.col("embedding"))).collect()]


def test_written_results_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == before


def test_workers_of_the_alignment_take_small_slabs():
    from provenant.llm import token_alignment

    assert token_alignment.SLAB_BYTES <= 1 << 17
