"""Hot keys: duplicate content flags of a written frame, review commands in one burst."""

import datetime
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F

from provenant.operators import quality


def _classified(spark, n=6000, partitions=8):
    """A written frame of which every third record has one content hash, with quarantined records and a null hash beside it."""
    i = F.col("id")
    rows = spark.range(0, n, 1, partitions).select(
        F.lit("run").alias("run_id"), F.lit("notice").alias("record_type"), i.cast("string").alias("record_id"), i.alias("ingest_seq"),
        F.when(i % 3 == 0, F.lit("hot")).when(i == 1, F.lit(None)).otherwise(F.concat(F.lit("h"), (i / 5).cast("long").cast("string"))).alias("_content_hash"),
        F.when(i % 10 == 9, F.lit("quarantined")).otherwise(F.lit("loaded")).alias("disposition"),
        F.struct(F.concat(F.lit("bid "), i.cast("string")).alias("bid_description")).alias("_src"))
    path = tempfile.mkdtemp(prefix="provenant-skew-", dir="/tmp") + "/classified"
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _plain(frame):
    first, out = {}, set()
    for r in sorted(frame.collect(), key=lambda r: r["ingest_seq"]):
        if r["disposition"] == "quarantined" or r["_content_hash"] is None:
            continue
        if r["_content_hash"] in first:
            out.add((r["record_id"], first[r["_content_hash"]]))
        first.setdefault(r["_content_hash"], r["ingest_seq"])
    return out


@pytest.mark.parametrize("hot_rows", [100, 10 ** 6])
def test_hot_hash_flags_equal_a_plain_pass(spark, hot_rows):
    frame = _classified(spark)
    got = {(r["record_id"], r["_first_seq"]) for r in quality.duplicate_content_flags(frame, hot_rows=hot_rows).collect()}
    assert got == _plain(frame) and len(got) > 2000


def test_a_broadcast_that_would_not_fit_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 100)
    frame = _classified(spark)
    got = {(r["record_id"], r["_first_seq"]) for r in quality.duplicate_content_flags(frame, hot_rows=1).collect()}
    assert got == _plain(frame)


def test_a_hot_hash_leaves_no_large_task(spark):
    flags = quality.duplicate_content_flags(_classified(spark), hot_rows=100)
    sizes = [r["count"] for r in flags.filter(F.col("_content_hash") == "hot").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * statistics.median(sizes)
    rest = [r["count"] for r in flags.filter(F.col("_content_hash") != "hot").groupBy(F.spark_partition_id()).count().collect()]
    assert max(rest) <= 2 * statistics.median(rest)
