"""A full migration run writes every sink; replaying it is idempotent."""

import tempfile

import pytest
from pyspark.sql import functions as F

from provenant.operators import retrieval
from provenant.operators.index import ChunkIndex
from provenant.plans.run import base_version, curated_table, read_sink, run_from_tables, run_migration
from provenant.sources import adapters

SF = "/root/testdata/sf0.001"


def test_replayed_runs_are_idempotent(spark):
    out = tempfile.mkdtemp(prefix="provenant-run-", dir="/tmp")
    run_from_tables(spark, SF, out, "run-1", 1)
    first = {t: read_sink(spark, out, t).count() for t in ("notices", "awards", "projects", "features", "chunks")}
    run_from_tables(spark, SF, out, "run-2", 2)
    second = {t: read_sink(spark, out, t).count() for t in ("notices", "awards", "projects", "features", "chunks")}
    assert first == second and first["notices"] > 0
    runs = read_sink(spark, out, "runs").collect()
    assert sorted(r["run_id"] for r in runs) == ["run-1", "run-2"]
    assert all(r["records_read"] == r["accepted"] + r["rejected"] + r["quarantined"] for r in runs)
    ev = read_sink(spark, out, "evidence").collect()
    assert {r["reconciliation_status"] for r in ev} == {"balanced"} and len(ev) == 2
    assert len({r["evidence_hash"] for r in ev}) == 2  # the run id is part of the evidence
    maps = read_sink(spark, out, "mapping_executions")
    assert maps.count() == 4
    # replaying run-2 rewrites its own partitions and version: nothing doubles
    run_from_tables(spark, SF, out, "run-2", 2)
    assert read_sink(spark, out, "issues").filter(F.col("run_id") == "run-2").count() == \
        read_sink(spark, out, "issues").filter(F.col("run_id") == "run-1").count()
    assert read_sink(spark, out, "notices").count() == first["notices"]


def test_a_gap_in_the_run_sequence_keeps_history(spark):
    out = tempfile.mkdtemp(prefix="provenant-run-", dir="/tmp")
    run_from_tables(spark, SF, out, "run-1", 1)
    before = read_sink(spark, out, "notices").count()
    few, some = adapters.raw_notices(spark, SF).limit(10), adapters.raw_awards(spark, SF).limit(10)
    run_migration(spark, few, some, out, "run-3", 3)
    assert read_sink(spark, out, "notices").count() == before
    runs = {r["run_id"]: r["records_read"] for r in read_sink(spark, out, "runs").collect()}
    assert runs["run-3"] == 20


def test_history_without_its_base_is_an_error(spark):
    out = tempfile.mkdtemp(prefix="provenant-run-", dir="/tmp")
    rows = spark.createDataFrame([("n-1", 1)], "notice_id string, run_seq long")
    curated_table(spark, out, "notices").upsert(rows, ["run_seq"], 1)
    with pytest.raises(RuntimeError, match="incomplete"):
        base_version(spark, out, 2)
    assert base_version(spark, out, 1) is None


def test_a_small_run_rewrites_few_buckets_and_indexes_its_chunks(spark):
    out = tempfile.mkdtemp(prefix="provenant-run-", dir="/tmp")
    run_from_tables(spark, SF, out, "run-1", 1)
    notices, awards = adapters.raw_notices(spark, SF), adapters.raw_awards(spark, SF)
    run_migration(spark, notices.orderBy("ingest_seq").limit(10), awards.orderBy("ingest_seq").limit(2), out, "run-2", 2,
                  embedder=retrieval.HashEmbedder())
    table = curated_table(spark, out, "notices")
    first, second = table.manifest(1)["buckets"], table.manifest(2)["buckets"]
    assert len(first) == 16 and set(second) == set(first)
    assert 1 <= sum(first[b] != second[b] for b in first) <= 10
    index = ChunkIndex(spark, f"{out}/index", retrieval.HashEmbedder())
    assert index.readiness()["indexed_documents"] == read_sink(spark, out, "chunks").count()


@pytest.mark.parametrize("broken", ["called", "read"])
def test_a_failing_source_closes_the_run_and_is_thrown_on(spark, broken):
    out = tempfile.mkdtemp(prefix="provenant-run-", dir="/tmp")

    def unavailable():
        if broken == "called":
            raise TimeoutError("the source is unavailable")
        return adapters.raw_awards(spark, SF).withColumn("contr_desc", F.expr("cast(raise_error('the source is unavailable') as string)"))

    with pytest.raises(Exception, match="the source is unavailable"):
        run_migration(spark, adapters.raw_notices(spark, SF), unavailable, out, "run-1", 1)
    run = read_sink(spark, out, "runs").collect()
    assert len(run) == 1 and run[0]["status"] == "failed_source" and run[0]["completed_at"] is not None
    assert run[0]["records_read"] == run[0]["accepted"] == run[0]["rejected"] == run[0]["quarantined"] == 0
    assert curated_table(spark, out, "notices").versions() == []
    events = spark.read.parquet(f"{out}/ledgers/run_events").orderBy("position").collect()
    assert [e["status"] for e in events] == ["running", "failed_source"]
    run_from_tables(spark, SF, out, "run-1", 1)  # the same run, once its source answers
    assert read_sink(spark, out, "runs").first()["status"] == "completed"
    assert spark.read.parquet(f"{out}/ledgers/run_events").count() == 4
