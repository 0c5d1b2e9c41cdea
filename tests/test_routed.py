"""Registered queries share routed records as scratch tables: nothing of an ingestion is cached in executors."""

from pyspark.sql import functions as F

from provenant.operators import quality
from provenant.plans import catalog, catalog_more
from provenant.plans.ingest import adapter_ingestion

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_registered_ingestion_caches_no_records(spark):
    i = catalog.ing(spark, SF)
    for df in (i.classified_notices, i.classified_awards, i.routed_notices, i.routed_awards):
        level = df.storageLevel
        assert not (level.useMemory or level.useDisk)
    assert "raw_json" not in i.routed_notices.columns and "raw_json" not in i.routed_awards.columns
    assert i.routed_notices is i.routed_notices  # written once


def test_routed_outputs_equal_those_of_the_classified_records(spark):
    kept, plain = catalog.ing(spark, SF), adapter_ingestion(spark, SF)
    assert rows(kept.issues()) == rows(plain.issues())
    assert rows(kept.chunks()) == rows(plain.chunks())
    assert rows(kept.dispositions()) == rows(plain.dispositions().drop("payload"))
    assert rows(kept.projects()) == rows(plain.projects())
    assert rows(quality.legacy_rejected_view(kept.dispositions())) == rows(quality.legacy_rejected_view(plain.dispositions()).drop("payload"))
    assert plain.dispositions().where(F.col("payload").isNull()).count() == 0


def test_evidence_reads_the_landed_text(spark):
    i, acc, runs, _, _ = catalog_more._evidence_parts(spark, SF)
    row = runs.first()
    assert len(row["checksum"]) == 64 and len(row["schema_hash"]) == 64
    assert acc.first()["balance_delta"] == 0
