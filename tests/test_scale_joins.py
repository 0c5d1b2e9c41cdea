"""Raw records are built and classified without large broadcasts and without computing a value again."""

from provenant.operators import quality
from provenant.plans import ingest
from provenant.sources import adapters, tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_sides_that_grow_are_broadcast_by_their_counted_rows(spark, monkeypatch):
    few = [adapters.raw_notices(spark, SF), adapters.raw_awards(spark, SF)]
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    many = [adapters.raw_notices(spark, SF), adapters.raw_awards(spark, SF)]
    for a, b, kept in zip(few, many, (1, 1), strict=True):
        assert plan(b).count("BroadcastHashJoin") == kept  # the nations
        assert rows(a) == rows(b)


def test_classification_computes_standardized_values_once(spark):
    notices = quality.classify_notices(adapters.raw_notices(spark, SF), "r")
    assert plan(notices).count("gettimestamp") <= 6 < plan(notices).count("trim")
    assert plan(quality.classify_awards(adapters.raw_awards(spark, SF), "r", "u")).count("RLIKE") <= 12


def test_routed_records_are_not_copied_whole(spark):
    i = ingest.adapter_ingestion(spark, SF, routed=True)
    for df in (i.classified_notices, i.classified_awards):
        assert set(df.schema["_src"].dataType.fieldNames()) <= set(quality.ROUTED_SOURCE_FIELDS)
