"""Source ledgers of two runs, canonical JSON, and the read models built from them."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from provenant.functions.jsontext import canonical_json, canonical_text
from provenant.operators import drift, enrichment, readmodels
from provenant.plans.run import read_sink, run_migration
from provenant.sources import adapters

SF = "/root/testdata/sf0.001"


def _records(spark, rows):
    return spark.createDataFrame(rows, "record_type string, record_id string, raw_json string")


def test_keys_and_buckets_of_two_runs_name_what_changed(spark):
    one = _records(spark, [("notice", "a", '{"x":1,"y":2}'), ("notice", "b", '{"x":1}'), ("award", "a", '{"z":1}'), ("award", None, None)])
    two = _records(spark, [("notice", "a", '{"x":1}'), ("notice", "b", '{"x":1}'), ("notice", "c", '{"w":1,"x":3}'), ("award", "a", '{"z":1}')])
    keys = drift.source_keys(one, "1").unionByName(drift.source_keys(two, "2"))
    assert sorted(map(tuple, drift.key_changes(keys, "1", "2").collect())) == [("notice", "w", "added", 0, 1), ("notice", "y", "removed", 1, 0)]
    ledger = drift.source_buckets(one, "1").unionByName(drift.source_buckets(two, "2"))
    got = {(r.record_type, r.change, r.before_records, r.after_records) for r in drift.bucket_changes(ledger, "1", "2").collect()}
    assert got == {("notice", "changed", 1, 1), ("notice", "added", 0, 1), ("award", "removed", 1, 0)}
    assert drift.bucket_changes(ledger, "1", "1").count() == 0 and drift.key_changes(keys.limit(0), "1", "2").count() == 0


def test_digests_do_not_depend_on_order_but_on_repeats(spark):
    rows = [("notice", "a", '{"x":1}'), ("notice", "a", '{"x":2}'), ("notice", "a", '{"x":2}')]
    digest = lambda r: drift.source_buckets(_records(spark, r), "1").first().digest
    assert digest(rows) == digest(rows[::-1]) != digest(rows[:2])


def test_runs_append_their_source_ledgers_and_store_canonical_records(spark):
    out = tempfile.mkdtemp(prefix="provenant-run-", dir="/tmp")
    notices, awards = adapters.raw_notices(spark, SF), adapters.raw_awards(spark, SF)
    run_migration(spark, notices, awards, out, "run-1", 1)
    hit = notices.filter("project_id is not null and publication_date is not null").agg(F.max("id")).first()[0]
    extra = F.when(F.col("id") == hit, F.regexp_replace("raw_json", r"^\{", '{"added_key":"1",')).otherwise(F.col("raw_json"))
    run_migration(spark, notices.withColumn("raw_json", extra), awards, out, "run-2", 2)
    keys = drift.key_changes(read_sink(spark, out, "source_keys"), "run-1", "run-2").collect()
    assert [tuple(r) for r in keys] == [("notice", "added_key", "added", 0, 1)]
    changed = drift.bucket_changes(read_sink(spark, out, "source_buckets"), "run-1", "run-2").collect()
    bucket = spark.range(1).select(F.substring(F.sha2(F.lit(hit), 256), 1, 2)).first()[0]
    assert [(r.record_type, r.bucket, r.change) for r in changed] == [("notice", bucket, "changed")]
    for name in ("notices", "awards"):
        for row in read_sink(spark, out, name).select("raw_json").limit(50).collect():
            assert row.raw_json == json.dumps(json.loads(row.raw_json), sort_keys=True, ensure_ascii=False)


@pytest.mark.parametrize("text, want", [
    ('{"b":{"d":1,"c":[{"f":1,"e":2}]},"a":"\\u00e9\\/"}', '{"a": "é/", "b": {"c": [{"e": 2, "f": 1}], "d": 1}}'),
    ('{"a":1.10,"b":1e3,"c":12345678901234567890123456789012345678901}', '{"a": 1.1, "b": 1000.0, "c": 12345678901234567890123456789012345678901}'),
    ('{"a":1,"a":2}', '{"a": 2}'), ("", ""), ("no json", "no json"), (None, None), ('"\\ud800"', '"\\ud800"'),
    ("[" * 100_000, "[" * 100_000)])
def test_canonical_json(spark, text, want):
    assert canonical_text(text) == want
    frame = spark.createDataFrame([(text,), (None,)], "t string")
    assert {r[0] for r in frame.select(canonical_json("t")).collect()} == {want, None}


def test_country_context_states(spark):
    countries = spark.createDataFrame([("India",), ("Western Africa",), ("Nowhere",), (None,)], "country string")
    indicators = spark.createDataFrame([("India", "G", 2020, 1.0), ("India", "G", 2021, None), ("India", "P", 2021, 5.0)],
                                       "country string, indicator string, year int, value double")
    known = spark.createDataFrame([("India", "IN", "Asia", "INR")], "country string, code string, region string, currencies string")
    got = {r.country: r for r in enrichment.country_context(countries, indicators, known, {"gdp": "G", "population": "P"}).collect()}
    assert {k: r.context_status for k, r in got.items()} == {"India": "ready", "Western Africa": "regional", "Nowhere": "unavailable", None: "unavailable"}
    assert (got["India"].gdp, got["India"].gdp_year, got["India"].population, got["India"].code) == (1.0, 2020, 5.0, "IN")
    assert got["Nowhere"].gdp is None


def test_unknown_project_has_no_rows(spark):
    from provenant.plans.ingest import adapter_ingestion
    i = adapter_ingestion(spark, SF, persist=True)
    frames = (i.projects(), i.features(), i.notices(), i.awards())
    orphan = i.notices().join(i.projects(), "project_id", "left_anti").filter("project_id is not null").first().project_id
    assert readmodels.project_360(*frames, orphan).count() == 0
    known = i.notices().join(i.projects().select("project_id"), "project_id").first().project_id
    rows = readmodels.project_360(*frames, known.lower()).groupBy("section").count().collect()
    counts = {r["section"]: r["count"] for r in rows}
    assert counts["project"] == counts["features"] == 1
    assert counts["notice"] == i.notices().filter(F.col("project_id") == known).count()
