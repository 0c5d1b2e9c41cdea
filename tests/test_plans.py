"""Plan-shape guards for the scale properties the design relies on."""

import contextlib
import io

from provenant.operators import quality
from provenant.plans.ingest import adapter_ingestion
from provenant.sources import adapters

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_upsert_limits_each_key_before_the_shuffle(spark):
    p = plan(adapter_ingestion(spark, SF).notices())
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_features_aggregate_partially_before_shuffling(spark):
    p = plan(adapter_ingestion(spark, SF).features())
    assert "partial_count" in p and "partial_sum" in p


def test_scans_read_only_needed_columns_and_broadcast_nation(spark):
    p = plan(adapters.raw_notices(spark, SF))
    orders_schema = [l for l in p.splitlines() if "ReadSchema" in l and "o_orderkey" in l][0]
    assert "o_totalprice" not in orders_schema
    assert "BroadcastExchange" in p


def test_duplicate_flag_uses_a_partial_min_per_hash(spark):
    ing = adapter_ingestion(spark, SF)
    p = plan(quality.repeated_hashes(ing.classified_notices))
    assert "partial_min" in p
