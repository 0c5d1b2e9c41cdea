"""Registered queries against their DuckDB oracle on the sf0.001 tables
(the full set is compared at sf0.01 by ``tools_check.py``)."""

import duckdb
import pytest

import __spark_entry__ as E
from provenant.sources.tables import TABLES
from tools_check import canon

SF = "/root/testdata/sf0.001"
SAMPLE = ["quality_summary", "append_issue_ledger", "upsert_latest", "insert_if_absent", "apply_mapping",
          "project_features", "build_chunks", "record_accounting", "schema_fingerprint", "payload_checksum",
          "token_vocabulary", "hash_embed", "semantic_search_batch", "retrieval_metrics", "review_current_state",
          "review_event_history", "migration_evidence", "release_readiness", "fx_convert", "country_context",
          "index_upsert", "index_counts", "semantic_search", "query_log", "embed_chunks", "run_ledger", "runs_feed",
          "dq008_duplicate_content"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_oracle_names_a_registered_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols, orows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert canon(rows, cols) == canon(orows, ocols)
