"""Registered queries of the written chunk index and of the run event log.

The index is built once a session and tables folder: version 1 holds drafts of the notices and projects (other text, no
country) beside the awards; version 2 indexes the notices and projects again and so replaces their rows.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, retrieval
from ..operators.index import ChunkIndex
from ..operators.tables import scratch_table
from ..session import scratch_path
from .catalog import ing, register
from .catalog_more import _KEYS_SQL, _evidence_parts, corpus
from .ingest import DEFAULT_RUN_AT
from .oracle import RUN_ID

MODEL = retrieval.HashEmbedder.model_name
# Text searches: (id, text, country filter, project filter); the last two find nothing.
TEXT_QUERIES = [(1, "red widget for nation_7", None, None), (2, "Machinery, supply lot URGENT", "nation_17", None),
                (3, "small anvil", None, "P100002"), (4, "zebra quartz", None, None), (5, "hot gizmo", "nowhere", None)]
LIMIT = 8

_INDEXES: dict = {}


class StoredVectors:
    """Stands for the model of vectors that were made elsewhere; it encodes nothing."""

    model_name, dimensions = "driver-64d", 64

    def encode(self, texts: list[str]) -> list[list[float]]:
        raise retrieval.RetrievalConfigurationError("the vectors' model is not here")


def chunk_index(spark, sf) -> ChunkIndex:
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _INDEXES:
        index = ChunkIndex(spark, scratch_path(spark, "chunk-index"), retrieval.HashEmbedder())
        chunks = scratch_table(ing(spark, sf).chunks(), "index-chunks")  # read by both versions
        draft = F.col("record_type") != "award"
        index.index_documents(chunks.withColumn("text", F.when(draft, F.concat(F.lit("draft "), "record_id")).otherwise(F.col("text")))
                              .withColumn("country", F.when(~draft, F.col("country"))), 1)
        index.index_documents(chunks.filter(draft), 2)
        _INDEXES[key] = index
    return _INDEXES[key]


def vector_index(spark, sf) -> ChunkIndex:
    index = ChunkIndex(spark, scratch_path(spark, "vector-index"), StoredVectors())
    index.index_vectors(corpus(spark, sf).withColumn("text", F.lit(None).cast("string")).withColumn("metadata", F.lit(None).cast("string")), 1)
    return index


def _quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_TOKENS_SQL = ("SELECT {id}, CAST(CAST(('0x' || substr(sha256(token), 1, 8)) AS BIGINT) % 256 AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS cnt "
               "FROM (SELECT {id}, unnest(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}'))) AS token FROM {table}) GROUP BY ALL")
_SEARCH_SQL = (", tq(query_id, query, country_filter, project_filter) AS (VALUES "
               + ", ".join(f"({i}, {_quoted(t)}, CAST({_quoted(c)} AS VARCHAR), CAST({_quoted(p)} AS VARCHAR))" for i, t, c, p in TEXT_QUERIES) + "), "
               "dt AS (" + _TOKENS_SQL.format(id="chunk_id", text="text", table="chunks") + "), "
               "qt AS (" + _TOKENS_SQL.format(id="query_id", text="query", table="tq") + "), "
               "dn AS (SELECT chunk_id, sqrt(sum(cnt * cnt)) AS n FROM dt GROUP BY chunk_id), "
               "qn AS (SELECT query_id, sqrt(sum(cnt * cnt)) AS n FROM qt GROUP BY query_id), "
               "sim AS (SELECT qt.query_id, dt.chunk_id, sum(qt.cnt * dt.cnt) AS s FROM qt JOIN dt USING (bucket) GROUP BY ALL), "
               "found AS (SELECT q.query_id, c.*, sim.s / (qn.n * dn.n) AS score FROM sim JOIN tq q USING (query_id) JOIN chunks c USING (chunk_id) "
               "JOIN qn USING (query_id) JOIN dn USING (chunk_id) WHERE (q.country_filter IS NULL OR lower(c.country) = lower(q.country_filter)) "
               "AND (q.project_filter IS NULL OR c.project_id = q.project_filter)), "
               f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM found) "
               f"WHERE rank <= {LIMIT} AND score >= 0.25) ")

_DOCUMENTS = ["chunk_id", "record_type", "record_id", "project_id", "text", "official_url", "country"]


@register("index_upsert", f"SELECT {', '.join(_DOCUMENTS)}, '{MODEL}' AS embedding_model, 256 AS dimensions FROM chunks")
def q_index_upsert(spark, sf):
    return chunk_index(spark, sf).documents().select(*_DOCUMENTS, "embedding_model", F.size("embedding").alias("dimensions"))


@register("index_counts",
          "SELECT 'driver-64d' AS embedding_model, count(*) AS indexed_documents, CASE WHEN count(*) > 0 THEN 'ready' END AS status FROM embeddings "
          f"UNION ALL SELECT '{MODEL}', count(*), CASE WHEN count(*) > 0 THEN 'ready' END FROM chunks")
def q_index_counts(spark, sf):
    indexes = [chunk_index(spark, sf), vector_index(spark, sf)]
    for index in indexes:
        index.readiness()
    counts = indexes[0].counts().unionByName(indexes[1].counts())
    return counts.withColumn("status", F.when(F.col("indexed_documents") > 0, F.lit("ready")))


@register("embed_chunks",
          ", t AS (" + _TOKENS_SQL.format(id="chunk_id", text="text", table="chunks") + ") "
          f"SELECT c.chunk_id, '{MODEL}' AS embedding_model, 256 AS dimensions, coalesce(s.used, 0) AS used, coalesce(s.heaviest, 0) AS heaviest "
          "FROM chunks c LEFT JOIN (SELECT chunk_id, count(*) AS used, round(max(cnt) / sqrt(sum(cnt * cnt)), 4) AS heaviest FROM t GROUP BY chunk_id) s "
          "USING (chunk_id)")
def q_embed_chunks(spark, sf):
    """The pluggable path: every chunk through ``encode`` in Arrow batches."""
    emb = retrieval.embed_with(ing(spark, sf).chunks(), retrieval.HashEmbedder)
    return emb.select("chunk_id", "embedding_model", F.size("embedding").alias("dimensions"),
                      F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("used"),
                      F.round(F.array_max("embedding").cast("double"), 4).alias("heaviest"))


@register("semantic_search", _SEARCH_SQL +
          "SELECT chunk_id, record_type, record_id, project_id, text, official_url, country, round(score, 4) AS retrieval_score FROM best WHERE query_id = 2")
def q_semantic_search(spark, sf):
    """A text with a country filter over the written index."""
    _, text, country, project = TEXT_QUERIES[1]
    return chunk_index(spark, sf).search_rows(text, country, project, LIMIT)


@register("query_log", _SEARCH_SQL +
          f"SELECT q.query, q.country_filter, q.project_filter, '{MODEL}' AS embedding_model, coalesce(b.n, 0) AS result_count, "
          "coalesce(b.n, 0) = 0 AS abstained FROM tq q LEFT JOIN (SELECT query_id, count(*) AS n FROM best GROUP BY query_id) b USING (query_id)")
def q_query_log(spark, sf):
    """The log rows that five searches append."""
    index = chunk_index(spark, sf)
    runs = [index.search(text, country, project, LIMIT).run_id for _, text, country, project in TEXT_QUERIES]
    return index.query_log().filter(F.col("run_id").isin(runs)).drop("run_id", "latency_ms", "searched_at")


# =============================================================================== run events

_EVENTS: dict = {}


def run_events(spark, sf) -> DataFrame:
    """The log of three runs: the ingestion, and one before and one after it whose sources failed."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _EVENTS:
        path = scratch_path(spark, "run-events")
        hour = datetime.timedelta(hours=1)
        evidence.append_run_event(evidence.run_event(spark, RUN_ID, "running", DEFAULT_RUN_AT), path, 0, DEFAULT_RUN_AT)
        for run, at in (("run-0000", DEFAULT_RUN_AT - hour), ("run-0002", DEFAULT_RUN_AT + hour)):
            evidence.append_run_event(evidence.run_event(spark, run, "running", at), path, 0, at)
            evidence.append_run_event(evidence.run_event(spark, run, "failed_source", at, at), path, 1, at)
        evidence.append_run_event(_evidence_parts(spark, sf)[2], path, 1, DEFAULT_RUN_AT)
        _EVENTS[key] = path
    return spark.read.parquet(_EVENTS[key])


_RUNS_SQL = (", runs AS (SELECT '" + RUN_ID + "' AS run_id, 1 AS started, "
             "CASE WHEN (SELECT count(*) FROM raw_notice) + (SELECT count(*) FROM raw_award) = sum(n) THEN 'completed' ELSE 'failed_accounting' END AS status, "
             "CAST((SELECT count(*) FROM raw_notice) + (SELECT count(*) FROM raw_award) AS BIGINT) AS records_read, "
             + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE disposition = '{d}'), 0) AS BIGINT) AS {c}"
                         for d, c in (("loaded", "accepted"), ("rejected", "rejected"), ("quarantined", "quarantined"))) +
             ", TRUE AS has_checksum, (SELECT sha256('[' || string_agg('\"' || key || '\"', ', ' ORDER BY key) || ']') FROM (" + _KEYS_SQL + ")) AS schema_hash "
             "FROM routing UNION ALL SELECT 'run-0000', 0, 'failed_source', 0, 0, 0, 0, FALSE, NULL UNION ALL "
             "SELECT 'run-0002', 2, 'failed_source', 0, 0, 0, 0, FALSE, NULL) ")


@register("run_ledger", _RUNS_SQL + "SELECT run_id, status, records_read, accepted, rejected, quarantined, has_checksum, schema_hash FROM runs")
def q_run_ledger(spark, sf):
    return evidence.run_states(run_events(spark, sf)).select(
        "run_id", "status", "records_read", "accepted", "rejected", "quarantined", F.col("checksum").isNotNull().alias("has_checksum"), "schema_hash")


@register("runs_feed", _RUNS_SQL + "SELECT run_id, status, records_read, accepted, rejected, quarantined FROM runs ORDER BY started DESC LIMIT 2")
def q_runs_feed(spark, sf, limit: int = 2):
    runs = evidence.run_states(run_events(spark, sf))
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit) \
        .select("run_id", "status", "records_read", "accepted", "rejected", "quarantined")
