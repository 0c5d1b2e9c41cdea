"""Registered queries: one Spark plan per operator, each with its DuckDB oracle.

Every query reads the driver tables (through the adapters) at whatever scale
``sf_dir`` holds; nothing is sampled or capped except where a limit is the
operator itself (tail sample, top-k feeds).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONTROL_CATALOG
from ..functions import text as T
from ..functions.hashing import content_hash
from ..operators import contracts, curate, quality
from ..operators.tables import write_snapshot
from ..functions.jsontext import canonical_json
from ..session import scratch_path
from ..sources import adapters, snapshots
from . import oracle
from .ingest import adapter_ingestion

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle.q(sql)
        return fn
    return deco


_INGESTIONS: dict = {}


def ing(spark: SparkSession, sf_dir: str):
    """One ingestion run per (application, tables folder), shared by every registered query of the session.

    Each feed's routed records are a table in the scratch folder, written when a query first reads them: their
    classification is computed once, and no executor holds them. Landed text, which few queries read, is computed where it is read."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _INGESTIONS:
        _INGESTIONS[key] = adapter_ingestion(spark, sf_dir, routed=True)
    return _INGESTIONS[key]


NOTICE_OUT = ["notice_id", "project_id", "title", "country", "country_code", "category", "method",
              "publication_date", "deadline_date", "sector", "official_url", "quality_score"]
ISSUE_OUT = ["issue_id", "run_id", "control_id", "severity", "result", "record_type", "record_id",
             "source_field", "original_value", "normalized_value", "recommended_handling"]
_ISSUE_SQL = ", ".join(ISSUE_OUT)
_RAW_NOTICE_SQL = ", ".join(adapters.NOTICE_COLUMNS)

# =============================================================================== 2.1 sources / sinks


@register("read_notice_snapshot", f"SELECT {_RAW_NOTICE_SQL}, ingest_seq FROM raw_notice")
def q_read_notice_snapshot(spark, sf):
    path = scratch_path(spark, "landed-notices")
    snapshots.land_records(adapters.raw_notices(spark, sf), path)
    return snapshots.read_landed(spark, path, adapters.NOTICE_COLUMNS).select(*adapters.NOTICE_COLUMNS, "ingest_seq")


_AWARD_TEXT_SQL = ", ".join(
    f"CAST(to_json({c}) AS VARCHAR) AS {c}" if c in ("supp_name", "mjsecname") else c for c in adapters.AWARD_COLUMNS)


@register("read_award_snapshot", f"SELECT {_AWARD_TEXT_SQL}, ingest_seq FROM raw_award")
def q_read_award_snapshot(spark, sf):
    path = scratch_path(spark, "landed-awards")
    snapshots.land_records(adapters.raw_awards(spark, sf), path)
    return snapshots.read_landed(spark, path, adapters.AWARD_COLUMNS, seq_type="string") \
        .select(*adapters.AWARD_COLUMNS, "ingest_seq")


@register("tail_sample", "SELECT id, project_id, ingest_seq FROM raw_notice ORDER BY ingest_seq DESC LIMIT 300")
def q_tail_sample(spark, sf, n: int = 300):
    return adapters.raw_notices(spark, sf).orderBy(F.col("ingest_seq").desc()).limit(n) \
        .select("id", "project_id", "ingest_seq")


@register("write_raw_snapshot",
          "SELECT 'notice' AS record_type, count(*) AS records FROM raw_notice "
          "UNION ALL SELECT 'award', count(*) FROM raw_award")
def q_write_raw_snapshot(spark, sf):
    base = scratch_path(spark, "raw-snapshot")
    write_snapshot(adapters.raw_notices(spark, sf).select("ingest_seq", "raw_json"), f"{base}/notices", "parquet")
    write_snapshot(adapters.raw_awards(spark, sf).select("ingest_seq", "raw_json"), f"{base}/awards", "parquet")
    n = spark.read.parquet(f"{base}/notices").select(F.lit("notice").alias("record_type"))
    a = spark.read.parquet(f"{base}/awards").select(F.lit("award").alias("record_type"))
    return n.unionByName(a).groupBy("record_type").agg(F.count(F.lit(1)).alias("records"))


@register("upsert_latest", f"SELECT {', '.join(NOTICE_OUT)} FROM notices")
def q_upsert_latest(spark, sf):
    return ing(spark, sf).notices().select(*NOTICE_OUT)


PROJECT_OUT = ["project_id", "title", "country", "region", "sector", "total_amount", "official_url"]


@register("insert_if_absent", f"SELECT {', '.join(PROJECT_OUT)} FROM projects")
def q_insert_if_absent(spark, sf):
    return ing(spark, sf).projects().select(*PROJECT_OUT)


@register("append_issue_ledger", f"SELECT {_ISSUE_SQL} FROM issues")
def q_append_issue_ledger(spark, sf):
    return ing(spark, sf).issues().select(*ISSUE_OUT)


@register("append_disposition_ledger",
          "SELECT run_id, record_type, record_id, disposition, reason, ingest_seq FROM dispositions")
def q_append_disposition_ledger(spark, sf):
    return ing(spark, sf).dispositions().select("run_id", "record_type", "record_id", "disposition", "reason",
                                                "ingest_seq")


@register("legacy_rejected_view",
          "SELECT run_id, record_type, record_id, disposition || ':' || reason AS reason, ingest_seq FROM dispositions")
def q_legacy_rejected_view(spark, sf):
    return quality.legacy_rejected_view(ing(spark, sf).dispositions()).drop("payload")


@register("rebuild_curated",
          "SELECT 'procurement_features' AS table_name, count(*) AS row_count FROM features "
          "UNION ALL SELECT 'document_chunks', count(*) FROM chunks")
def q_rebuild_curated(spark, sf):
    i = ing(spark, sf)
    base = scratch_path(spark, "curated")
    i.features().write.mode("overwrite").parquet(f"{base}/procurement_features")
    i.chunks().write.mode("overwrite").parquet(f"{base}/document_chunks")
    f = spark.read.parquet(f"{base}/procurement_features").select(F.lit("procurement_features").alias("table_name"))
    c = spark.read.parquet(f"{base}/document_chunks").select(F.lit("document_chunks").alias("table_name"))
    return f.unionByName(c).groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))


def country_counts(chunks: DataFrame) -> DataFrame:
    country = T.py_strip(F.coalesce(F.col("country"), F.lit("")))
    return chunks.select(country.alias("country")).filter(F.col("country") != "") \
        .groupBy("country").agg(F.count(F.lit(1)).alias("records"))


_COUNTRY_COUNTS_SQL = ("SELECT country, count(*) AS records FROM (SELECT regexp_replace(coalesce(country, ''), "
                       "'^\\s+|\\s+$', '', 'g') AS country FROM chunks) WHERE country <> '' GROUP BY country")


@register("country_counts", _COUNTRY_COUNTS_SQL)
def q_country_counts(spark, sf):
    return country_counts(ing(spark, sf).chunks())


@register("export_geography",
          f"SELECT 'aggregated curated record metadata' AS source, sum(records) AS count, count(*) AS countries "
          f"FROM ({_COUNTRY_COUNTS_SQL})")
def q_export_geography(spark, sf):
    """The export's head, from the rows read back."""
    rows = _geography(spark, sf)
    return rows.agg(F.max("source").alias("source"), F.sum("records").alias("count"), F.count(F.lit(1)).alias("countries"))


def _geography(spark, sf):
    path = scratch_path(spark, "geography-counts")
    country_counts(ing(spark, sf).chunks()).withColumn("source", F.lit("aggregated curated record metadata")).write.json(path)
    return spark.read.schema("country string, records long, source string").json(path)


@register("export_geography_rows", f"SELECT 'aggregated curated record metadata' AS source, country, records FROM ({_COUNTRY_COUNTS_SQL})")
def q_export_geography_rows(spark, sf):
    """A row a country, however many there are: no map of all of them in one row."""
    return _geography(spark, sf).select("source", "country", "records")


CHUNK_OUT = ["chunk_id", "record_type", "record_id", "project_id", "text", "official_url", "country"]


@register("export_corpus", f"SELECT {', '.join(CHUNK_OUT)} FROM chunks")
def q_export_corpus(spark, sf):
    chunks = ing(spark, sf).chunks()
    path = scratch_path(spark, "retrieval-corpus")
    curate.chunk_metadata_json(chunks).orderBy("record_type", "record_id").write.json(path)
    return spark.read.schema(chunks.schema).json(path).select(*CHUNK_OUT)


@register("read_chunk_staging", f"SELECT {', '.join(CHUNK_OUT)} FROM chunks")
def q_read_chunk_staging(spark, sf):
    staged = curate.chunk_metadata_json(ing(spark, sf).chunks()).drop("country")
    return staged.withColumn("country", F.get_json_object("metadata", "$.country")).select(*CHUNK_OUT)


# =============================================================================== 2.2 mapping contracts

@register("apply_mapping",
          "SELECT notice_id, m_project_id AS project_id, title, country, m_country_code AS country_code, category, "
          "method, publication_date_n AS publication_date, deadline_date_n AS deadline_date, m_sector AS sector, "
          "official_url, quality_score, mapping_error, ingest_seq FROM n_class")
def q_apply_mapping(spark, sf):
    cn = ing(spark, sf).routed_notices
    return cn.select(*NOTICE_OUT, "mapping_error", "ingest_seq")


@register("apply_mapping_pinned",
          "SELECT id AS notice_id, ingest_seq, regexp_replace(country_code, '^\\s+|\\s+$', '', 'g') AS country_code, "
          "'1.0.0' AS mapping_version FROM raw_notice")
def q_apply_mapping_pinned(spark, sf):
    raw = adapters.raw_notices(spark, sf)
    cc = contracts.compile_contract(raw, "procurement_notice", "1.0.0",
                                    computed={"quality_score": F.lit(1.0)})
    return raw.select(*cc.columns, "ingest_seq").select(
        "notice_id", "ingest_seq", "country_code", F.lit(cc.version).alias("mapping_version"))


@register("path_resolve",
          "SELECT contr_id AS award_id, ingest_seq, countryshortname AS country, regionname AS region, "
          "CAST(NULL AS VARCHAR) AS missing, 'fixed' AS constant_value FROM raw_award")
def q_path_resolve(spark, sf):
    raw = adapters.raw_awards(spark, sf)
    nested = raw.select("contr_id", "ingest_seq",
                        F.struct(F.struct(F.col("countryshortname").alias("name"),
                                          F.col("regionname").alias("region")).alias("country")).alias("location"))
    paths = {"country": "location.country.name", "region": "location.country.region",
             "missing": "location.country.name.deeper", "constant_value": "$constant.marker"}
    cols = [contracts.SourcePath.parse(p).column(nested, {}, {"marker": "fixed"}, "raw_json")[0].cast("string").alias(k)
            for k, p in paths.items()]
    return nested.select(F.col("contr_id").alias("award_id"), "ingest_seq", *cols)


def _transform_query(table: str, source: str, transform: str, id_col: str):
    def fn(spark, sf):
        raw = adapters.raw_notices(spark, sf) if table == "notice" else adapters.raw_awards(spark, sf)
        tr = contracts.TRANSFORMS[transform]
        dtype = raw.schema[source].dataType
        return raw.select(F.col(id_col).alias("record_id"), "ingest_seq",
                          tr.build(F.col(source), dtype).alias("value"))
    return fn


_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
for _name, _table, _src, _tr, _sql_value in [
    ("t_identity", "notice", "procurement_method", "identity", "procurement_method"),
    ("t_to_string", "notice", "ingest_seq", "to_string", "CAST(ingest_seq AS VARCHAR)"),
    ("t_trim", "notice", "bid_description", "trim", _STRIP.format(c="bid_description")),
    ("t_uppercase", "notice", "country_code", "uppercase", "upper(" + _STRIP.format(c="country_code") + ")"),
    ("t_normalize_project_id", "notice", "project_id", "normalize_project_id", "pid"),
    ("t_normalize_date", "notice", "publication_date", "normalize_date", "pub"),
    ("t_join_list", "award", "supp_name", "join_list", "coalesce(array_to_string(supp_name, ', '), '')"),
    ("t_to_number", "award", "total_contr_amnt", "to_number", "amount"),
]:
    _id = "id" if _table == "notice" else "contr_id"
    _from = "n_std" if _table == "notice" and _sql_value in ("pid", "pub") else (
        "raw_notice" if _table == "notice" else ("a_class" if _sql_value == "amount" else "raw_award"))
    register(_name, f"SELECT {_id} AS record_id, ingest_seq, {_sql_value} AS value FROM {_from}")(
        _transform_query(_table, _src, _tr, _id))


_CANONICAL_SQL = "'{' || concat_ws(', ', " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\": ' || CAST(to_json({c}) AS VARCHAR) END" for c in sorted(adapters.NOTICE_COLUMNS)) + ") || '}'"


@register("t_serialize_json", f"SELECT id AS record_id, ingest_seq, {_CANONICAL_SQL} AS value FROM raw_notice")
def q_t_serialize_json(spark, sf):
    raw = adapters.raw_notices(spark, sf)
    return raw.select(F.col("id").alias("record_id"), "ingest_seq", canonical_json("raw_json").alias("value"))


@register("required_guard",
          "SELECT record_id, ingest_seq, CASE WHEN id IS NULL THEN 'notice_id' WHEN pid IS NULL THEN 'project_id' "
          "ELSE 'title' END AS failed_field FROM n_class WHERE mapping_error IS NOT NULL")
def q_required_guard(spark, sf):
    cn = ing(spark, sf).routed_notices
    return cn.filter(F.col("mapping_error").isNotNull()).select(
        "record_id", "ingest_seq", F.col("mapping_error_field").alias("failed_field"))


@register("mapping_executions",
          f"SELECT '{oracle.RUN_ID}' AS run_id, 'contract_award' AS mapping_id, '{oracle.AWARD_VERSION}' AS mapping_version, "
          f"'{oracle.AWARD_HASH}' AS mapping_hash, count(*) AS record_count FROM a_class2 WHERE disposition = 'loaded' "
          f"UNION ALL SELECT '{oracle.RUN_ID}', 'procurement_notice', '{oracle.NOTICE_VERSION}', '{oracle.NOTICE_HASH}', "
          f"count(*) FROM n_class WHERE disposition = 'loaded'")
def q_mapping_executions(spark, sf):
    from ..operators.evidence import mapping_executions
    return mapping_executions(ing(spark, sf)).select("run_id", "mapping_id", "mapping_version", "mapping_hash",
                                                     "record_count")


# =============================================================================== 2.3 controls

for _i, _row in enumerate(CONTROL_CATALOG, start=1):
    _cid = _row[0]
    _key = f"dq00{_i}_" + {1: "missing_project", 2: "invalid_project", 3: "missing_title", 4: "invalid_date",
                            5: "deadline_order", 6: "missing_category", 7: "incomplete_linkage",
                            8: "duplicate_content"}[_i]

    def _mk(cid):
        def fn(spark, sf):
            return ing(spark, sf).issues().filter(F.col("control_id") == cid).select(*ISSUE_OUT)
        return fn
    register(_key, f"SELECT {_ISSUE_SQL} FROM issues WHERE control_id = '{_cid}'")(_mk(_cid))


@register("content_hash", "SELECT record_id, ingest_seq, content_hash FROM n_class")
def q_content_hash(spark, sf):
    std = quality.standardize_notices(adapters.raw_notices(spark, sf))
    return std.select(T.python_text(F.col("id")).alias("record_id"), "ingest_seq",
                      content_hash(F.col("_pid"), F.col("bid_description"), F.col("_pub"), F.col("_deadline"))
                      .alias("content_hash"))


_BLOCKING_SQL = """
SELECT record_id, ingest_seq, row_number() OVER (PARTITION BY ingest_seq ORDER BY rk) - 1 AS position,
       control_id, source_field FROM (
  SELECT record_id, ingest_seq, 1 AS rk, 'DQ-001' AS control_id, 'project_id' AS source_field FROM n_class WHERE m_pid
  UNION ALL SELECT record_id, ingest_seq, 2, 'DQ-002', 'project_id' FROM n_class WHERE NOT m_pid AND pid IS NULL
  UNION ALL SELECT record_id, ingest_seq, 3, 'DQ-003', 'bid_description' FROM n_class WHERE m_bid
  UNION ALL SELECT record_id, ingest_seq, 4, 'DQ-004', 'publication_date' FROM n_class WHERE NOT m_pub AND pub IS NULL
  UNION ALL SELECT record_id, ingest_seq, 5, 'DQ-004', 'deadline_date' FROM n_class WHERE NOT m_dead AND deadline IS NULL)
"""


@register("issue_array", _BLOCKING_SQL)
def q_issue_array(spark, sf):
    cn = ing(spark, sf).routed_notices
    return cn.select("record_id", "ingest_seq", F.posexplode("_blocking").alias("position", "i")) \
        .select("record_id", "ingest_seq", "position", "i.control_id", "i.source_field")


@register("quarantine_notices",
          "SELECT record_id, ingest_seq, reason FROM n_class WHERE disposition = 'quarantined'")
def q_quarantine_notices(spark, sf):
    cn = ing(spark, sf).routed_notices
    return cn.filter(F.col("disposition") == "quarantined").select("record_id", "ingest_seq", "reason")


@register("quarantine_awards",
          "SELECT record_id, ingest_seq, reason FROM a_class2 WHERE disposition = 'quarantined'")
def q_quarantine_awards(spark, sf):
    ca = ing(spark, sf).routed_awards
    return ca.filter(F.col("disposition") == "quarantined").select("record_id", "ingest_seq", "reason")


@register("reject_unmapped",
          "SELECT record_type, record_id, ingest_seq, reason FROM dispositions WHERE disposition = 'rejected'")
def q_reject_unmapped(spark, sf):
    d = ing(spark, sf).dispositions()
    return d.filter(F.col("disposition") == "rejected").select("record_type", "record_id", "ingest_seq", "reason")


@register("quality_score", "SELECT record_id, ingest_seq, q_score AS quality_score FROM n_class")
def q_quality_score(spark, sf):
    std = quality.standardize_notices(adapters.raw_notices(spark, sf))
    return std.select(T.python_text(F.col("id")).alias("record_id"), "ingest_seq",
                      F.col("_quality_score").alias("quality_score"))


@register("control_catalog",
          "SELECT c.control_id, c.name, c.severity, c.recommended_handling, coalesce(i.affected, 0) AS affected "
          "FROM catalog c LEFT JOIN (SELECT control_id, count(*) AS affected FROM issues GROUP BY control_id) i "
          "ON c.control_id = i.control_id")
def q_control_catalog(spark, sf):
    counts = ing(spark, sf).issues().groupBy("control_id").agg(F.count(F.lit(1)).alias("affected"))
    cat = quality.control_catalog(spark)
    return F.broadcast(cat).join(counts, "control_id", "left") \
        .select("control_id", "name", "severity", "recommended_handling",
                F.coalesce(F.col("affected"), F.lit(0)).cast("long").alias("affected"))


@register("quality_summary",
          "SELECT control_id, severity, result, count(*) AS affected FROM issues GROUP BY control_id, severity, result")
def q_quality_summary(spark, sf):
    return ing(spark, sf).issues().groupBy("control_id", "severity", "result") \
        .agg(F.count(F.lit(1)).alias("affected"))
