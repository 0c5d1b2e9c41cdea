"""Curated outputs: projects, per-project features, linkage and retrieval chunks.

Features aggregate notices and awards separately (partial aggregation on
each side, so a project owning a third of the rows is combined map-side) and
then full-outer-join the two per-project summaries, which avoids the
notice x award fan-out of joining the detail rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_PROJECT_URL_PREFIX
from ..functions import text as T
from ..functions.hashing import short_id
from .quality import finalize_issues
from .tables import insert_if_absent

NOTICE_TABLE_COLUMNS = ["notice_id", "project_id", "title", "country", "country_code", "category", "method",
                        "publication_date", "deadline_date", "sector", "official_url", "raw_json", "quality_score"]
AWARD_TABLE_COLUMNS = ["award_id", "project_id", "description", "country", "category", "supplier", "amount",
                       "signed_date", "official_url", "raw_json"]
PROJECT_TABLE_COLUMNS = ["project_id", "title", "country", "region", "sector", "total_amount", "official_url",
                         "raw_json"]


def project_candidates(loaded_awards: DataFrame, url_prefix: str = DEFAULT_PROJECT_URL_PREFIX) -> DataFrame:
    """Project rows carried by loaded awards, one per award (``_src`` = raw award)."""
    sectors = F.col("_src.mjsecname")
    sector = (T.join_list(sectors, loaded_awards.schema["_src"].dataType["mjsecname"].dataType, ",")
              if "mjsecname" in loaded_awards.schema["_src"].dataType.fieldNames() else F.lit(""))
    return loaded_awards.select(
        F.col("project_id"),
        F.col("_src.project_name").alias("title"),
        F.col("_src.countryshortname").alias("country"),
        F.col("_src.regionname").alias("region"),
        sector.alias("sector"),
        F.lit(0.0).alias("total_amount"),
        F.concat(F.lit(url_prefix), F.col("project_id")).alias("official_url"),
        F.to_json(F.struct(F.lit("contract-awards").alias("source"),
                           F.col("_src.project_name").alias("project_name"))).alias("raw_json"),
        F.col("run_seq"), F.col("ingest_seq"))


def derive_projects(loaded_awards: DataFrame, existing: DataFrame | None = None,
                    url_prefix: str = DEFAULT_PROJECT_URL_PREFIX) -> DataFrame:
    """First loaded award per project wins; existing project rows are kept."""
    cand = project_candidates(loaded_awards, url_prefix)
    added = insert_if_absent(cand, ["project_id"], ["run_seq", "ingest_seq"], existing)
    added = added.select(*PROJECT_TABLE_COLUMNS)
    return added if existing is None else existing.select(*PROJECT_TABLE_COLUMNS).unionByName(added)


def notice_summary(notices: DataFrame) -> DataFrame:
    """Scores are multiples of 0.001: they are summed as integer thousandths,
    so averages are exact and independent of summation order."""
    milli = F.round(F.col("quality_score") * 1000).cast("long")
    return notices.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("notice_count"),
        F.sum(milli).alias("_q_milli"))


def _avg3(total_milli, n) -> F.Column:
    """round(total / 1000 / n, 3), half-up: floor((2t + n) / 2n) thousandths.
    The quotient of two integers below 2^40 is exact enough in double that its
    floor is the integer quotient."""
    return F.floor((F.lit(2) * total_milli + n) / (F.lit(2) * n)) / F.lit(1000.0)


def award_summary(awards: DataFrame) -> DataFrame:
    supplier = F.when(F.col("supplier").isNotNull() & (F.col("supplier") != ""), F.col("supplier"))
    return awards.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("award_count"),
        F.count_distinct(supplier).alias("supplier_count"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("award_amount"))


def project_features(notices: DataFrame, awards: DataFrame, projects: DataFrame) -> DataFrame:
    both = notice_summary(notices).join(award_summary(awards), "project_id", "full_outer")
    linked = projects.select("project_id", F.lit(True).alias("_linked"))
    n = F.coalesce(F.col("notice_count"), F.lit(0)).cast("long")
    d = F.greatest(n, F.lit(1)).cast("long")
    q_milli = F.coalesce(F.col("_q_milli"), F.lit(0)).cast("long")
    return both.join(linked, "project_id", "left").select(
        "project_id",
        n.cast("long").alias("notice_count"),
        F.coalesce(F.col("award_count"), F.lit(0)).cast("long").alias("award_count"),
        F.coalesce(F.col("supplier_count"), F.lit(0)).cast("long").alias("supplier_count"),
        F.coalesce(F.col("award_amount"), F.lit(0.0)).alias("award_amount"),
        _avg3(n * 1000 - q_milli, d).alias("missing_field_ratio"),
        F.when(F.col("_linked"), F.lit("linked")).otherwise(F.lit("project metadata unavailable")).alias("linkage_status"),
        _avg3(q_milli, d).alias("quality_score"))


def project_id_universe(notices: DataFrame, awards: DataFrame) -> DataFrame:
    return notices.select("project_id").union(awards.select("project_id")).distinct()


def unlinked_projects(notices: DataFrame, projects: DataFrame) -> DataFrame:
    """Project ids used by notices that have no project row (DQ-007 feed)."""
    return notices.select("project_id").distinct().join(projects.select("project_id"), "project_id", "left_anti")


def linked_projects(notices: DataFrame, awards: DataFrame, projects: DataFrame) -> DataFrame:
    return project_id_universe(notices, awards).join(projects.select("project_id"), "project_id", "left_semi")


def linkage_issues(notices: DataFrame, projects: DataFrame) -> DataFrame:
    u = unlinked_projects(notices, projects)
    return finalize_issues(u.select(
        F.lit("curation").alias("run_id"), F.lit("project").alias("record_type"),
        F.col("project_id").alias("record_id"), F.lit(None).cast("string").alias("ingest_seq"),
        F.lit("DQ-007").alias("control_id"), F.lit("project_id").alias("source_field"),
        F.col("project_id").alias("original_value"), F.lit("").alias("normalized_value")))


def _chunk(df: DataFrame, record_type: str, id_col: str, text_col: str, has_sector: bool) -> DataFrame:
    text = F.concat(T.python_text(F.col(text_col)), F.lit(" "), T.python_text(F.col("country")), F.lit(" "),
                    T.python_text(F.col("sector")) if has_sector else F.lit(""))
    return df.select(
        short_id(F.concat(F.lit(f"{record_type}:"), F.col(id_col).cast("string"))).alias("chunk_id"),
        F.lit(record_type).alias("record_type"),
        F.col(id_col).cast("string").alias("record_id"),
        F.col("project_id"),
        text.alias("text"),
        F.col("official_url"),
        F.col("country"))


def build_chunks(notices: DataFrame, awards: DataFrame, projects: DataFrame) -> DataFrame:
    return (_chunk(notices, "notice", "notice_id", "title", True)
            .unionByName(_chunk(awards, "award", "award_id", "description", False))
            .unionByName(_chunk(projects, "project", "project_id", "title", True)))


def chunk_metadata_json(chunks: DataFrame) -> DataFrame:
    """Chunks with the JSON metadata column of the staging table."""
    return chunks.withColumn("metadata", F.to_json(F.struct(F.col("country").alias("country"))))
