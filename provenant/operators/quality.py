"""Data-quality controls, routing (loaded / quarantined / rejected) and the
issue ledger.

All controls of a record are evaluated in one projection: blocking issues
become an ``array<struct>`` (in control order), warnings another, and the
ledger is a single ``explode``. The only shuffle is DQ-008 (first sight of a
content hash): a partial-aggregated ``min`` per hash, whose hot hashes are
joined back by broadcast and the others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONTROL_CATALOG, QUALITY_FIELDS
from ..functions import text as T
from ..functions.hashing import content_hash
from .contracts import apply_contract
from .tables import scratch_table

# Records of one content hash beyond which the hash is hot; a first sight's row, and what is broadcast of them at most.
HOT_ROWS = 10_000
FIRST_SIGHT_BYTES = 200
BROADCAST_BYTES = 8 << 20
# The standardized columns that a contract's transform of a source field would give again.
NOTICE_KNOWN = {("project_id", "normalize_project_id"): "_pid", ("publication_date", "normalize_date"): "_pub",
                ("deadline_date", "normalize_date"): "_deadline"}
AWARD_KNOWN = {("projectid", "normalize_project_id"): "_pid"}
ISSUE_COLUMNS = ["issue_id", "run_id", "control_id", "severity", "result", "record_type", "record_id",
                 "source_field", "original_value", "normalized_value", "recommended_handling", "ingest_seq"]
DISPOSITION_COLUMNS = ["run_id", "record_type", "record_id", "disposition", "reason", "payload",
                       "created_at", "ingest_seq"]


def _lookup(index: int) -> Column:
    pairs = []
    for row in CONTROL_CATALOG:
        pairs += [F.lit(row[0]), F.lit(row[index])]
    return F.create_map(*pairs)


def control_catalog(spark) -> DataFrame:
    return spark.createDataFrame(CONTROL_CATALOG, "control_id string, name string, severity string, "
                                                  "recommended_handling string")


def _issue(control: str, field: str, original: Column, normalized: Column | None = None) -> Column:
    return F.struct(F.lit(control).alias("control_id"), F.lit(field).alias("source_field"),
                    T.python_text(original).alias("original_value"),
                    F.coalesce(normalized.cast("string") if normalized is not None else F.lit(None).cast("string"),
                               F.lit("")).alias("normalized_value"))


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


# --------------------------------------------------------------------------- notices

def standardize_notices(raw: DataFrame) -> DataFrame:
    """Adds normalized values, missing flags, blocking issues, content hash and
    quality score. Raw columns are kept as they are."""
    miss = {f: T.is_missing(f, _dtype(raw, f)) for f in QUALITY_FIELDS}
    # The texts that several patterns read are a projection of their own.
    texts = raw.select("*", T.squeezed("project_id").alias("_t_pid"), T.py_strip("publication_date").alias("_t_pub"),
                       T.py_strip("deadline_date").alias("_t_deadline"))
    df = texts.select(*raw.columns, T.project_id_of(F.col("_t_pid")).alias("_pid"), T.date_of(F.col("_t_pub")).alias("_pub"),
                      T.date_of(F.col("_t_deadline")).alias("_deadline"), *[m.alias(f"_m_{f}") for f, m in miss.items()])
    m = {f: F.col(f"_m_{f}") for f in QUALITY_FIELDS}
    blocking = F.filter(F.array(
        F.when(m["project_id"], _issue("DQ-001", "project_id", F.col("project_id"))),
        F.when(~m["project_id"] & F.col("_pid").isNull(), _issue("DQ-002", "project_id", F.col("project_id"))),
        F.when(m["bid_description"], _issue("DQ-003", "bid_description", F.col("bid_description"))),
        F.when(~m["publication_date"] & F.col("_pub").isNull(),
               _issue("DQ-004", "publication_date", F.col("publication_date"))),
        F.when(~m["deadline_date"] & F.col("_deadline").isNull(),
               _issue("DQ-004", "deadline_date", F.col("deadline_date"))),
    ), lambda x: x.isNotNull())
    warnings = F.filter(F.array(
        F.when(F.col("_pub").isNotNull() & F.col("_deadline").isNotNull() & (F.col("_deadline") < F.col("_pub")),
               _issue("DQ-005", "deadline_date", F.col("deadline_date"), F.col("_deadline"))),
        F.when(m["procurement_category"], _issue("DQ-006", "procurement_category", F.lit(None))),
    ), lambda x: x.isNotNull())
    missing_count = sum(F.col(f"_m_{f}").cast("int") for f in QUALITY_FIELDS)
    return df.select(
        "*",
        blocking.alias("_blocking"),
        warnings.alias("_warnings"),
        content_hash(F.col("_pid"), F.col("bid_description"), F.col("_pub"), F.col("_deadline")).alias("_content_hash"),
        F.round(F.lit(1.0) - missing_count / F.lit(6.0), 3).alias("_quality_score"),
    )


def _source(raw: DataFrame, fields: list[str] | None) -> Column:
    """The raw fields as one struct; with ``fields`` only those of them."""
    return F.struct(*[F.col(c) for c in raw.columns if c != "ingest_seq" and (fields is None or c in fields)])


def classify_notices(raw: DataFrame, run_id: str, version: str | None = None, source_fields: list[str] | None = None) -> DataFrame:
    """Standardize, map by contract, and route every notice.

    Output: run_id, record_type, record_id, ingest_seq, disposition, reason,
    the mapped target columns, mapping_error, and the helper columns
    ``_src`` (raw fields, or those of ``source_fields``), ``_blocking``, ``_warnings``, ``_content_hash``.
    """
    std = standardize_notices(raw).withColumn("_src", _source(raw, source_fields)).withColumn("_id", F.col("id"))
    keep = ["_id", "ingest_seq", "_src", "_blocking", "_warnings", "_content_hash", "_pid", "_pub", "_deadline"]
    mapped = apply_contract(std, "procurement_notice", version,
                            computed={"quality_score": F.col("_quality_score")}, keep=keep, known=NOTICE_KNOWN)
    quarantined = F.size("_blocking") > 0
    disposition = (F.when(quarantined, F.lit("quarantined"))
                   .when(F.col("mapping_error").isNotNull(), F.lit("rejected"))
                   .otherwise(F.lit("loaded")))
    reason = (F.when(quarantined, F.array_join(F.transform("_blocking", lambda x: x["control_id"]), ";"))
              .when(F.col("mapping_error").isNotNull(), F.concat(F.lit("mapping_error:"), F.col("mapping_error"))))
    return mapped.select(
        F.lit(run_id).alias("run_id"), F.lit("notice").alias("record_type"),
        T.python_text(F.col("_id")).alias("record_id"),
        "*", disposition.alias("disposition"), reason.alias("reason")).drop("_id")


# --------------------------------------------------------------------------- awards

def classify_awards(raw: DataFrame, run_id: str, awards_url: str, version: str | None = None, source_fields: list[str] | None = None) -> DataFrame:
    std = raw.select("*", T.squeezed("projectid").alias("_t_pid")).select(*raw.columns, T.project_id_of(F.col("_t_pid")).alias("_pid"))
    std = std.withColumn("_src", _source(raw, source_fields)).withColumn("_id", F.col("contr_id"))
    blocking = F.filter(F.array(F.when(F.col("_pid").isNull(), _issue("DQ-002", "projectid", F.col("projectid")))),
                        lambda x: x.isNotNull())
    std = std.withColumn("_blocking", blocking)
    mapped = apply_contract(std, "contract_award", version, constants={"official_awards_url": awards_url},
                            keep=["_id", "ingest_seq", "_src", "_blocking", "_pid"], known=AWARD_KNOWN)
    quarantined = F.size("_blocking") > 0
    disposition = (F.when(quarantined, F.lit("quarantined"))
                   .when(F.col("mapping_error").isNotNull(), F.lit("rejected"))
                   .otherwise(F.lit("loaded")))
    reason = (F.when(quarantined, F.lit("DQ-002"))
              .when(F.col("mapping_error").isNotNull(), F.concat(F.lit("mapping_error:"), F.col("mapping_error"))))
    return mapped.select(
        F.lit(run_id).alias("run_id"), F.lit("award").alias("record_type"),
        T.python_text(F.col("_id")).alias("record_id"),
        "*", disposition.alias("disposition"), reason.alias("reason")).drop("_id")


# --------------------------------------------------------------------------- routed records

# --- Fixed values: the source fields that ledgers and curated tables read ---
ROUTED_SOURCE_FIELDS = ["bid_description", "project_name", "countryshortname", "regionname", "mjsecname"]


def routed_records(classified: DataFrame) -> DataFrame:
    """The classified records without their landed text, and of their source fields only those read later: about a fifth of a record."""
    kept = [f for f in ROUTED_SOURCE_FIELDS if f in classified.schema["_src"].dataType.fieldNames()]
    return classified.withColumn("_src", F.struct(*[F.col(f"_src.{f}").alias(f) for f in kept])).drop("raw_json", "_pid", "_pub", "_deadline")


# --------------------------------------------------------------------------- ledgers

def _issue_rows(df: DataFrame, issues: Column) -> DataFrame:
    ex = df.select("run_id", "record_type", "record_id", F.col("ingest_seq").cast("string").alias("ingest_seq"),
                   F.explode(issues).alias("_i"))
    return finalize_issues(ex.select("run_id", "record_type", "record_id", "ingest_seq", "_i.*"))


def finalize_issues(df: DataFrame) -> DataFrame:
    """(run_id, record_type, record_id, ingest_seq, control_id, source_field,
    original_value, normalized_value) -> ledger rows with catalog fields and a
    content-derived id (no global counter)."""
    issue_id = F.sha2(F.concat_ws("|", "run_id", "control_id", "record_type", "record_id", "source_field",
                                  F.coalesce(F.col("ingest_seq"), F.lit(""))), 256)
    return df.select(
        issue_id.alias("issue_id"), "run_id", "control_id",
        _lookup(2)[F.col("control_id")].alias("severity"),
        _lookup(1)[F.col("control_id")].alias("result"),
        "record_type", "record_id", "source_field", "original_value", "normalized_value",
        _lookup(3)[F.col("control_id")].alias("recommended_handling"),
        F.col("ingest_seq"))


def notice_control_issues(classified: DataFrame) -> DataFrame:
    """DQ-001..DQ-006: blocking issues of quarantined notices, warnings of the rest."""
    quarantined = F.col("disposition") == "quarantined"
    return _issue_rows(classified, F.when(quarantined, F.col("_blocking")).otherwise(F.col("_warnings")))


def _candidates(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("disposition") != "quarantined") \
        .select("run_id", "record_type", "record_id", "ingest_seq", "_content_hash", F.col("_src.bid_description").alias("_bid"))


def repeated_hashes(classified: DataFrame) -> DataFrame:
    """(run_id, _content_hash, _first_seq, _rows) of the hashes seen more than once. The aggregate combines
    map-side, so a hot hash is a row a task before the shuffle."""
    return _candidates(classified).groupBy("run_id", "_content_hash") \
        .agg(F.min("ingest_seq").alias("_first_seq"), F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)


def first_sights(classified: DataFrame) -> DataFrame:
    """The repeated hashes, written to the shared scratch folder."""
    return scratch_table(repeated_hashes(classified), "first-sights")


def after_first_sight(records: DataFrame, firsts: DataFrame, key: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The records whose ``ingest_seq`` lies after their key's ``_first_seq``; ``firsts`` is a written table that also counts
    each key's ``_rows``.

    A key on more than ``hot_rows`` records is hot. Hot keys' first sights, as many as fit ``BROADCAST_BYTES`` by their
    count, the hottest first, are broadcast: their records are compared where they stand. All other records are joined by key,
    where no key has more rows than that bound leaves.
    """
    least = hot_rows
    hot = firsts.filter(F.col("_rows") > least)
    while hot.count() * FIRST_SIGHT_BYTES > BROADCAST_BYTES:
        least *= 2
        hot = firsts.filter(F.col("_rows") > least)
    here = F.broadcast(hot.drop("_rows"))
    apart = records.join(F.broadcast(hot.select(*key)), key, "left_anti").join(firsts.filter(F.col("_rows") <= least).drop("_rows"), key)
    later = F.col("ingest_seq") > F.col("_first_seq")
    return records.join(here, key).filter(later).unionByName(apart.filter(later))


def duplicate_content_flags(classified: DataFrame, firsts: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """DQ-008 candidates: non-quarantined notices whose content hash was seen
    earlier in the same run (source order = ingest_seq), see :func:`after_first_sight`."""
    firsts = first_sights(classified) if firsts is None else firsts
    return after_first_sight(_candidates(classified), firsts, ["run_id", "_content_hash"], hot_rows)


def duplicate_content_issues(classified: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    dup = duplicate_content_flags(classified, firsts)
    return _issue_rows(dup, F.array(_issue("DQ-008", "bid_description", F.col("_bid"))))


def award_control_issues(classified: DataFrame) -> DataFrame:
    return _issue_rows(classified.filter(F.col("disposition") == "quarantined"), F.col("_blocking"))


def dispositions(classified: DataFrame, created_at) -> DataFrame:
    """The ledger of the records that were not loaded; its ``payload`` is the landed text, where the records have it."""
    payload = [F.col("raw_json").alias("payload")] if "raw_json" in classified.columns else []
    return classified.filter(F.col("disposition").isin("quarantined", "rejected")).select(
        "run_id", "record_type", "record_id", "disposition", "reason",
        *payload, F.lit(created_at).cast("timestamp").alias("created_at"),
        F.col("ingest_seq").cast("string").alias("ingest_seq"))


def legacy_rejected_view(disp: DataFrame) -> DataFrame:
    payload = ["payload"] if "payload" in disp.columns else []
    return disp.select("run_id", "record_type", "record_id",
                       F.concat_ws(":", "disposition", "reason").alias("reason"), *payload, "ingest_seq")
