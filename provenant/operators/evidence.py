"""Reconciliation, integrity fingerprints, gates, acceptance and UAT.

Everything here works on per-run aggregates (a handful of rows per run), so
all joins are between already-aggregated frames keyed by ``run_id``; the big
tables are only scanned by partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (EXPECTED_CONTRACTS, GATES, MIN_NAME_CHARS, MIN_SIGN_OFF_NOTE_CHARS, SIGN_OFF_ERRORS, UAT_ENVIRONMENTS,
                      UAT_ERRORS, UAT_SCENARIOS, UAT_SUITE_VERSION)
from ..functions.hashing import digest_of_sums, digest_sums, sums_of_sums, unordered_digest
from .contracts import contract
from .tables import append_ledger

MAPPING_IDS = {"notice": "procurement_notice", "award": "contract_award"}


def mapping_executions(ing) -> DataFrame:
    """Rows transformed per contract and run, stamped with version + hash."""
    counts = ing.routing_counts().filter(F.col("disposition") == "loaded")
    versions = {"notice": ing.notice_version, "award": ing.award_version}
    rows = []
    for rtype, mid in MAPPING_IDS.items():
        doc = contract(mid, versions[rtype])
        rows.append(F.struct(F.lit(rtype).alias("record_type"), F.lit(mid).alias("mapping_id"),
                             F.lit(doc.version).alias("mapping_version"), F.lit(doc.sha256).alias("mapping_hash")))
    contracts_df = counts.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    return F.broadcast(contracts_df).join(counts, "record_type", "left").select(
        F.lit(ing.run_id).alias("run_id"), "mapping_id", "mapping_version", "mapping_hash",
        F.lit(ing.run_at).cast("timestamp").alias("executed_at"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("record_count"))


def schema_keys(raw_json: Column) -> Column:
    return F.json_object_keys(raw_json)


def schema_fingerprint(*raw_frames: DataFrame) -> DataFrame:
    """SHA-256 of the sorted union of top-level keys, rendered as a JSON list
    (``["a", "b"]``). Key sets, then keys, are de-duplicated by partial
    aggregation, so only the distinct key names (the schema width) reach the
    final collect."""
    keysets = None
    for df in raw_frames:
        k = df.select(F.array_sort(schema_keys(F.col("raw_json"))).alias("keys"))
        keysets = k if keysets is None else keysets.unionByName(k)
    return fingerprint_of_keys(keysets)


def fingerprint_of_keys(keysets: DataFrame) -> DataFrame:
    """:func:`schema_fingerprint` of records' key sets (``keys``)."""
    # few distinct key sets exist: de-duplicate them (partial aggregation) before exploding
    distinct = keysets.distinct().select(F.explode("keys").alias("key")).distinct()
    listed = F.array_sort(F.collect_list("key"))
    text = F.concat(F.lit('["'), F.array_join(listed, '", "'), F.lit('"]'))
    return distinct.agg(F.sha2(text, 256).alias("schema_hash"), F.count(F.lit(1)).alias("key_count"))


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Top-level keys added / removed between two record populations."""
    kb = before.select(F.explode(schema_keys(F.col("raw_json"))).alias("key")).distinct()
    ka = after.select(F.explode(schema_keys(F.col("raw_json"))).alias("key")).distinct()
    return (ka.exceptAll(kb).select("key", F.lit("added").alias("change"))
            .unionByName(kb.exceptAll(ka).select("key", F.lit("removed").alias("change"))))


def canonical_row_text(cols: list[str]) -> Column:
    """Engine-neutral row text: fields joined by U+0001, null as U+0000."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])


def payload_checksum(df: DataFrame, cols: list[str]) -> DataFrame:
    return unordered_digest(df, F.sha2(canonical_row_text(cols), 256))


def _landed_hash() -> Column:
    return F.sha2(F.concat_ws("|", "record_type", "raw_json"), 256)


def record_facts(feeds: dict[str, DataFrame]) -> DataFrame:
    """(record_type, keys, n, digest sums) of landed records: a row for each record type and sorted set of top-level keys, by one
    aggregate that combines map-side."""
    rows = None
    for kind, df in feeds.items():
        one = df.select(F.lit(kind).alias("record_type"), "raw_json")
        rows = one if rows is None else rows.unionByName(one)
    hashed = rows.select("record_type", F.array_sort(schema_keys(F.col("raw_json"))).alias("keys"), _landed_hash().alias("_h"))
    return hashed.groupBy("record_type", "keys").agg(F.count(F.lit(1)).alias("n"), *digest_sums("_h"))


def run_checksum(ing, landed: DataFrame | None = None) -> DataFrame:
    """Checksum of everything a run read: the landed record text of both feeds,
    as an order-insensitive multiset digest (no single-machine payload blob). With ``landed``, the written facts of the
    source records, their sums are added up."""
    if landed is not None:
        return digest_of_sums(landed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *sums_of_sums()))
    rows = ing.classified_notices.select("record_type", "raw_json") \
        .unionByName(ing.classified_awards.select("record_type", "raw_json"))
    return unordered_digest(rows, _landed_hash())


def record_accounting(ing, dispositions: DataFrame | None = None) -> DataFrame:
    """read = loaded + quarantined + rejected: what was read is counted on the
    source frames (the landed snapshot in a run), what was loaded on the routed
    records, the rest on the ledger, so a record lost between them shows."""
    routing = ing.routing_counts()
    source = ing.source_counts().agg(
        F.lit(ing.run_id).alias("run_id"),
        F.coalesce(F.sum(F.when(F.col("record_type") == "notice", F.col("n"))), F.lit(0)).alias("source_notices"),
        F.coalesce(F.sum(F.when(F.col("record_type") == "award", F.col("n"))), F.lit(0)).alias("source_awards"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("records_read"))
    disp = dispositions if dispositions is not None else ing.dispositions()
    ledger = disp.groupBy("run_id").agg(
        F.sum(F.when(F.col("disposition") == "quarantined", 1).otherwise(0)).alias("quarantined"),
        F.sum(F.when(F.col("disposition") == "rejected", 1).otherwise(0)).alias("rejected"))
    totals = routing.agg(
        F.lit(ing.run_id).alias("run_id"),
        F.sum(F.when((F.col("record_type") == "notice") & (F.col("disposition") == "loaded"), F.col("n"))
              .otherwise(0)).alias("loaded_notices"),
        F.sum(F.when((F.col("record_type") == "award") & (F.col("disposition") == "loaded"), F.col("n"))
              .otherwise(0)).alias("loaded_awards"),
        F.sum(F.when(F.col("disposition") == "loaded", F.col("n")).otherwise(0)).alias("loaded"),
        F.sum(F.when(F.col("disposition") == "quarantined", F.col("n")).otherwise(0)).alias("run_quarantined"),
        F.sum(F.when(F.col("disposition") == "rejected", F.col("n")).otherwise(0)).alias("run_rejected"))
    out = source.join(totals, "run_id", "left").join(ledger, "run_id", "left").fillna(
        0, ["loaded_notices", "loaded_awards", "loaded", "run_quarantined", "run_rejected"])
    q = F.coalesce(F.col("quarantined"), F.lit(0))
    r = F.coalesce(F.col("rejected"), F.lit(0))
    accounted = F.col("loaded") + q + r
    return out.select(
        "run_id", *[F.col(c).cast("long").alias(c) for c in
                    ("source_notices", "source_awards", "records_read", "loaded_notices", "loaded_awards", "loaded")],
        q.cast("long").alias("quarantined"), r.cast("long").alias("rejected"),
        accounted.cast("long").alias("accounted"),
        (F.col("records_read") - accounted).cast("long").alias("balance_delta"),
        F.when(F.col("records_read") == accounted, F.lit("balanced")).otherwise(F.lit("unbalanced"))
        .alias("reconciliation_status"),
        F.col("run_quarantined").cast("long").alias("run_quarantined"),
        F.col("run_rejected").cast("long").alias("run_rejected"))


def run_ledger(ing, checksum: DataFrame | None = None, schema_hash: DataFrame | None = None,
               source: str = "adapter", started_at=None, completed_at=None, accounting: DataFrame | None = None) -> DataFrame:
    acc = record_accounting(ing) if accounting is None else accounting
    base = acc.select(
        "run_id", F.lit(source).alias("source"),
        F.lit(started_at or ing.run_at).cast("timestamp").alias("started_at"),
        F.lit(completed_at or ing.run_at).cast("timestamp").alias("completed_at"),
        F.when(F.col("records_read") == F.col("loaded") + F.col("run_quarantined") + F.col("run_rejected"),
               F.lit("completed")).otherwise(F.lit("failed_accounting")).alias("status"),
        "records_read", F.col("loaded").alias("accepted"), F.col("run_rejected").alias("rejected"),
        F.col("run_quarantined").alias("quarantined"))
    if checksum is not None:
        base = base.join(checksum.select(F.lit(ing.run_id).alias("run_id"), F.col("digest").alias("checksum")),
                         "run_id", "left")
    else:
        base = base.withColumn("checksum", F.lit(None).cast("string"))
    if schema_hash is not None:
        base = base.join(schema_hash.select(F.lit(ing.run_id).alias("run_id"), "schema_hash"), "run_id", "left")
    else:
        base = base.withColumn("schema_hash", F.lit(None).cast("string"))
    return base


RUN_COLUMNS = ["run_id", "source", "started_at", "completed_at", "status", "records_read", "accepted", "rejected", "quarantined",
               "checksum", "schema_hash"]
RUN_SCHEMA = ("run_id string, source string, started_at timestamp, completed_at timestamp, status string, records_read long, "
              "accepted long, rejected long, quarantined long, checksum string, schema_hash string")


def run_event(spark, run_id: str, status: str, started_at, completed_at=None, source: str = "adapter") -> DataFrame:
    """A run's ledger row before anything was counted: ``running``, or ``failed_source`` if nothing could be read."""
    row = (run_id, source, started_at, completed_at, status, 0, 0, 0, 0, None, None)
    return spark.createDataFrame([row], RUN_SCHEMA)


def append_run_event(event: DataFrame, path: str, position: int, recorded_at) -> None:
    """Append a state of a run to the event log; nothing in the log is ever rewritten."""
    append_ledger(event.select(*RUN_COLUMNS, F.lit(recorded_at).cast("timestamp").alias("recorded_at"), F.lit(position).alias("position")), path)


def run_states(events: DataFrame) -> DataFrame:
    """The run ledger: every run's last recorded state, by a partial ``max_by`` aggregate."""
    last = F.max_by(F.struct(*[c for c in RUN_COLUMNS if c != "run_id"]), F.struct("recorded_at", "position")).alias("s")
    return events.groupBy("run_id").agg(last).select("run_id", "s.*")


def gates(accounting: DataFrame, runs: DataFrame, mappings: DataFrame,
          expected_contracts: int = EXPECTED_CONTRACTS) -> DataFrame:
    """One row per (run, gate): id, label, passed, evidence text."""
    m = mappings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_mappings"),
        F.every(F.col("mapping_hash").isNotNull() & (F.col("mapping_hash") != "")).alias("all_hashed"))
    j = accounting.join(runs.select("run_id", F.col("accepted").alias("run_accepted"),
                                    F.col("quarantined").alias("run_q"), F.col("rejected").alias("run_r"),
                                    "checksum", "schema_hash"), "run_id", "left") \
        .join(m, "run_id", "left")
    nm = F.coalesce(F.col("n_mappings"), F.lit(0))
    excluded = F.col("quarantined") + F.col("rejected")
    labels = dict(GATES)
    rows = [
        ("REC-001", F.col("balance_delta") == 0,
         F.format_string("%d read = %d loaded + %d quarantined + %d rejected", "records_read", "loaded",
                         "quarantined", "rejected")),
        ("REC-002", F.col("loaded") == F.col("run_accepted"),
         F.format_string("%d successful transformations recorded", "loaded")),
        ("QUA-001", excluded == F.col("run_q") + F.col("run_r"),
         F.format_string("%d disposition records retained", excluded)),
        ("MAP-001", (nm == expected_contracts) & F.coalesce(F.col("all_hashed"), F.lit(False)),
         F.format_string("%d versioned contracts recorded", nm)),
        ("INT-001", F.col("checksum").isNotNull() & (F.col("checksum") != "") & F.col("schema_hash").isNotNull()
         & (F.col("schema_hash") != ""), F.lit("Raw checksum and schema fingerprint retained")),
        ("ERR-001", F.col("rejected") == 0, F.format_string("%d rejected records", "rejected")),
    ]
    structs = [F.struct(F.lit(i).alias("position"), F.lit(g).alias("gate_id"), F.lit(labels[g]).alias("label"),
                        F.coalesce(p, F.lit(False)).alias("passed"), e.alias("evidence"))
               for i, (g, p, e) in enumerate(rows)]
    return j.select("run_id", "quarantined", F.explode(F.array(*structs)).alias("g")) \
        .select("run_id", "quarantined", "g.*")


def acceptance(gate_rows: DataFrame) -> DataFrame:
    per_run = gate_rows.groupBy("run_id").agg(F.every("passed").alias("all_passed"),
                                              F.max("quarantined").alias("quarantined"))
    status = (F.when(F.col("all_passed") & (F.col("quarantined") > 0), F.lit("accepted_with_quarantine"))
              .when(F.col("all_passed"), F.lit("accepted")).otherwise(F.lit("blocked")))
    return per_run.select("run_id", status.alias("acceptance_status"))


def migration_evidence(accounting: DataFrame, gate_rows: DataFrame, mappings: DataFrame,
                       generated_at) -> DataFrame:
    """Evidence package per run: scalar columns + nested gates/mappings, and a
    SHA-256 over the business fields (sorted-key JSON, ``generated_at`` left out
    so the fingerprint is reproducible)."""
    acc = acceptance(gate_rows)
    g = gate_rows.groupBy("run_id").agg(F.array_sort(F.collect_list(
        F.struct("position", F.struct("evidence", F.col("gate_id").alias("id"), "label", "passed").alias("gate"))))
        .alias("_g"))
    m = mappings.groupBy("run_id").agg(F.array_sort(F.collect_list(
        F.struct("mapping_id", "mapping_hash", "mapping_version", "record_count"))).alias("mapping_executions"))
    j = accounting.join(acc, "run_id").join(g, "run_id").join(m, "run_id", "left")
    gates_arr = F.transform("_g", lambda x: x["gate"])
    body = F.struct(
        F.col("acceptance_status"), F.col("accounted"), F.col("balance_delta"), gates_arr.alias("gates"),
        F.struct(F.col("loaded_awards").alias("contract_awards"),
                 F.col("loaded_notices").alias("procurement_notices")).alias("loaded_counts"),
        F.col("loaded"), F.col("mapping_executions"), F.col("quarantined"), F.col("reconciliation_status"),
        F.col("records_read"), F.col("rejected"), F.col("run_id"),
        F.struct(F.col("source_awards").alias("contract_awards"),
                 F.col("source_notices").alias("procurement_notices")).alias("source_counts"))
    return j.select(
        "run_id", F.lit(generated_at).cast("timestamp").alias("generated_at"), "records_read", "loaded",
        "quarantined", "rejected", "accounted", "balance_delta", "reconciliation_status", "acceptance_status",
        F.sha2(F.to_json(body), 256).alias("evidence_hash"), F.to_json(body).alias("evidence_json"))


# ------------------------------------------------------------------------------------------ UAT

def _per_run(runs: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to each run id, inside the plan."""
    return runs.select("run_id", F.lit(1).alias("_one")) \
        .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def uat_results(evidence: DataFrame, mappings: DataFrame, dispositions: DataFrame,
                notices: DataFrame, awards: DataFrame) -> DataFrame:
    """Four scenarios per evidence run; one row each with expected/observed.
    UAT-004 compares the queryable rows with the records the run loaded, so
    records that overwrite each other in the curated tables make it fail."""
    m = mappings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_map"),
        F.every(F.col("mapping_version").isNotNull() & (F.length("mapping_hash") == 64)).alias("map_ok"),
        F.sum("record_count").alias("transformed"))
    d = dispositions.groupBy("run_id").agg(
        F.sum(F.when(F.col("disposition") == "quarantined", 1).otherwise(0)).alias("dq"),
        F.sum(F.when(F.col("disposition") == "rejected", 1).otherwise(0)).alias("dr"))
    n_count = notices.agg(F.count(F.lit(1)).alias("queryable_notices"))
    a_count = awards.agg(F.count(F.lit(1)).alias("queryable_awards"))
    base = evidence.join(m, "run_id", "left").join(d, "run_id", "left")
    # whole-table counts (one row each) attached to every evaluated run
    runs_ = evidence.select("run_id")
    base = base.join(_per_run(runs_, n_count), "run_id", "left").join(_per_run(runs_, a_count), "run_id", "left")
    nm = F.coalesce(F.col("n_map"), F.lit(0))
    dq = F.coalesce(F.col("dq"), F.lit(0)).cast("long")
    dr = F.coalesce(F.col("dr"), F.lit(0)).cast("long")
    queryable = F.col("queryable_notices") + F.col("queryable_awards")
    sc = {s[0]: s for s in UAT_SCENARIOS}
    rows = [
        ("UAT-001", (F.col("reconciliation_status") == "balanced") & (F.col("balance_delta") == 0),
         F.format_string("Reconciliation %s; balance delta %d.", "reconciliation_status", "balance_delta")),
        ("UAT-002", (nm == 2) & F.coalesce(F.col("map_ok"), F.lit(False)),
         F.format_string("%d mapping contracts recorded; %d records transformed.", nm,
                         F.coalesce(F.col("transformed"), F.lit(0)))),
        ("UAT-003", (dq == F.col("quarantined")) & (dr == F.col("rejected")),
         F.format_string("Expected %d quarantined and %d rejected; found %d and %d disposition records.",
                         "quarantined", "rejected", dq, dr)),
        ("UAT-004", (F.col("loaded") > 0) & (queryable >= F.col("loaded")),
         F.format_string("%d curated records are queryable for %d accepted records in this bounded run.",
                         queryable, "loaded")),
    ]
    structs = [F.struct(F.lit(s).alias("scenario_id"), F.lit(sc[s][1]).alias("title"),
                        F.when(p, F.lit("passed")).otherwise(F.lit("failed")).alias("status"),
                        F.lit(sc[s][2]).alias("expected"), o.alias("observed")) for s, p, o in rows]
    return base.select("run_id", F.explode(F.array(*structs)).alias("r")).select("run_id", "r.*")


def uat_execution(results: DataFrame, execution_id: str, release_id: str, environment: str, tester: str,
                  executed_at) -> DataFrame:
    """One execution of the suite over the evaluated runs; a request without a proper tester, release or environment is refused."""
    tester, release_id, environment = tester.strip(), release_id.strip(), environment.strip()
    for bad, name in ((len(tester) < MIN_NAME_CHARS, "tester"), (len(release_id) < MIN_NAME_CHARS, "release"),
                      (environment not in UAT_ENVIRONMENTS, "environment")):
        if bad:
            raise ValueError(UAT_ERRORS[name])
    agg = results.groupBy("run_id").agg(
        F.every(F.col("status") == "passed").alias("_ok"),
        F.array_sort(F.collect_list(F.struct("expected", "observed", "scenario_id", "status", "title"))).alias("_r"))
    body = F.struct(F.lit(execution_id).alias("execution_id"), F.lit(release_id).alias("release_id"),
                    F.col("_r").alias("results"), F.col("run_id"), F.lit(UAT_SUITE_VERSION).alias("suite_version"))
    return agg.select(
        F.lit(execution_id).alias("execution_id"), F.lit(release_id).alias("release_id"), "run_id",
        F.lit(environment).alias("environment"), F.lit(tester).alias("tester"),
        F.lit(executed_at).cast("timestamp").alias("started_at"),
        F.lit(executed_at).cast("timestamp").alias("completed_at"),
        F.when(F.col("_ok"), F.lit("passed")).otherwise(F.lit("failed")).alias("status"),
        F.lit(UAT_SUITE_VERSION).alias("suite_version"),
        F.sha2(F.to_json(body), 256).alias("evidence_hash"),
        F.lit(None).cast("string").alias("signed_off_by"), F.lit(None).cast("timestamp").alias("signed_off_at"),
        F.lit(None).cast("string").alias("sign_off_note"))


def sign_off(executions: DataFrame, commands: DataFrame,
             min_name: int = MIN_NAME_CHARS, min_note: int = MIN_SIGN_OFF_NOTE_CHARS) -> tuple[DataFrame, DataFrame]:
    """Apply sign-off commands (execution_id, approver, note, signed_at).

    The first valid command per passing, unsigned execution signs it; every
    other command gets the reason it was refused. Returns (executions, errors).
    """
    from pyspark.sql import Window
    from ..functions.text import py_strip
    c = commands.withColumn("_approver", py_strip("approver")).withColumn("_note", py_strip("note"))
    ex = executions.select("execution_id", F.col("status").alias("_status"),
                           F.col("signed_off_at").alias("_prior_signed"))
    j = c.join(ex, "execution_id", "left")
    static = (F.when(F.length("_approver") < min_name, F.lit(SIGN_OFF_ERRORS["approver"]))
              .when(F.length("_note") < min_note, F.lit(SIGN_OFF_ERRORS["note"]))
              .when(F.col("_status").isNull(), F.lit(SIGN_OFF_ERRORS["missing"]))
              .when(F.col("_status") != "passed", F.lit(SIGN_OFF_ERRORS["failed"]))
              .when(F.col("_prior_signed").isNotNull(), F.lit(SIGN_OFF_ERRORS["signed"])))
    j = j.withColumn("_static", static)
    w = Window.partitionBy("execution_id").orderBy(F.col("_static").isNotNull(), "signed_at", "approver")
    j = j.withColumn("_rank", F.row_number().over(w))
    error = F.coalesce(F.col("_static"), F.when(F.col("_rank") > 1, F.lit(SIGN_OFF_ERRORS["signed"])))
    j = j.withColumn("error", error)
    accepted = j.filter(F.col("error").isNull()).select(
        "execution_id", F.col("_approver").alias("_by"), F.col("signed_at").alias("_at"), F.col("_note").alias("_n"))
    signed = executions.join(accepted, "execution_id", "left").select(
        *[c_ for c_ in executions.columns if c_ not in ("signed_off_by", "signed_off_at", "sign_off_note")],
        F.coalesce("signed_off_by", "_by").alias("signed_off_by"),
        F.coalesce("signed_off_at", "_at").alias("signed_off_at"),
        F.coalesce("sign_off_note", "_n").alias("sign_off_note"))
    errors = j.filter(F.col("error").isNotNull()).select("execution_id", "approver", "signed_at", "error")
    return signed, errors


def release_readiness(accounting: DataFrame, runs: DataFrame, loaded_notices: DataFrame,
                      review_state: DataFrame, executions: DataFrame) -> DataFrame:
    """Six release criteria per run and the readiness percent."""
    invalid = loaded_notices.agg(F.sum(F.when(
        F.col("project_id").isNull() | F.col("notice_id").isNull() | (F.col("title") == ""), 1).otherwise(0))
        .alias("_invalid"))
    done = F.col("status").isin("resolved", "rejected")
    rv = review_state.agg(
        F.coalesce(F.every(done), F.lit(True)).alias("exceptions_disposed"),
        F.coalesce(F.every(~done | (F.col("decided_by").isNotNull() & F.col("decided_at").isNotNull()
                                    & F.col("resolution_rationale").isNotNull())), F.lit(True)).alias("audit_complete"))
    uat = executions.groupBy("run_id").agg(
        F.max((F.col("status") == "passed") & F.col("signed_off_at").isNotNull()).alias("uat_signed_off"))
    base = accounting.select("run_id", (F.col("balance_delta") == 0).alias("reconciled")) \
        .join(runs.select("run_id", F.col("checksum").isNotNull().alias("rollback_evidence")), "run_id", "left") \
        .join(uat, "run_id", "left")
    runs_ = base.select("run_id")
    j = base.join(_per_run(runs_, invalid.select((F.coalesce(F.col("_invalid"), F.lit(0)) == 0).alias("validated"))),
                  "run_id", "left").join(_per_run(runs_, rv), "run_id", "left")
    crit = ["reconciled", "validated", "exceptions_disposed", "audit_complete", "rollback_evidence", "uat_signed_off"]
    j = j.select("run_id", *[F.coalesce(F.col(c_), F.lit(False)).alias(c_) for c_ in crit])
    passed = sum(F.col(c_).cast("int") for c_ in crit)
    return j.withColumn("passed_criteria", passed.cast("long")) \
        .withColumn("readiness_percent", F.round(passed * F.lit(100.0) / F.lit(6.0)).cast("long"))
