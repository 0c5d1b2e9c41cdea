"""A complete migration run that writes every sink.

Layout under ``out_dir`` (a shared folder on a cluster):

* ``raw/<feed>/run_id=<id>``: the landed snapshot, written once; it is the run's
  only input, so a replay classifies, counts and hashes the same records
* ``curated/<table>``: keyed tables of notices, awards, projects, a version a run. A run rewrites the key buckets its records
  fall into and shares the others with the highest committed version below its own, so a replayed run makes its own
  version anew and a gap in the sequence loses nothing
* ``ledgers/<ledger>/run_id=<id>``: issues, dispositions, mapping executions
  and evidence, partition-overwritten per run (idempotent on replay)
* ``ledgers/run_events``: append-only states of every run: ``running``, then ``completed``, ``failed_accounting`` or
  ``failed_source``; the run ledger is the last state of each
* ``derived/<table>``: features and chunks, rebuilt (overwrite) from the
  latest curated version
* ``index``: with an embedder, the chunk index, upserted by chunk id

Only per-run aggregates (a handful of rows) are ever collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import canonical_json
from ..operators import curate, drift, evidence
from ..operators.index import ChunkIndex
from ..operators.store import DEFAULT_BUCKETS, KeyedTable
from ..sources import adapters
from .ingest import DEFAULT_RUN_AT, build_ingestion

CURATED = {"notices": "notice_id", "awards": "award_id", "projects": "project_id"}


def curated_table(spark: SparkSession, out: str, name: str, buckets: int = DEFAULT_BUCKETS) -> KeyedTable:
    return KeyedTable(spark, f"{out.rstrip('/')}/curated/{name}", [CURATED[name]], buckets)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed (its marker file is there)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def base_version(spark: SparkSession, out: str, run_seq: int) -> int | None:
    """The highest version below ``run_seq`` that all curated tables have. A
    table with history that lacks it is an error, never an empty base."""
    have = {t: curated_table(spark, out, t).base(run_seq) for t in CURATED}
    known = [v for v in have.values() if v is not None]
    if not known:
        return None
    missing = [t for t, v in have.items() if v != max(known)]
    if missing:
        raise RuntimeError(f"curated version {max(known)} is incomplete: {', '.join(missing)} missing")
    return max(known)


def _write_partition(df: DataFrame, root: str, run_id: str) -> None:
    df.drop("run_id").write.mode("overwrite").parquet(f"{root}/run_id={run_id}")


def _land(spark: SparkSession, out: str, run_id: str, feeds: dict) -> list[DataFrame]:
    landed = []
    for feed, source in feeds.items():
        df = source() if callable(source) else source
        path = f"{out}/raw/{feed}/run_id={run_id}"
        if not _complete(spark, path):  # a half-written landing is written anew
            df.write.mode("overwrite").parquet(path)
        landed.append(spark.read.schema(df.schema).parquet(path))
    return landed


def run_migration(spark: SparkSession, raw_notices: DataFrame | Callable[[], DataFrame], raw_awards: DataFrame | Callable[[], DataFrame],
                  out_dir: str, run_id: str, run_seq: int, run_at: datetime = DEFAULT_RUN_AT, buckets: int = DEFAULT_BUCKETS,
                  embedder=None) -> dict:
    """Sources are frames or functions that give them: whatever a source throws closes the run as ``failed_source`` and is thrown on."""
    out = out_dir.rstrip("/")
    events = f"{out}/ledgers/run_events"

    def record(event: DataFrame, position: int) -> None:
        evidence.append_run_event(event, events, position, datetime.now(timezone.utc))

    record(evidence.run_event(spark, run_id, "running", run_at), 0)
    # 1. immutable landing of what this run read
    try:
        raw_notices, raw_awards = _land(spark, out, run_id, {"notices": raw_notices, "awards": raw_awards})
    except Exception:
        record(evidence.run_event(spark, run_id, "failed_source", run_at, run_at), 1)
        raise
    # 2. classify once, materialized in the checkpoint folder
    base_version(spark, out, run_seq)
    ing = build_ingestion(spark, raw_notices, raw_awards, run_id=run_id, run_at=run_at, run_seq=run_seq, materialize=True)
    # 3. curated versions
    order = ["run_seq", "ingest_seq"]
    tables = {t: curated_table(spark, out, t, buckets) for t in CURATED}
    canonical = canonical_json("raw_json")
    tables["notices"].upsert(ing.loaded_notices().select(*curate.NOTICE_TABLE_COLUMNS, *order).withColumn("raw_json", canonical), order, run_seq)
    tables["awards"].upsert(ing.loaded_awards().select(*curate.AWARD_TABLE_COLUMNS, *order).withColumn("raw_json", canonical), order, run_seq)
    tables["projects"].insert(curate.project_candidates(ing.loaded_awards(), ing.project_url_prefix), order, run_seq)
    notices = tables["notices"].read(run_seq).select(*curate.NOTICE_TABLE_COLUMNS)
    awards = tables["awards"].read(run_seq).select(*curate.AWARD_TABLE_COLUMNS)
    projects = tables["projects"].read(run_seq).select(*curate.PROJECT_TABLE_COLUMNS)
    # 4. ledgers of this run
    led = f"{out}/ledgers"
    _write_partition(ing.run_issues(), f"{led}/issues", run_id)
    _write_partition(curate.linkage_issues(notices, projects), f"{led}/curation_issues", run_id)
    _write_partition(ing.dispositions(), f"{led}/dispositions", run_id)
    records = ing.classified_notices.select("record_type", "record_id", "raw_json") \
        .unionByName(ing.classified_awards.select("record_type", "record_id", "raw_json"))
    _write_partition(drift.source_keys(records, run_id), f"{led}/source_keys", run_id)
    _write_partition(drift.source_buckets(records, run_id), f"{led}/source_buckets", run_id)
    maps = evidence.mapping_executions(ing)
    _write_partition(maps, f"{led}/mapping_executions", run_id)
    dispositions = spark.read.parquet(f"{led}/dispositions").filter(F.col("run_id") == run_id)
    acc = evidence.record_accounting(ing, dispositions)
    runs = evidence.run_ledger(ing, evidence.run_checksum(ing),
                               evidence.schema_fingerprint(ing.classified_notices.select("raw_json"),
                                                           ing.classified_awards.select("raw_json")))
    record(runs, 1)
    runs = evidence.run_states(spark.read.parquet(events)).filter(F.col("run_id") == run_id)
    gates = evidence.gates(acc, runs, maps)
    _write_partition(evidence.migration_evidence(acc, gates, maps, run_at), f"{led}/evidence", run_id)
    # 5. derived tables, rebuilt from the latest curated version
    curate.project_features(notices, awards, projects).write.mode("overwrite").parquet(f"{out}/derived/features")
    curate.build_chunks(notices, awards, projects).write.mode("overwrite").parquet(f"{out}/derived/chunks")
    if embedder is not None:
        ChunkIndex(spark, f"{out}/index", embedder, buckets=buckets).index_documents(spark.read.parquet(f"{out}/derived/chunks"), run_seq)
    return {"out": out, "run_id": run_id, "run_seq": run_seq}


def run_from_tables(spark: SparkSession, sf_dir: str, out_dir: str, run_id: str, run_seq: int) -> dict:
    return run_migration(spark, adapters.raw_notices(spark, sf_dir), adapters.raw_awards(spark, sf_dir),
                         out_dir, run_id, run_seq)


def read_sink(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """Latest curated version, a ledger (all runs) or a derived table."""
    out = out_dir.rstrip("/")
    if name in CURATED:
        return curated_table(spark, out, name).read()
    if name == "runs":
        return evidence.run_states(spark.read.parquet(f"{out}/ledgers/run_events"))
    if name in ("features", "chunks"):
        return spark.read.parquet(f"{out}/derived/{name}")
    return spark.read.parquet(f"{out}/ledgers/{name}")
