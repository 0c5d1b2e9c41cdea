"""The ingestion plan: raw records -> routed, curated, reconciled outputs.

``build_ingestion`` wires the operators into one lazily-evaluated plan per
output. With ``materialize=True`` the two classified frames (read by five
outputs each) are written once as Parquet tables into the shared checkpoint
folder and read back, so lineage is cut, a lost executor recomputes from the
table, not from the raw scan, and later outputs read only their columns. With ``routed=True`` each feed's records are written so when
an output first reads them, without their landed text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_AWARDS_URL, DEFAULT_PROJECT_URL_PREFIX
from ..operators import curate, evidence, quality
from ..operators.tables import scratch_table, upsert_latest
from ..session import scratch_path
from ..sources import adapters

DEFAULT_RUN_ID = "run-0001"
DEFAULT_RUN_AT = datetime(2026, 8, 10, 0, 0, 0)


def _stored(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


@dataclass
class Ingestion:
    run_id: str
    run_at: datetime
    classified_notices: DataFrame
    classified_awards: DataFrame
    notice_version: str | None = None
    award_version: str | None = None
    existing: dict = field(default_factory=dict)
    run_seq: int = 1
    project_url_prefix: str = DEFAULT_PROJECT_URL_PREFIX
    source_notices: DataFrame | None = None
    source_awards: DataFrame | None = None
    routed: bool = False
    _first_sights: DataFrame | None = None
    _routed: dict = field(default_factory=dict)
    _landed: DataFrame | None = None

    # ---- routed records --------------------------------------------------------------
    def _route(self, name: str, classified: DataFrame) -> DataFrame:
        if not self.routed:
            return classified
        if name not in self._routed:
            self._routed[name] = scratch_table(quality.routed_records(classified), f"routed-{name}")
        return self._routed[name]

    @property
    def routed_notices(self) -> DataFrame:
        """The classified notices; with ``routed``, their table without landed text."""
        return self._route("notices", self.classified_notices)

    @property
    def routed_awards(self) -> DataFrame:
        return self._route("awards", self.classified_awards)

    def loaded_notices(self) -> DataFrame:
        return self.routed_notices.filter(F.col("disposition") == "loaded") \
            .withColumn("run_seq", F.lit(self.run_seq))

    def loaded_awards(self) -> DataFrame:
        return self.routed_awards.filter(F.col("disposition") == "loaded") \
            .withColumn("run_seq", F.lit(self.run_seq))

    # ---- curated tables --------------------------------------------------------------
    def notices_state(self) -> DataFrame:
        """Curated notices with the order columns (run_seq, ingest_seq) kept, as
        stored between runs."""
        loaded = self.loaded_notices()
        new = loaded.select(*_stored(loaded, curate.NOTICE_TABLE_COLUMNS), "run_seq", "ingest_seq")
        return upsert_latest(new, ["notice_id"], ["ingest_seq"], self.existing.get("notices"))

    def awards_state(self) -> DataFrame:
        loaded = self.loaded_awards()
        new = loaded.select(*_stored(loaded, curate.AWARD_TABLE_COLUMNS), "run_seq", "ingest_seq")
        return upsert_latest(new, ["award_id"], ["ingest_seq"], self.existing.get("awards"))

    def notices(self) -> DataFrame:
        state = self.notices_state()
        return state.select(*_stored(state, curate.NOTICE_TABLE_COLUMNS))

    def awards(self) -> DataFrame:
        state = self.awards_state()
        return state.select(*_stored(state, curate.AWARD_TABLE_COLUMNS))

    def projects(self) -> DataFrame:
        return curate.derive_projects(self.loaded_awards(), self.existing.get("projects"),
                                      self.project_url_prefix)

    def features(self) -> DataFrame:
        return curate.project_features(self.notices(), self.awards(), self.projects())

    def chunks(self) -> DataFrame:
        return curate.build_chunks(self.notices(), self.awards(), self.projects())

    # ---- ledgers ---------------------------------------------------------------------
    def run_issues(self) -> DataFrame:
        if self._first_sights is None:  # written once a run
            self._first_sights = quality.first_sights(self.routed_notices)
        return (quality.notice_control_issues(self.routed_notices)
                .unionByName(quality.duplicate_content_issues(self.routed_notices, self._first_sights))
                .unionByName(quality.award_control_issues(self.routed_awards)))

    def curation_issues(self) -> DataFrame:
        return curate.linkage_issues(self.notices(), self.projects())

    def issues(self) -> DataFrame:
        return self.run_issues().unionByName(self.curation_issues())

    def dispositions(self) -> DataFrame:
        return (quality.dispositions(self.routed_notices, self.run_at)
                .unionByName(quality.dispositions(self.routed_awards, self.run_at)))

    def source_counts(self) -> DataFrame:
        """(record_type, n) of the records as read, before anything was done to them."""
        if self._landed is not None:  # counted on the source frames, with their checksum
            total = F.coalesce(F.sum("n"), F.lit(0)).alias("n")
            counts = [self._landed.filter(F.col("record_type") == t).agg(F.lit(t).alias("record_type"), total) for t in ("notice", "award")]
            return counts[0].unionByName(counts[1])
        n = self.source_notices.agg(F.lit("notice").alias("record_type"), F.count(F.lit(1)).alias("n"))
        a = self.source_awards.agg(F.lit("award").alias("record_type"), F.count(F.lit(1)).alias("n"))
        return n.unionByName(a)

    def landed_facts(self) -> DataFrame:
        """Facts of the source records, a row for each record type and set of keys, written once: what accounting, checksum and schema
        fingerprint need takes one pass over the source instead of one each."""
        if self._landed is None:
            self._landed = scratch_table(evidence.record_facts({"notice": self.source_notices, "award": self.source_awards}), "landed-facts")
        return self._landed

    def routing_counts(self) -> DataFrame:
        """(record_type, disposition, n): the only numbers accounting needs."""
        cols = ["record_type", "disposition"]
        both = self.routed_notices.select(*cols).unionByName(self.routed_awards.select(*cols))
        return both.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def build_ingestion(spark: SparkSession, raw_notices: DataFrame, raw_awards: DataFrame,
                    run_id: str = DEFAULT_RUN_ID, run_at: datetime = DEFAULT_RUN_AT,
                    notice_version: str | None = None, award_version: str | None = None,
                    awards_url: str = DEFAULT_AWARDS_URL, existing: dict | None = None,
                    run_seq: int = 1, materialize: bool = False, persist: bool = False, routed: bool = False) -> Ingestion:
    """``materialize`` cuts lineage with a table written to the shared
    checkpoint folder (a real run);
    ``persist`` only caches the two classified frames (memory, spilling to
    disk) for many read-only outputs in one session; lost blocks recompute.
    ``routed`` writes each feed's records when an output first reads them, without the landed text and the source fields that
    no output reads (see :func:`quality.routed_records`): the outputs have no ``raw_json`` or ``payload`` then."""
    fields = quality.ROUTED_SOURCE_FIELDS if routed else None  # a struct of all of them would copy each record
    cn = quality.classify_notices(raw_notices, run_id, notice_version, fields)
    ca = quality.classify_awards(raw_awards, run_id, awards_url, award_version, fields)
    if materialize:
        # a written table in the shared checkpoint folder: computed once, read
        # back columnar (later outputs prune columns), survives executor loss
        base = scratch_path(spark, f"classified-{run_id}")
        # scratch tables: raw_json is unique per row, so skip dictionary encoding
        cn.write.mode("errorifexists").option("parquet.enable.dictionary", "false").parquet(f"{base}/notices")
        ca.write.mode("errorifexists").option("parquet.enable.dictionary", "false").parquet(f"{base}/awards")
        cn = spark.read.parquet(f"{base}/notices")
        ca = spark.read.parquet(f"{base}/awards")
    elif persist:
        cn = cn.persist(StorageLevel.MEMORY_AND_DISK)
        ca = ca.persist(StorageLevel.MEMORY_AND_DISK)
    return Ingestion(run_id, run_at, cn, ca, notice_version, award_version, existing or {}, run_seq,
                     source_notices=raw_notices, source_awards=raw_awards, routed=routed)


def adapter_ingestion(spark: SparkSession, sf_dir: str, **kwargs) -> Ingestion:
    return build_ingestion(spark, adapters.raw_notices(spark, sf_dir), adapters.raw_awards(spark, sf_dir), **kwargs)
