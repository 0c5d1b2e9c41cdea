"""The chunk index: a written table of chunks with their vectors, and text search over it.

The index is a keyed table (``chunk_id``), its rows split by model, so a search reads one model's
files and indexing a chunk again replaces its whole row: text, citation, country, model and vector. Only the
buckets of the indexed chunks are rewritten. A wrong vector length stops the write inside the plan.

A search encodes its text on the driver (one short text), refuses a vector of the wrong length before any job
runs, and refuses an index without documents of its model. Filters go to the scan; scores are native, one top-k. Scores equal to six
digits are in order of chunk id. Every search appends one row to the query log.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ABSTAIN_MESSAGE, ANSWER_MESSAGE, MIN_RETRIEVAL_SCORE
from . import retrieval
from .store import DEFAULT_BUCKETS, KeyedTable
from .tables import append_ledger

INDEX_COLUMNS = ["chunk_id", "record_type", "record_id", "project_id", "text", "official_url", "country", "metadata",
                 "embedding_model", "embedding"]
RESULT_COLUMNS = ["chunk_id", "record_type", "record_id", "project_id", "text", "official_url", "country", "retrieval_score"]
LOG_SCHEMA = ("run_id string, query string, country_filter string, project_filter string, embedding_model string, result_count long, "
              "latency_ms double, abstained boolean, searched_at timestamp")


@dataclass(frozen=True)
class SearchResult:
    run_id: str
    query: str
    results: list[dict]
    abstained: bool
    message: str
    latency_ms: float
    embedding_model: str


def embedded(chunks: DataFrame, embedder, dimensions: int) -> DataFrame:
    """Chunks with ``embedding`` and ``embedding_model``; a vector of another length fails the plan."""
    if isinstance(embedder, retrieval.HashEmbedder):  # its native twin: no Python in tasks
        out = retrieval.hash_embed(chunks, dimensions=embedder.dimensions).withColumn("embedding_model", F.lit(embedder.model_name))
    else:
        out = retrieval.embed_with(chunks, lambda: embedder)
    wrong = F.raise_error(F.lit(retrieval.WRONG_DIMENSION)).cast("array<float>")
    return out.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(wrong))


class ChunkIndex:
    def __init__(self, spark: SparkSession, path: str, embedder, dimensions: int | None = None,
                 min_score: float = MIN_RETRIEVAL_SCORE, buckets: int = DEFAULT_BUCKETS):
        self.spark, self.path, self.embedder, self.min_score = spark, path.rstrip("/"), embedder, min_score
        self.dimensions = embedder.dimensions if dimensions is None else dimensions
        self.table = KeyedTable(spark, f"{self.path}/documents", ["chunk_id"], buckets, partition_by=("embedding_model",))

    # ---- writing ----------------------------------------------------------------------
    def index_documents(self, chunks: DataFrame, version: int) -> dict:
        """Embed chunks and insert or replace them by ``chunk_id``."""
        if "metadata" not in chunks.columns:
            chunks = chunks.withColumn("metadata", F.to_json(F.struct("country")))
        def made(rows: DataFrame) -> DataFrame:
            out = embedded(rows, self.embedder, self.dimensions)
            return out.select(*INDEX_COLUMNS, *[c for c in out.columns if c not in INDEX_COLUMNS])

        # one model: rows of one id that differ have the greatest text's, which alone is embedded
        given = [c for c in INDEX_COLUMNS if c not in ("embedding_model", "embedding")]
        return self.table.upsert(chunks.select(*given), ["text"], version, made=made)

    def index_vectors(self, documents: DataFrame, version: int) -> dict:
        """Insert or replace documents that have vectors already. Rows of one id that differ: the greatest text stays."""
        return self.table.upsert(documents.select(*INDEX_COLUMNS), ["text", "embedding_model"], version)

    # ---- reading ----------------------------------------------------------------------
    def documents(self) -> DataFrame:
        return self.table.read()

    def counts(self) -> DataFrame:
        """(embedding_model, indexed_documents); the vectors are not read."""
        return self.documents().groupBy("embedding_model").agg(F.count(F.lit(1)).alias("indexed_documents"))

    def readiness(self) -> dict:
        """Whether the index holds documents of this model; an index without any is an error."""
        model = self.embedder.model_name
        n = self.documents().filter(F.col("embedding_model") == model).count() if self.table.versions() else 0
        if n < 1:
            raise retrieval.RetrievalConfigurationError("retrieval index is empty")
        return {"status": "ready", "embedding_model": model, "dimensions": self.dimensions, "indexed_documents": n}

    def encode(self, query: str) -> list[float]:
        vector = [float(x) for x in self.embedder.encode([query])[0]]
        if len(vector) != self.dimensions:
            raise retrieval.RetrievalConfigurationError(f"Query embedding: {retrieval.WRONG_DIMENSION}")
        return vector

    def search_rows(self, query: str, country: str | None = None, project_id: str | None = None, limit: int = 8) -> DataFrame:
        """The best ``limit`` chunks for a text that reach the least score, with their citations."""
        vector = self.encode(query)
        found = retrieval.semantic_search(self.documents(), vector, self.embedder.model_name, country, project_id, limit, self.min_score)
        return found.select(*RESULT_COLUMNS)

    def search(self, query: str, country: str | None = None, project_id: str | None = None, limit: int = 8) -> SearchResult:
        started = time.perf_counter()
        rows = self.search_rows(query, country, project_id, limit)
        self.readiness()
        results = sorted((r.asDict() for r in rows.collect()), key=lambda r: (-r["retrieval_score"], r["chunk_id"]))
        latency = (time.perf_counter() - started) * 1000
        run_id, model = str(uuid.uuid4()), self.embedder.model_name
        row = (run_id, query, country, project_id, model, len(results), latency, not results, datetime.now(timezone.utc))
        append_ledger(self.spark.createDataFrame([row], LOG_SCHEMA), f"{self.path}/query_log")
        return SearchResult(run_id, query, results, not results, ABSTAIN_MESSAGE if not results else ANSWER_MESSAGE, round(latency, 2), model)

    def query_log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/query_log")
