"""The chunk index: replace by id, text search with citation and filters, abstention, guards, readiness, query log."""

import tempfile

import pytest

from provenant.config import ABSTAIN_MESSAGE, ANSWER_MESSAGE
from provenant.operators import retrieval
from provenant.operators.index import ChunkIndex

CHUNKS = ("chunk_id string, record_type string, record_id string, project_id string, text string, official_url string, country string")
ROWS = [("c1", "notice", "n1", "P000001", "supply of water pumps", "https://example.org/n1", "Norway"),
        ("c2", "notice", "n2", "P000002", "school building", "https://example.org/n2", "Ghana"),
        ("c3", "award", "a1", "P000002", "water pumps and pipes", "https://example.org/a1", "ghana"),
        ("c4", "award", "a2", None, None, None, None)]


def Fixed(vector=(1.0, 0.0, 0.0)):
    """An embedder with one vector for every text (of a local class, so that it travels to the tasks whole)."""
    class Same:
        model_name, dimensions = "fixed-3", 3

        def encode(self, texts):
            return [list(vector) for _ in texts]

    return Same()


def _index(spark, embedder=None, **kwargs):
    return ChunkIndex(spark, tempfile.mkdtemp(prefix="provenant-index-", dir="/tmp"), embedder or retrieval.HashEmbedder(), buckets=4, **kwargs)


@pytest.fixture()
def index(spark):
    own = _index(spark)
    own.index_documents(spark.createDataFrame(ROWS, CHUNKS), 1)
    return own


def test_search_cites_and_logs(index):
    found = index.search("water pumps")
    assert [r["chunk_id"] for r in found.results] == ["c1", "c3"] and not found.abstained and found.message == ANSWER_MESSAGE
    assert found.results[0]["official_url"] == "https://example.org/n1" and found.results[0]["retrieval_score"] == 0.7071
    again = index.search("water pumps", country="GHANA", project_id="P000002", limit=1)
    assert [r["chunk_id"] for r in again.results] == ["c3"]
    none = index.search("nothing alike here")
    assert none.abstained and none.results == [] and none.message == ABSTAIN_MESSAGE
    log = {r["run_id"]: r for r in index.query_log().collect()}
    assert len(log) == 3 and log[again.run_id]["country_filter"] == "GHANA" and log[again.run_id]["result_count"] == 1
    assert log[none.run_id]["abstained"] and log[found.run_id]["query"] == "water pumps" and log[found.run_id]["latency_ms"] > 0


def test_limit_and_least_score(spark):
    own = _index(spark, min_score=0.75)
    own.index_documents(spark.createDataFrame(ROWS, CHUNKS), 1)
    assert own.search("water pumps").abstained
    assert [r["chunk_id"] for r in own.search("supply of water pumps", limit=1).results] == ["c1"]


def test_indexing_again_replaces_the_whole_row(spark, index):
    index.index_documents(spark.createDataFrame([("c1", "notice", "n1", "P000009", "solar panels", "https://example.org/new", "Chile")], CHUNKS), 2)
    assert index.documents().count() == 4
    assert [r["chunk_id"] for r in index.search("water pumps").results] == ["c3"]
    row = index.search("solar panels", country="chile").results[0]
    assert (row["chunk_id"], row["project_id"], row["official_url"]) == ("c1", "P000009", "https://example.org/new")
    other = ChunkIndex(spark, index.path, Fixed(), buckets=4)  # another model takes a chunk over
    other.index_documents(spark.createDataFrame(ROWS[1:2], CHUNKS), 3)
    assert {r["embedding_model"]: r["indexed_documents"] for r in index.counts().collect()} == {"token-hash-256": 3, "fixed-3": 1}
    assert [r["chunk_id"] for r in other.search("anything").results] == ["c2"]


def test_a_query_vector_of_another_length_is_refused_before_any_job(spark, index):
    wrong = ChunkIndex(spark, index.path, Fixed((1.0, 0.0)), dimensions=3, buckets=4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("refused", "refused")
    with pytest.raises(retrieval.RetrievalConfigurationError, match="dimension"):
        wrong.search("query")
    assert list(tracker.getJobIdsForGroup("refused")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_documents_of_another_length_stop_the_write(spark):
    own = _index(spark, Fixed(), dimensions=4)
    with pytest.raises(Exception, match="dimension"):
        own.index_documents(spark.createDataFrame(ROWS, CHUNKS), 1)
    assert own.table.versions() == []


def test_an_empty_index_is_not_ready(spark, index):
    own = _index(spark)
    with pytest.raises(retrieval.RetrievalConfigurationError, match="empty"):
        own.readiness()
    own.index_documents(spark.createDataFrame([], CHUNKS), 1)
    with pytest.raises(retrieval.RetrievalConfigurationError, match="empty"):
        own.search("water")
    with pytest.raises(retrieval.RetrievalConfigurationError, match="empty"):
        ChunkIndex(spark, index.path, Fixed(), buckets=4).readiness()
    assert index.readiness() == {"status": "ready", "embedding_model": "token-hash-256", "dimensions": 256, "indexed_documents": 4}


def test_a_search_reads_its_models_files_only(index):
    plan = index.search_rows("water")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(embedding_model" in plan
    counts = index.counts()._jdf.queryExecution().executedPlan().toString()
    assert "embedding:" not in counts.split("ReadSchema")[1]
