"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
``run`` writes each stage's result to the shared scratch folder and gives it to the next.

Defined results: texts that are null or have no letter leave with the first stage; of repeated rows of one
document one stays in the second; a document that the mix takes twice is two rows from the fourth stage on. Of equal documents
the smallest doc_id stays; very long texts are whole in every stage; an empty table gives an empty result; further columns, whatever their names,
go with their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import jaccard_join, language_id, mixing, secrets, sentencepiece
from provenant.llm.common import frame, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts that the model rejects go."""
    return language_id.accepted(docs, language_id.train(docs, "doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    kept = jaccard_join.jaccard_links(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return out
    repeats = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, "doc_id", "left_anti").unionByName(repeats.select(*out.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs, mixing.mix_sources(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text."""
    return sentencepiece.encode(docs, sentencepiece.read_model())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenize),
]

# The stages learn, sample trees and round to copies: SQL can't express them; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
