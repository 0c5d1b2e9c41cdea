"""The registered queries of this package and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import byte_bpe, embedding_join, hidden_markov, jaccard_join, language_id, lexical_search, mixing, quality_rules, secrets, sentencepiece, token_alignment, toxicity, url_filter
from provenant.llm.common import fold, frame


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text of documents, and whether decoding them gives the text back."""
    return sentencepiece.encode(frame(spark, sf_dir, "documents", "doc_id", "text"), sentencepiece.read_model())


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(frame(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(frame(spark, sf_dir, "documents", "doc_id", "text"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(frame(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame(spark, sf_dir, "documents", "doc_id", "text")
    held = fold("doc_id", 5) == 0
    grammar = toxicity.train(docs.where(~held), frame(spark, sf_dir, "labels", "doc_id", "toxic").where(~held))
    return toxicity.toxicity(docs, grammar).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_texts(frame(spark, sf_dir, "documents", "doc_id", "text"), fold("doc_id", 7) != 2)


def op7_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.embedding_links(frame(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = fold("doc_id", 3) == 1
    model = language_id.train(docs.where(~held), "doc_id")
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(frame(spark, sf_dir, "pages", "page_id", "url"), url_filter.listed_urls(frame(spark, sf_dir, "pages", "url", "html")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(frame(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_counts(frame(spark, sf_dir, "documents", "doc_id", "text"), token_alignment.read_files())


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(frame(spark, sf_dir, "documents", "doc_id", "text"), byte_bpe.read_ranks())


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(frame(spark, sf_dir, "documents", "doc_id", "text"), frame(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_jaccard_join, op3_quality_rules, op4_mix_sources, op5_toxicity, op6_hidden_markov,
                            op7_embedding_join, op8_language_id, op9_url_filter, op10_secret_scan, op11_token_alignment,
                            op12_byte_bpe, op13_lexical_search)}

ORACLE: dict[str, str] = {"op3_quality_rules": quality_rules.oracle(), "op9_url_filter": url_filter.ORACLE, "op10_secret_scan": secrets.ORACLE,
                          "op13_lexical_search": lexical_search.ORACLE}
