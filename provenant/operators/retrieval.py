"""Semantic retrieval over chunk vectors: exact search, batch top-k,
abstention, evaluation metrics, a native hashed-token embedder and an approximate
search over a written signature index.

Scale notes: a single query is a filter + score + TakeOrderedAndProject (top-k
per partition, then a k-row merge), with no shuffle of the corpus. A batch of
queries is broadcast only after its size is checked; larger batches are
processed as several broadcast passes. Per-query top-k uses ``row_number() <=
k``, planned with a partial WindowGroupLimit, so each task forwards at most k
rows per query whatever the skew.
"""

from __future__ import annotations

import hashlib
import math
import statistics
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..config import (ABSTAIN_MESSAGE, ANSWER_MESSAGE, HASH_EMBED_DIMENSIONS, MIN_RETRIEVAL_SCORE,
                      TOKEN_PATTERN)
from ..functions import text as T
from ..session import ship_package

MAX_BROADCAST_QUERIES = 50_000


class RetrievalConfigurationError(RuntimeError):
    pass


# --- Fixed value: the refusal of a vector of another length ---
WRONG_DIMENSION = "Embedding dimension does not match the retrieval schema"


class Embedder(Protocol):
    model_name: str
    dimensions: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    some = F.array_remove(a, 0.0)  # zeros add nothing, and a lambda call costs more than leaving one out
    return F.sqrt(dot(some, some))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a zero or null vector. Vectors of
    different lengths are an error of the run, not an empty answer."""
    wrong = F.raise_error(F.lit(WRONG_DIMENSION)).cast("double")
    return F.when(F.size(a) != F.size(b), wrong).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


# Values of a query that are written out as one sum.
SUMMED_VALUES = 64


def query_cosine(a: Column, own: Column, query: list[float]) -> Column:
    """:func:`cosine` of a vector, whose length is ``own``, and the driver's query. The query's length is a constant; of a query with few
    values the products with its zeros are not made. A zero times an infinite value is NaN, as is such a vector's length times zero."""
    length = math.sqrt(sum(x * x for x in query))
    some = [(i, x) for i, x in enumerate(query) if x != 0.0]
    if len(some) > SUMMED_VALUES:
        product = dot(a, F.array(*[F.lit(x) for x in query]))
    else:
        product = F.lit(0.0) + own * F.lit(0.0)
        for i, x in some:
            product = product + F.get(a, F.lit(i)).cast("double") * F.lit(x)
    wrong = F.raise_error(F.lit(WRONG_DIMENSION)).cast("double")
    return F.when(F.size(a) != len(query), wrong).otherwise(F.try_divide(product, own * F.lit(length)))


def dimension_guard(vectors: DataFrame, col: str, dimensions: int) -> None:
    """Fail before any search when a vector has the wrong length."""
    bad = vectors.filter(F.size(col) != dimensions).limit(1).count()
    if bad:
        raise RetrievalConfigurationError(WRONG_DIMENSION)


def _filtered(corpus: DataFrame, model: str | None, country: str | None, project_id: str | None) -> DataFrame:
    d = corpus
    if model is not None:
        d = d.filter(F.col("embedding_model") == model)
    if country is not None:
        d = d.filter(F.lower(F.col("country")) == country.lower())
    if project_id is not None:
        d = d.filter(F.col("project_id") == project_id)
    return d


def semantic_search(corpus: DataFrame, query_vector: list[float], model: str | None = None,
                    country: str | None = None, project_id: str | None = None, limit: int = 8,
                    min_score: float = MIN_RETRIEVAL_SCORE) -> DataFrame:
    """Top ``limit`` chunks by cosine (equal to six digits: by id), then kept when score >= ``min_score``."""
    measured = _filtered(corpus, model, country, project_id).withColumn("_length", norm(F.col("embedding")))
    score = query_cosine(F.col("embedding"), F.col("_length"), [float(x) for x in query_vector])
    scored = measured.withColumn("retrieval_score", score).drop("_length")
    top = scored.orderBy(F.round("retrieval_score", 6).desc_nulls_last(), F.col("chunk_id")).limit(limit)
    return top.filter(F.col("retrieval_score") >= min_score) \
        .withColumn("retrieval_score", F.round("retrieval_score", 4))


# Vectors and queries of a block, and pairs that leave a block in one row.
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 512
PAIRS_A_ROW = 1024
# By more than this no double product differs from the cosine that is compared; lengths of vectors that such a product can take.
PRODUCT_ERROR = 1e-9
PLAIN_LENGTHS = (1e-100, 1e100)


def _blocks(df: DataFrame, name: str, rows: int, total: int, *keys: str) -> DataFrame:
    """One row for at most ``rows`` of about ``total`` rows: column ``name`` holds them as structs. Dealt by a hash of ``keys``, and cut by
    place where many rows share them; spread over the cores, as a small file would else be one task's."""
    n = max(1, -(-6 * total // (5 * rows)))
    place = Window.partitionBy("_b").orderBy("_b")
    return (df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(n)))
            .repartition(max(1, min(n, 4 * df.sparkSession.sparkContext.defaultParallelism)), "_b")
            .withColumn("_c", F.floor((F.row_number().over(place) - 1) / rows))
            .groupBy("_b", "_c").agg(F.collect_list(F.struct(*df.columns)).alias(name)).select(name))


def _unit_rows(vectors, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, which of them are plain): ``vectors`` is an Arrow list of vectors. Those that are null, hold a null or a non-finite value,
    are of another width or of no length that a double can square are not plain, and zero here."""
    out = np.zeros((len(vectors), width))
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False), dtype=bool)
    flat = vectors.filter(pa.array(right)).flatten()
    out[right] = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan"))).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((out * out).sum(axis=1))
        plain = right & (length > PLAIN_LENGTHS[0]) & (length < PLAIN_LENGTHS[1])
    out[~plain] = 0.0
    return out / np.where(plain, length, 1.0)[:, None], plain


def _over_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt over the cores by ``keys``. The work on pairs grows with the square, so a shuffle of the vectors is nothing to it; a file
    of one row group is one task's whatever its splits."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _differing(a, b) -> np.ndarray:
    """Differing bits of every signature of ``b`` (rows) and of ``a`` (columns); pairs with a null signature differ in all."""
    words = max([0, *pc.list_value_length(a).drop_null().to_pylist()[:1]])
    out = np.full((len(b), len(a)), np.iinfo(np.int32).max, dtype=np.int32)
    here, there = (np.asarray(x.is_valid()) for x in (a, b))
    left, right = (np.asarray(x.drop_null().flatten()).astype(np.uint64).reshape(-1, max(words, 1)) for x in (a, b))
    bits = np.zeros((len(right), len(left)), dtype=np.int32)
    for w in range(words):
        bits += np.bitwise_count(right[:, w, None] ^ left[None, :, w])
    out[np.ix_(there, here)] = bits
    return out


def near_in_block(c: dict, q: dict, k: int, min_score: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of vectors, positions of queries): the pairs of a block that may be among a query's best ``k`` of at least
    ``min_score``. Only pairs that pass the query's filters count, and with ``most`` only those whose signatures differ in at most so many bits;
    a pair with a vector that is not plain stays in."""
    widths = pc.list_value_length(q["q_embedding"]).drop_null()
    width = pc.mode(widths)[0]["mode"].as_py() if len(widths) else 0
    (cu, c_plain), (qu, q_plain) = _unit_rows(c["embedding"], width), _unit_rows(q["q_embedding"], width)
    fits = np.ones((len(qu), len(cu)), dtype=bool)
    for value, wanted, optional in (("embedding_model", "q_model", False), ("country", "country_filter", True), ("project_id", "project_filter", True)):
        values = np.array(c[value].to_pylist(), dtype=object)
        wants = q[wanted].to_pylist()
        same = {w: values == w for w in set(wants) if w is not None}
        for j, w in enumerate(wants):
            if w is not None:
                fits[j] &= same[w]
            elif not optional:
                fits[j] = False
    if most is not None:
        fits &= _differing(c["signature"], q["q_signature"]) <= most
    plain = q_plain[:, None] & c_plain[None, :]
    score = np.where(fits & plain, qu @ cu.T, -np.inf)
    least = np.full(len(qu), min_score)
    if score.shape[1] > k:
        least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
    j, i = np.nonzero((fits & ~plain) | ((score >= least[:, None] - PRODUCT_ERROR) & fits))
    return i, j


def _near_pairs(k: int, min_score: float, most: int | None, c_fields: list[str], q_fields: list[str]):
    """The pairs of :func:`near_in_block` of two blocks, as rows of at most ``PAIRS_A_ROW`` pairs of positions."""
    pair = pa.struct([("i", pa.int32()), ("j", pa.int32())])

    @F.arrow_udf("array<array<struct<i:int,j:int>>>")
    def near(blocks: pa.Array) -> pa.Array:
        out, columns = [], blocks.flatten()
        for n in range(len(blocks)):
            parts = [column[n].values for column in columns]
            i, j = near_in_block(dict(zip(c_fields, parts)), dict(zip(q_fields, parts[len(c_fields):])), k, min_score, most)
            pairs = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())], fields=list(pair))
            cuts = pa.array([*range(0, len(i), PAIRS_A_ROW), len(i)], pa.int32())
            out.append(pa.ListArray.from_arrays(cuts, pairs))
        ends = np.cumsum([0, *[len(rows) for rows in out]])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(out))

    return near


def _scored_batch(corpus: DataFrame, queries: DataFrame, k: int, min_score: float, most: int | None = None) -> DataFrame:
    """The pairs that pass their query's filters, with their cosine; of those that cannot be among a query's best ``k`` of at least
    ``min_score`` most are left out: blocks of vectors meet blocks of queries, one matrix product each (Arrow). With ``most``, both have a
    ``signature``, and only pairs that differ in at most so many bits are scored."""
    ship_package(corpus.sparkSession)
    q = queries.select("query_id", F.col("embedding").alias("q_embedding"),
                       F.col("country_filter"), F.col("project_filter"), F.col("embedding_model").alias("q_model"),
                       *([] if most is None else [F.col("signature").alias("q_signature")]))
    cond = ((F.col("embedding_model") == F.col("q_model"))
            & (F.col("country_filter").isNull() | (F.lower("country") == F.lower("country_filter")))
            & (F.col("project_filter").isNull() | (F.col("project_id") == F.col("project_filter"))))
    # of rows that every query scores alike, the first k are enough
    alike = Window.partitionBy(F.xxhash64("embedding"), "embedding", "embedding_model", F.lower("country"), "project_id").orderBy("chunk_id")
    some = _over_cores(corpus, "chunk_id").withColumn("_alike", F.row_number().over(alike)).filter(F.col("_alike") <= k).drop("_alike")
    blocks = _blocks(some.withColumn("_country", F.lower("country")), "_vectors", BLOCK_VECTORS, corpus.count(), "chunk_id", "embedding") \
        .crossJoin(F.broadcast(_blocks(q.withColumn("_country_filter", F.lower("country_filter")), "_queries", BLOCK_QUERIES,
                                       queries.count(), "query_id", "q_embedding")))
    signature = [] if most is None else ["signature"]
    c_fields = ["embedding", "embedding_model", "country", "project_id", *signature]
    q_fields = ["q_embedding", "q_model", "country_filter", "project_filter", *[f"q_{f}" for f in signature]]
    lower = {"country": "_country", "country_filter": "_country_filter"}
    near = _near_pairs(k, min_score, most, c_fields, q_fields)(F.struct(
        *[F.col(f"_vectors.{lower.get(f, f)}").alias(f) for f in c_fields], *[F.col(f"_queries.{lower.get(f, f)}").alias(f) for f in q_fields]))
    rows = blocks.select("_vectors", "_queries", F.explode(near).alias("_pairs"))
    pairs = rows.select(F.explode(F.transform("_pairs", lambda p: F.struct(
        F.get("_vectors", p["i"]).alias("c"), F.get("_queries", p["j"]).alias("q")))).alias("_pair"))
    return pairs.select("_pair.c.*", "_pair.q.*").drop("_country", "_country_filter").filter(cond) \
        .withColumn("retrieval_score", cosine(F.col("embedding"), F.col("q_embedding")))


def semantic_search_batch(corpus: DataFrame, queries: DataFrame, k: int = 8,
                          min_score: float = MIN_RETRIEVAL_SCORE,
                          max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Per query: filters, cosine, top-k, threshold. ``queries`` needs
    query_id, embedding, country_filter, project_filter, embedding_model."""
    n = queries.count()
    if n <= max_broadcast:
        passes = [queries]
    else:  # split the query table into broadcast-sized slices by a hash of the id
        slices = math.ceil(n / max_broadcast)
        passes = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i) for i in range(slices)]
    out = None
    for qpart in passes:
        scored = _scored_batch(corpus, qpart, k, min_score)
        w = Window.partitionBy("query_id").orderBy(F.col("retrieval_score").desc(), F.col("chunk_id"))
        top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        res = top.filter(F.col("retrieval_score") >= min_score) \
            .withColumn("retrieval_score", F.round("retrieval_score", 4)).drop("q_embedding")
        out = res if out is None else out.unionByName(res)
    return out


def abstention(queries: DataFrame, results: DataFrame) -> DataFrame:
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"))
    j = queries.select("query_id").join(counts, "query_id", "left")
    rc = F.coalesce(F.col("result_count"), F.lit(0)).cast("long")
    return j.select("query_id", rc.alias("result_count"), (rc == 0).alias("abstained"),
                    F.when(rc == 0, F.lit(ABSTAIN_MESSAGE)).otherwise(F.lit(ANSWER_MESSAGE)).alias("message"))


def query_log(queries: DataFrame, results: DataFrame) -> DataFrame:
    a = abstention(queries, results)
    return queries.select("query_id", "country_filter", "project_filter", "embedding_model") \
        .join(a.select("query_id", "result_count", "abstained"), "query_id")


def retrieval_metrics(results: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """precision@k, MRR, citation coverage, filter accuracy, zero-result rate
    and duplicate rate. ``results`` carries query_id, rank, record_id,
    official_url, country, country_filter and a boolean ``relevant``."""
    r = results.filter(F.col("rank") <= k)
    per_q = r.groupBy("query_id").agg(
        F.sum(F.when(F.col("relevant"), 1).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"),
        F.every(F.coalesce(F.col("official_url"), F.lit("")).startswith("https://")).alias("cited"),
        F.every(F.col("country_filter").isNull() | (F.lower("country") == F.lower("country_filter"))).alias("filtered"),
        (F.count(F.lit(1)) - F.count_distinct("record_id")).alias("dupes"))
    allq = queries.select("query_id").join(per_q, "query_id", "left")
    return allq.agg(
        F.round(F.avg(F.coalesce(F.col("hits"), F.lit(0)) / F.lit(float(k))), 3).alias("precision_at_5"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))), 3).alias("mrr"),
        F.round(F.avg(F.coalesce(F.col("cited"), F.lit(True)).cast("double")), 3).alias("citation_coverage"),
        F.round(F.avg(F.coalesce(F.col("filtered"), F.lit(True)).cast("double")), 3).alias("metadata_filter_accuracy"),
        F.round(F.avg(F.col("hits").isNull().cast("double")), 3).alias("zero_result_rate"),
        F.round(F.sum(F.coalesce(F.col("dupes"), F.lit(0))) / (F.lit(float(k)) * F.count(F.lit(1))), 3)
        .alias("duplicate_result_rate"))


# ------------------------------------------------------------------------------ hashed tokens

def token_bucket(token: Column, dimensions: int = HASH_EMBED_DIMENSIONS) -> Column:
    """First 4 bytes of sha256(token) as an unsigned int, modulo ``dimensions``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def token_vocabulary(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    toks = chunks.select(F.explode(T.tokens(F.col(text_col), TOKEN_PATTERN)).alias("token")).distinct()
    return toks.select("token", token_bucket(F.col("token")).alias("bucket"))


def hash_embed(chunks: DataFrame, text_col: str = "text", dimensions: int = HASH_EMBED_DIMENSIONS) -> DataFrame:
    """Adds ``embedding``: distinct-token counts per hash bucket, L2-normalized; all zeros for a text that is null or has no token.

    Row-local native expressions only (no shuffle, no Python). The sorted
    bucket array is bound once; the vector is the runs of zeros between the row's few distinct
    buckets and their weights, so a row costs a lambda call per distinct bucket, not per dimension. Every lambda touches only
    bound variables: a lambda naming an outer column would re-evaluate that column per element.
    """
    buckets = F.array_sort(F.transform(T.tokens(F.coalesce(F.col(text_col), F.lit("")), TOKEN_PATTERN),
                                       lambda t: token_bucket(t, dimensions)))

    def zeros(n):
        return F.array_repeat(F.lit(0.0).cast("float"), n)

    def embed(bs):
        def counted(x):  # x: distinct buckets in order, and how often each stands in bs
            length = F.sqrt(F.aggregate(x["n"], F.lit(0.0), lambda s_, n: s_ + n * n))

            def run(length_):
                return F.flatten(F.transform(x["d"], lambda d, i: F.concat(
                    zeros(d - F.coalesce(F.get(x["d"], i - 1), F.lit(-1)) - 1), F.array((F.get(x["n"], i) / length_).cast("float")))))
            return F.concat(F.element_at(F.transform(F.array(length), run), 1), zeros(dimensions - 1 - F.coalesce(F.array_max(x["d"]), F.lit(-1))))

        distinct = F.array_distinct(bs)
        times = F.transform(distinct, lambda d: F.size(F.filter(bs, lambda b: b == d)).cast("double"))
        return F.element_at(F.transform(F.array(F.struct(distinct.alias("d"), times.alias("n"))), counted), 1)

    emb = F.element_at(F.transform(F.array(buckets), embed), 1)
    return chunks.withColumn("embedding", emb)


class HashEmbedder:
    """Python twin of :func:`hash_embed` for the pluggable encode() path."""

    model_name = "token-hash-256"
    dimensions = HASH_EMBED_DIMENSIONS

    def encode(self, texts: list[str]) -> list[list[float]]:
        import re
        out = []
        for text in texts:
            vec = [0.0] * self.dimensions
            for tok in set(re.findall(TOKEN_PATTERN, (text or "").lower())):
                b = int.from_bytes(hashlib.sha256(tok.encode()).digest()[:4], "big") % self.dimensions
                vec[b] += 1.0
            n = math.sqrt(sum(v * v for v in vec))
            out.append([v / n for v in vec] if n else vec)
        return out


def embed_with(chunks: DataFrame, embedder_factory, text_col: str = "text", batch_size: int = 64) -> DataFrame:
    """Embed through any :class:`Embedder` in an iterator pandas UDF: the model
    is built once per Python worker and fed Arrow batches of ``batch_size``."""
    probe = embedder_factory()
    dims, model = probe.dimensions, probe.model_name

    @F.pandas_udf(ArrayType(FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        emb = embedder_factory()
        for s in batches:
            vals = []
            for start in range(0, len(s), batch_size):
                part = emb.encode([x if x is not None else "" for x in s.iloc[start:start + batch_size].tolist()])
                if any(len(v) != dims for v in part):
                    raise RetrievalConfigurationError("Embedding model returned an unexpected vector dimension")
                vals.extend(part)
            yield pd.Series(vals)

    return chunks.withColumn("embedding", _encode(F.col(text_col))).withColumn("embedding_model", F.lit(model))


# ------------------------------------------------------------------------------ approximate search

SIGNATURE_BITS = 512
RECALL = 0.95
BROADCAST_BYTES = 8 << 20


def with_signature(vectors: DataFrame, dimensions: int, bits: int = SIGNATURE_BITS, seed: int = 7) -> DataFrame:
    """Adds ``signature``: the sides of ``bits`` random hyperplanes a vector lies on, 64 to a long (Arrow batches, one matrix
    product each). A null vector, or one of another length, has none."""
    planes = np.random.default_rng(seed).standard_normal((dimensions, bits)).astype(np.float32)

    @F.pandas_udf("array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            good = [v is not None and len(v) == dimensions for v in s]
            out = pd.Series([None] * len(s), dtype=object)
            if any(good):
                sides = np.stack([np.asarray(v, dtype=np.float32) for v, g in zip(s, good) if g]) @ planes > 0
                words = np.packbits(sides, axis=1, bitorder="little").view("<i8")
                out[np.flatnonzero(good)] = pd.Series(list(words), index=np.flatnonzero(good))
            yield out

    return vectors.withColumn("signature", sign("embedding"))


def most_differing(min_score: float, bits: int = SIGNATURE_BITS, recall: float = RECALL) -> int:
    """The differing bits up to which a pair of cosine ``min_score`` is found with probability ``recall``: a bit differs with
    probability angle / pi, independently (normal approximation). Pairs of higher cosine are found oftener."""
    p = math.acos(min_score) / math.pi
    return math.ceil(bits * p + statistics.NormalDist().inv_cdf(recall) * math.sqrt(bits * p * (1 - p)))


def ann_index(corpus: DataFrame, path: str, dimensions: int, bits: int = SIGNATURE_BITS) -> DataFrame:
    """The written signature index: a row a vector, split by model."""
    cols = ["chunk_id", "embedding", "country", "project_id", "signature", "embedding_model"]
    signed = with_signature(_over_cores(corpus, "chunk_id"), dimensions, bits).select(*cols)
    signed.write.mode("errorifexists").partitionBy("embedding_model").parquet(path)
    return corpus.sparkSession.read.schema(signed.schema).parquet(path)


def ann_candidates(index: DataFrame, queries: DataFrame, dimensions: int, min_score: float = MIN_RETRIEVAL_SCORE,
                   bits: int = SIGNATURE_BITS, recall: float = RECALL) -> DataFrame:
    """(query_id, chunk_id, retrieval_score): pairs whose signatures differ in few enough bits, scored exactly.

    Comparing a pair's signatures is a few xors and bit counts inside the scan's generated code; only pairs that
    pass get a cosine. The query set is a stated one: it is broadcast if its counted bytes fit, else in as many parts.
    """
    q = with_signature(queries, dimensions, bits).select(
        "query_id", F.col("embedding").alias("q_embedding"), "country_filter", "project_filter",
        F.col("embedding_model").alias("q_model"), F.col("signature").alias("q_signature"))
    parts = max(1, -(-queries.count() * (dimensions * 8 + bits // 8 + 200) // BROADCAST_BYTES))
    differing = sum(F.bit_count(F.get("signature", F.lit(i)).bitwiseXOR(F.get("q_signature", F.lit(i)))) for i in range(bits // 64))
    near = ((F.col("embedding_model") == F.col("q_model")) & (differing <= most_differing(min_score, bits, recall))
            & (F.col("country_filter").isNull() | (F.lower("country") == F.lower("country_filter")))
            & (F.col("project_filter").isNull() | (F.col("project_id") == F.col("project_filter"))))
    out = None
    for i in range(parts):
        some = q if parts == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        pairs = _over_cores(index, "chunk_id").join(F.broadcast(some), near).select("query_id", "chunk_id", cosine(F.col("embedding"), F.col("q_embedding")).alias("retrieval_score"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def ann_search(index: DataFrame, queries: DataFrame, dimensions: int, k: int = 8, min_score: float = MIN_RETRIEVAL_SCORE,
               bits: int = SIGNATURE_BITS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, chunk_id, retrieval_score): a query's best ``k`` candidates (see :func:`ann_candidates`) of at least ``min_score``.
    Blocks of vectors meet blocks of queries; what cannot be among the best of its block is not scored again."""
    q = with_signature(queries, dimensions, bits)
    parts = max(1, -(-queries.count() * (dimensions * 8 + bits // 8 + 200) // BROADCAST_BYTES))
    most, found = most_differing(min_score, bits, recall), None
    for i in range(parts):
        some = q if parts == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        pairs = _scored_batch(index, some, k, min_score, most).filter(F.col("retrieval_score") >= min_score)
        found = pairs if found is None else found.unionByName(pairs)
    w = Window.partitionBy("query_id").orderBy(F.col("retrieval_score").desc(), F.col("chunk_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "chunk_id", F.round("retrieval_score", 4).alias("retrieval_score"))
