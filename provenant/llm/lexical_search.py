"""Ranked lexical search with exact whole-number scores, by buckets of impact vectors ordered by length.

A document's impact vector holds (1000000000 * tf) div (1000 * tf + 8 * m) for each of its terms that some item
has; an item's vector holds the terms' weights w. The score is their inner product.

1. One pass finds the terms of every whole text on its UTF-8 bytes, counts them and keeps
   tf of the items' terms. Its table is written; document counts, lengths and df are sums over it.
2. Each task orders its vectors by length (Spark sorts, so memory is bounded) and cuts them into buckets. For an item whose tenth best score so
   far is t, a bucket is left out if item length * longest vector < t (Cauchy-Schwarz). Inside, only the item's heaviest
   terms are looked up, as many as it needs until the rest's length * longest vector < t; a vector stays if its products on these terms
   plus the rest's length * the length left to the vector reach t. Survivors are scored over all their terms in 64-bit integers.
3. t starts from the exact scores of one document in ``SEED_OF`` (by a hash of its place): a tenth best of fewer
   documents is never above the true one, so nothing is lost. Spark merges the tasks' lists, ten rows an item each.

Items are the stated query set: they travel to the tasks in blocks of ``BLOCK_TERMS`` (item, term) pairs on average (an item is never
cut), one search a block. Bounds
are doubles widened by 1e-9; a term's 64-bit hash is confirmed by its bytes.

Defined results: null and empty texts have no terms and match nothing; terms count once in an item; an item of null id is an
item; equal scores rank by ascending doc_id, null first, and repeated rows of one doc_id each take a rank; empty
tables give an empty result; very long texts are whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm import common as C

TOP = 10
SEED_OF = 32
BUCKET = 4096
BLOCK_TERMS = 1 << 18
# Fixed values of the score.
SCALE, TF_SCALE, LENGTH_SCALE, SLOPE = 1000000000, 1000, 8, 90
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_IN_TERM = np.ones(256, dtype=bool)
_IN_TERM[:0x80] = False
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WIDER = 1 + 1e-9


def _term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owning text of all terms."""
    inside = _IN_TERM[data]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~(inside[:-1] & (owner[1:] == owner[:-1]))
    last[:-1] &= ~(inside[1:] & (owner[1:] == owner[:-1]))
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, owner[starts]


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends, owners and hashes of the terms of a text column."""
    data, offsets = C.text_bytes(column)
    data = _LOWER[data]
    starts, ends, owner = _term_bounds(data, offsets)
    return data, starts, ends, owner, C.span_hashes(data, starts, ends) ^ (ends - starts).astype(np.uint64)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, term) with each term once an item row; item is the row's place."""
    rows = C.written(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0)))
    return rows.select("item", "item_id", F.explode(found).alias("term"))


class Vocabulary:
    """The items' terms: sorted hashes, and the bytes that confirm them."""

    def __init__(self, terms: list[str]):
        self.raw = [t.encode() for t in terms]
        hashes = _terms(pa.array(terms, pa.string()))[4]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two terms share a hash")

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each term's number, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        out = np.full(len(hashes), -1, dtype=np.int64)
        out[hit] = self.order[at[hit]]
        for which, place in zip(*np.unique(out[hit], return_index=True), strict=True):
            one = hit[place]
            if data[starts[one]:ends[one]].tobytes() != self.raw[which]:
                raise ValueError("a document's term shares its hash with an item's")
        return out


def _counted(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tf): the terms of each text, and those of the vocabulary with their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(words.hashes), 1)
        for whole in batches:
            for batch in C.slabs(whole, "text", C.WIDE_SLAB_BYTES):
                data, starts, ends, owner, hashes = _terms(batch.column(1))
                n = np.bincount(owner, minlength=batch.num_rows)
                ids = words.ids(data, starts, ends, hashes)
                keys, tf = np.unique(owner[ids >= 0] * size + ids[ids >= 0], return_counts=True)
                bounds = np.searchsorted(keys // size, np.arange(batch.num_rows + 1))
                terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys % size, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), terms, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tf, pa.int32()))],
                                                 names=["doc_id", "n", "terms", "tf"])
    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Items:
    """A block of items as rows of term numbers by falling weight, and the lengths of what is left after each term."""

    def __init__(self, rows: list[np.ndarray], weights: np.ndarray):
        self.terms = [t[np.argsort(-weights[t], kind="stable")] for t in rows]
        self.weights = weights
        self.left = []
        for terms in self.terms:
            squares = np.cumsum((weights[terms].astype(np.float64) ** 2)[::-1])[::-1]
            self.left.append(np.sqrt(np.append(squares, 0.0)) * _WIDER)
        self.length = np.array([left[0] for left in self.left])


class _Bucket:
    """Vectors of a task in order of length, with their entries by term."""

    def __init__(self, terms: np.ndarray, impacts: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, vocabulary: int):
        self.terms, self.impacts, self.bounds, self.lengths = terms, impacts, bounds, lengths
        owner = np.repeat(np.arange(len(lengths)), np.diff(bounds))
        order = np.argsort(terms, kind="stable")
        self.by_owner, self.by_impact = owner[order], impacts[order]
        self.at = np.searchsorted(terms[order], np.arange(vocabulary + 1))

    def survivors(self, items: Items, item: int, least: int) -> np.ndarray:
        """Vectors whose bound reaches ``least``."""
        longest = float(self.lengths.max()) * _WIDER
        terms, left = items.terms[item], items.left[item]
        heavy = int(np.argmax(left * longest < max(least, 1)))
        partial, squares = np.zeros(len(self.lengths)), np.zeros(len(self.lengths))
        for term in terms[:heavy].tolist():
            some = slice(self.at[term], self.at[term + 1])
            owner, impact = self.by_owner[some], self.by_impact[some].astype(np.float64)
            partial[owner] += float(items.weights[term]) * impact
            squares[owner] += impact * impact
        rest = np.sqrt(np.maximum(self.lengths * self.lengths * _WIDER - squares, 0.0))
        return np.flatnonzero((partial + left[heavy] * rest) * _WIDER >= max(least, 1))

    def scores(self, items: Items, item: int, some: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of vectors; ``dense`` is a zero array over the vocabulary."""
        terms = items.terms[item]
        dense[terms] = items.weights[terms]
        sizes = np.diff(self.bounds)[some]
        ends = np.cumsum(sizes)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[some] - ends + sizes, sizes)
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(dense[self.terms[entry]] * self.impacts[entry])))
        dense[terms] = 0
        return sums[ends] - sums[ends - sizes]


def _best(scores: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return np.lexsort((doc_ids, ~nulls, -scores))[:TOP]


def _search(vectors: DataFrame, items: Items, documents: int, total: int, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): each task's ten best documents an item, of scores at least ``least``."""
    size = len(items.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = least.copy()
        held: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.terms]
        dense = np.zeros(size, dtype=np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, BUCKET):
                batch = whole.slice(low, BUCKET)
                lists = batch.column(1)
                bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
                impacts = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                bucket = _Bucket(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), impacts, bounds, batch.column(3).to_numpy(zero_copy_only=False), size)
                reach = items.length * float(bucket.lengths.max()) * _WIDER
                for item in np.flatnonzero(reach >= np.maximum(bar, 1)).tolist():
                    some = bucket.survivors(items, item, int(bar[item]))
                    if not len(some):
                        continue
                    scores = bucket.scores(items, item, some, dense)
                    good = scores >= max(int(bar[item]), 1)
                    some, scores = some[good], scores[good]
                    scores, doc, null = (np.concatenate(x) for x in zip(held[item], (scores, ids[some], nulls[some]), strict=True))
                    best = _best(scores, doc, null)
                    held[item] = (scores[best], doc[best], null[best])
                    if len(best) == TOP:
                        bar[item] = max(bar[item], held[item][0][-1])
        for item, (scores, doc, null) in enumerate(held):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item), pa.int32()), pa.array(doc, pa.int64(), mask=null), pa.array(scores, pa.int64())],
                                                 names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def _top(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _ordered(counted: DataFrame, documents: int, total: int) -> DataFrame:
    """(doc_id, terms, impacts, length), the longest first in each partition."""
    m = F.lit(100 - SLOPE) + F.expr(f"({SLOPE} * n * {documents}L) div {max(total, 1)}L")
    impacts = F.transform("tf", lambda x: F.call_function("div", x.cast("long") * SCALE, x.cast("long") * TF_SCALE + F.col("m") * LENGTH_SCALE))
    length = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = counted.where("size(terms) > 0").withColumn("m", m).withColumn("impacts", impacts).withColumn("length", length)
    return rows.select("doc_id", "terms", "impacts", "length").sortWithinPartitions(F.desc("length"))


def _search_block(docs: DataFrame, pairs: list, by_item: list[int]) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items; ``pairs`` are its (item, term) rows."""
    spark = docs.sparkSession
    vocabulary = sorted({r["term"] for r in pairs})
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = C.written(_counted(docs, Vocabulary(vocabulary)), "terms")
    documents, total = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(df.get(i, 0), documents) for i in range(len(vocabulary))], dtype=np.int64)
    rows: dict[int, list[int]] = {i: [] for i in by_item}
    for r in pairs:
        if number[r["term"]] in df:
            rows[r["item"]].append(number[r["term"]])
    items = Items([np.array(sorted(rows[i]), dtype=np.int64) for i in by_item], weights)
    vectors = _ordered(counted, documents, total)
    seeds = _top(_search(_ordered(counted.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_OF)) == 0), documents, total), items, documents, total, np.zeros(len(by_item), dtype=np.int64)))
    least = np.zeros(len(by_item), dtype=np.int64)
    for r in seeds.where(F.col("rank") == TOP).collect():  # one row an item of the block
        least[r["item"]] = r["score"]
    found = _top(_search(vectors, items, documents, total, least))
    names = spark.createDataFrame([(i, int(item)) for i, item in enumerate(by_item)], "item int, place long")
    return found.join(F.broadcast(names), "item").select(F.col("place").alias("item"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents of every item, fewer if fewer score above 0."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    terms = C.written(item_terms(items, item_id, text), "item-terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    out = terms.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")
    for block in range(blocks):
        pairs = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "term").collect()
        if pairs:
            out = out.unionByName(_search_block(docs, pairs, sorted({r["item"] for r in pairs})))
    return out.join(terms.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), i AS (
  SELECT item, item_id, unnest(list_distinct(terms)) AS term FROM (SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM benchmark)
), v AS (SELECT DISTINCT term FROM i
), t AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (FROM v) GROUP BY ALL
), f AS (SELECT term, count(*) AS df FROM t GROUP BY term
), x AS (
  SELECT t.row, t.doc_id, t.term, floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * f.df + 1)::DOUBLE))::BIGINT * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * t.n * s.docs) // s.total))) AS part
  FROM t JOIN f ON t.term = f.term CROSS JOIN s
), r AS (SELECT i.item, i.item_id, x.row, x.doc_id, sum(x.part)::BIGINT AS score FROM i JOIN x ON i.term = x.term GROUP BY ALL HAVING sum(x.part) > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r) WHERE rank <= 10
"""
