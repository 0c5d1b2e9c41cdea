"""LM scoring with a hidden Markov language model over word classes.

Tokens are lower-cased (A-Z) words and one end a text. A word's class is its own if it is among the
``TOP`` most frequent training tokens, else one of ``SUFFIXES`` classes of word endings. A token has
probability P(class | state) * P(word | class): the states' tables have a fixed size, and P(word |
class) = (c + 1) / (class tokens + class words + 1) leaves one share of each class to unseen words.

1. Blocks of whole texts (``BLOCK_BYTES``) become word numbers and each block's distinct words.
2. Training counts of all words are summed over the corpus by word, and every block's words look
   their counts up in a join; no task and no driver holds the vocabulary.
3. Baum-Welch: each pass sums expected counts of starts, transitions and emissions over the blocks.
   Each of the ``PASSES`` passes runs over all training texts. Texts of more than ``PIECE`` tokens run as pieces side by side, each with
   ``MARGIN`` tokens of its neighbours on both sides, which carry the recursions over the cut and are counted by their owner: every token
   and transition counts once, and only a text's first token counts as a start. What the recursions still remember of
   the margin's far end shrinks with every token (a test holds the counts to 1e-4 of the uncut ones). The sums are at most STATES * (STATES + classes + 1) numbers.
4. The scaled forward recursion runs over each whole text and gives its exact log likelihood.

Words are known by 64-bit hashes whose low bits are the class of the word's ending.

Defined results: a null or empty text is the end token alone; without training texts every token is unseen; repeated
rows each come back and count each; a null doc_id is folded as the empty text; extra columns are ignored;
very long texts are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm import common as C

STATES = 8
TOP = 1024
SUFFIXES = 1024
SUFFIX_BYTES = 3
CLASSES = TOP + SUFFIXES
BLOCK_BYTES = 8 << 20
PASSES = 10
PIECE = 512
MARGIN = 64
ROWS = 512
STICKY = 0.9
SMOOTH = 0.01
PLACE_BITS = 27  # a block's distinct words: more than any text that fits a column has
END = np.uint64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    number = TaskContext.get().partitionId() << 16
    for whole in batches:
        for batch in C.slabs(whole, most=BLOCK_BYTES):
            data, offsets = C.text_bytes(batch.column(1))
            data = _LOWER[data]
            starts, ends, bounds = C.word_bounds(data, offsets)
            words = C.span_hashes(data, starts, ends)
            tail = np.zeros(len(words), dtype=np.uint64)
            for k in range(1, SUFFIX_BYTES + 1):
                has = ends - k >= starts
                tail[has] = tail[has] * np.uint64(257) + data[ends[has] - k].astype(np.uint64) + np.uint64(1)
            words = (words & ~np.uint64(SUFFIXES - 1)) | (C.mix(tail) & np.uint64(SUFFIXES - 1))
            counts = np.diff(bounds) + 1
            at = np.concatenate(([0], np.cumsum(counts)))
            is_end = np.zeros(at[-1], dtype=bool)
            is_end[at[1:] - 1] = True
            tokens = np.full(at[-1], END, dtype=np.uint64)
            tokens[~is_end] = words
            # Frequent words get small numbers, so that the numbers' high halves are mostly zero and pack well.
            names, back, times = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(names), dtype=np.uint32)
            rank[order] = np.arange(len(names), dtype=np.uint32)
            seq, names = rank[back], names[order]
            train = np.asarray(batch.column(2))
            own = np.bincount(seq[np.repeat(train, counts)], minlength=len(names)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64()))]
                + [pa.array([x.tobytes()], pa.binary()) for x in (train.astype(np.uint8), at.astype(np.int64), (seq & 0xFFFF).astype(np.uint16), (seq >> 16).astype(np.uint16), names, own)],
                names=["block", "doc_ids", "train", "at", "low", "high", "names", "own"])
            number += 1


_BLOCK_TYPE = "block long, doc_ids array<long>, train binary, at binary, low binary, high binary, names binary, own binary"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, word, own): place is the block and the word's number in it."""
    for batch in batches:
        for row in batch.to_pylist():
            names = np.frombuffer(row["names"], dtype=np.int64)
            if len(names) >> PLACE_BITS:
                raise ValueError("a block has too many distinct words")
            yield pa.RecordBatch.from_arrays([pa.array((row["block"] << PLACE_BITS) + np.arange(len(names))), pa.array(names), pa.array(np.frombuffer(row["own"], dtype=np.uint32).astype(np.int64))],
                                             names=["place", "word", "own"])


def _coded(total: int, distinct: int, top: dict[int, int], sizes: np.ndarray):
    """Per block: classes of its tokens, and each text's token counts, base score and log10 P(words | classes)."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        names = np.array(sorted(top), dtype=np.int64)
        ranks = np.array([top[n] for n in names.tolist()], dtype=np.int64)
        for row in left.to_pylist():
            word = np.frombuffer(row["names"], dtype=np.int64)
            count = np.zeros(len(word), dtype=np.int64)
            count[right.column("idx").to_numpy()] = right.column("c").to_numpy()
            klass = TOP + (word & (SUFFIXES - 1))
            if len(names):
                place = np.minimum(np.searchsorted(names, word), len(names) - 1)
                klass = np.where(names[place] == word, ranks[place], klass)
            base = np.log10((count + 1) / (total + distinct + 1))
            share = np.where(klass < TOP, 0.0, np.log10((count + 1) / sizes[klass]))
            seq = np.frombuffer(row["low"], dtype=np.uint16).astype(np.int64) + (np.frombuffer(row["high"], dtype=np.uint16).astype(np.int64) << 16)
            at = np.frombuffer(row["at"], dtype=np.int64)
            first = at[:-1]
            out.append({"block": row["block"], "doc_ids": row["doc_ids"], "train": row["train"], "at": row["at"], "classes": klass[seq].astype(np.uint16).tobytes(),
                        "known": np.add.reduceat((count > 0)[seq].astype(np.int64), first).tobytes(), "base": np.add.reduceat(base[seq], first).tobytes(),
                        "share": np.add.reduceat(share[seq], first).tobytes()})
        return pa.Table.from_pylist(out, schema=_CODED)
    return run


_CODED = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("train", "at", "classes", "known", "base", "share"))])
_CODED_TYPE = "block long, doc_ids array<long>, train binary, at binary, classes binary, known binary, base binary, share binary"


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def first_guess(classes: np.ndarray, seed: int = 5) -> Hmm:
    """Sticky states whose emissions are the classes' frequencies with seeded noise."""
    rng = np.random.default_rng(seed)
    move = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1))
    np.fill_diagonal(move, STICKY)
    emit = (classes + SMOOTH) * np.exp(rng.normal(0, 0.7, (STATES, CLASSES)))
    return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))


def _pieces(at: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The training texts' pieces, longest first: starts and lengths with margins, the margin before and the own tokens."""
    many = -(-np.diff(at) // PIECE) * train
    owner = np.repeat(np.arange(len(train)), many)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    begin = at[:-1][owner] + within * PIECE
    own = np.minimum(PIECE, at[1:][owner] - begin)
    lead = np.where(within > 0, MARGIN, 0)
    lengths = lead + np.minimum(own + MARGIN, at[1:][owner] - begin)
    order = np.argsort(-lengths, kind="stable")
    return (begin - lead)[order], lengths[order], lead[order], own[order]


def expected(model: Hmm, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, out: list[np.ndarray],
             lead: np.ndarray | None = None, own: np.ndarray | None = None) -> None:
    """Add the expected starts, transitions and emissions of equal batches of pieces (longest first) to ``out``. Of a piece with
    margins (``lead`` tokens before its ``own``), its own tokens and the transitions into them count."""
    move, emit = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T.astype(np.float32))
    lead = np.zeros(len(starts), dtype=np.int64) if lead is None else lead
    own = lengths if own is None else own
    for low in range(0, len(starts), ROWS):
        s, n, before, mine = (x[low:low + ROWS] for x in (starts, lengths, lead, own))
        longest, m = int(n[0]), len(s)
        active = np.searchsorted(-n, -np.arange(longest), side="left")
        symbols = np.zeros((longest, m), dtype=np.int64)
        for t in range(longest):
            symbols[t, :active[t]] = classes[s[:active[t]] + t]
        step = np.arange(longest)[:, None]
        counted = (step >= before) & (step < before + mine)
        margins = bool((mine != n).any())
        b = emit[symbols]
        alpha = np.zeros((longest, m, STATES), dtype=np.float32)
        scale = np.ones((longest, m, 1), dtype=np.float32)
        x = np.where(before[:, None] > 0, np.float32(1 / STATES), model.start.astype(np.float32)) * b[0]
        for t in range(longest):
            k = active[t]
            if t:
                x = (alpha[t - 1, :k] @ move) * b[t, :k]
            scale[t, :k] = np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
            alpha[t, :k] = x / scale[t, :k]
        beta = np.ones((m, STATES), dtype=np.float32)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            if t < longest - 1:
                after = active[t + 1]
                pull = b[t + 1, :after] * beta[:after] / scale[t + 1, :after]
                out[1] += alpha[t, :after].T @ (pull * counted[t + 1, :after, None] if margins else pull)
                beta[:after] = pull @ move.T
            alpha[t, :k] *= beta[:k]
        first = alpha[0][before == 0]
        out[0] += (first / np.maximum(first.sum(axis=1, keepdims=True), 1e-30)).sum(axis=0)
        flat, symbols = alpha[counted], symbols[counted]
        flat = np.ascontiguousarray((flat / np.maximum(flat.sum(axis=1, keepdims=True), 1e-30)).T)
        for k in range(STATES):
            out[2][k] += np.bincount(symbols, flat[k], CLASSES)


def _gather(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))]
        for batch in batches:
            for row in batch.to_pylist():
                starts, lengths, lead, own = _pieces(np.frombuffer(row["at"], dtype=np.int64), np.frombuffer(row["train"], dtype=np.uint8).astype(np.int64))
                if len(starts):
                    expected(model, np.frombuffer(row["classes"], dtype=np.uint16), starts, lengths, out, lead, own)
        flat = np.concatenate([x.ravel() for x in (out[0], out[1] * model.move, out[2])])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "value"])
    return run


def maximised(sums: np.ndarray) -> Hmm:
    start, move, emit = np.split(sums, [STATES, STATES * (STATES + 1)])
    start, move, emit = start + SMOOTH, move.reshape(STATES, STATES) + SMOOTH, emit.reshape(STATES, CLASSES) + SMOOTH
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def baum_welch(model: Hmm, coded: DataFrame) -> Hmm:
    """One pass: expected counts of all blocks' training texts, summed over the partitions."""
    sums = np.zeros(STATES * (1 + STATES + CLASSES))
    got = coded.select("train", "at", "classes").mapInArrow(_gather(model), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    sums[got.column("at").to_numpy()] = got.column("value").to_numpy()
    return maximised(np.round(sums, 6))


def log_likelihoods(model: Hmm, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 P(classes) of each whole text by the scaled forward recursion, texts side by side."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = at[:-1][order], lengths[order]
    emit = np.ascontiguousarray(model.emit.T)
    out = np.zeros(len(first))
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left") if len(lengths) else []
    x = None
    for t, k in enumerate(active):
        b = emit[classes[first[:k] + t]]
        x = (model.start if x is None else x[:k] @ model.move) * b
        scale = x.sum(axis=1)
        out[:k] += np.log10(scale)
        x /= scale[:, None]
    result = np.empty(len(first))
    result[order] = out
    return result


def _scored(model: Hmm, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["at"], dtype=np.int64)
                score = log_likelihoods(model, np.frombuffer(row["classes"], dtype=np.uint16), at) + np.frombuffer(row["share"], dtype=np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(np.frombuffer(row["train"], dtype=np.uint8) == 0), pa.array(np.diff(at)), pa.array(np.frombuffer(row["known"], dtype=np.int64)),
                     pa.array(np.full(len(at) - 1, total, dtype=np.int64)), pa.array(np.frombuffer(row["base"], dtype=np.float64)), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score_texts(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a Column: true for the documents to learn from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = C.written(rows.mapInArrow(_blocks, _BLOCK_TYPE), "blocks")
    words = blocks.select("block", "names", "own").mapInArrow(_words, "place long, word long, own long")
    vocabulary = C.written(words.where("own > 0").groupBy("word").agg(F.sum("own").alias("c")), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = int(END.astype(np.int64))
    top = vocabulary.orderBy((F.col("word") == end).desc(), F.desc("c"), "word").limit(TOP).select("word", "c").collect()
    ranks = {r.word: i for i, r in enumerate(top)}
    listed = F.broadcast(spark.createDataFrame([(r.word,) for r in top], "word long"))  # TOP rows at most
    rest = vocabulary.join(listed, "word", "left_anti").groupBy(F.col("word").bitwiseAND(F.lit(SUFFIXES - 1)).cast("int").alias("suffix")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).limit(SUFFIXES).collect()
    sizes, counts = np.ones(CLASSES), np.zeros(CLASSES)
    for r in rest:
        sizes[TOP + r.suffix], counts[TOP + r.suffix] = r.c + r.v + 1, r.c
    for i, r in enumerate(top):
        counts[i] = r.c
    # Words that no training text has keep the count 0.
    known = words.select("place", "word").join(vocabulary.select("word", "c"), "word").select(
        F.shiftright("place", PLACE_BITS).alias("block"), F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("idx"), "c")
    sequences = blocks.select("block", "doc_ids", "train", "at", "low", "high", "names")
    coded = C.written(sequences.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_coded(total, distinct, ranks, sizes), _CODED_TYPE), "coded")
    model = first_guess(counts)
    for _ in range(PASSES):
        model = baum_welch(model, coded)
    return coded.select("doc_ids", "train", "at", "classes", "known", "base", "share").mapInArrow(
        _scored(model, total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
