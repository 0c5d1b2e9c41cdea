"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's lower-cased (A-Z) UTF-8 bytes give subwords: the byte n-grams of ``GRAMS`` inside words with
one boundary byte each side, hashed into ``BUCKETS`` rows of an embedding table. A text is the mean of its
subwords' embeddings; a linear softmax gives the language. Every labelled text is learned from or held back: the texts are dealt by
id hash over parts of about ``PART_ROWS``, sorted inside them, and each part's task trains embeddings and softmax by stochastic gradient
descent in numpy, ``EPOCHS`` times over small tables and once over those of ``STEPS`` texts or more. The parts' models become bucket
logits, which are linear, and Spark averages them, weighted by their texts. A sixth of the labelled texts, by id hash, is held back to fit
the temperature that calibrates the scores. The rejection threshold is the score below which ``REJECT`` of all rightly predicted labelled
texts fall; their logits are computed once and Spark takes the quantile.

Because the softmax is linear, each bucket's logits are computed once; scoring sums them over the whole
text in slabs, so neither a long text nor a large table needs more memory.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; without a
labelled text every text is ``und``; labels that are null are not learned from; ids, labels and
sources are never inputs; of equal scores the first language in code-point order wins; repeated rows each come back; very long texts are
read whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm import common as C

GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
WIDTH = 16
PART_ROWS = 12500
EPOCHS = 20
STEPS = 50000
# Subword counts that a task holds at most while it goes over them, and the buckets of a model's row.
PENDING_BYTES = 64 << 20
BLOCK = 1024
RATE = 2.0
REJECT = 0.0005
HELD = 6
TEMPERATURES = np.geomspace(0.25, 4, 33)
UNKNOWN = "und"
_DRAWS = 1 << 40
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[0x20, *range(0x09, 0x0E)]] = 0x20


def _grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, buckets) of the subwords of a text's bytes, for each length: no white space but at one end of them."""
    data = _LOWER[data]
    space = data == 0x20
    for n in GRAMS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        key = np.full(m, n, dtype=np.uint64)
        inner = np.zeros(m, dtype=bool)
        for k in range(n):
            key = key * _U(0x9E3779B97F4A7C15) + data[k:k + m]
            if 0 < k < n - 1:
                inner |= space[k:k + m]
        if n > 2:
            keep = ~inner
        else:
            keep = ~(space[:m] & space[1:])
        starts = np.flatnonzero(keep)
        yield starts, (C.mix(key[starts]) & _U(BUCKETS - 1)).astype(np.int64)


def _sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the table's rows over each text's subwords, and their number."""
    out, many = np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1)
    for first in range(0, max(len(data), 1), C.SLAB_BYTES):
        # A slab reads the few bytes that subwords reach behind its end.
        part = data[first:first + C.SLAB_BYTES + max(GRAMS) - 1]
        for starts, buckets in _grams(part):
            starts = starts + first
            keep = starts < first + C.SLAB_BYTES
            starts, buckets = starts[keep], buckets[keep]
            owner = np.searchsorted(offsets, starts, side="right") - 1
            bounds = np.searchsorted(owner, np.arange(len(out) + 1))
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                many[full] += np.diff(bounds)[full]
                for c in range(table.shape[1]):
                    out[full, c] += np.add.reduceat(table[:, c][buckets], bounds[:-1][full])
    return out, many


def _separated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a space before and after each text, so that subwords never span two texts."""
    data, offsets = C.text_bytes(column)
    sizes = np.diff(offsets)
    out = np.full(len(data) + 2 * len(sizes), 0x20, dtype=np.uint8)
    new = offsets + 2 * np.arange(len(offsets))
    out[np.arange(len(data)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = data
    return out, new


def _counts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) of each text: its distinct subwords and their shares."""
    for row, label in enumerate(batch.column(0).to_pylist()):
        data, _ = _separated(batch.column(1).slice(row, 1))
        ids, n = np.unique(np.concatenate([b for _, b in _grams(data)] or [np.zeros(0, dtype=np.int64)]), return_counts=True)
        if len(ids):
            yield label, ids.astype(np.uint16), (n / n.sum()).astype(np.float32)


def _fitted(languages: int, epochs: int, expected: float):
    """Trains on a partition's (label, text) rows; gives the model's bucket logits and bias as blocks of rows, and its texts' number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        embed, soft, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, languages)), np.zeros(languages)
        steps, learned, pending, held = 0, 0, [], 0

        def learn() -> None:
            nonlocal steps, learned, bias, soft
            for _ in range(epochs):
                for i in rng.permutation(len(pending)):
                    rate = RATE * max(1 - steps / max(expected * epochs, 1), 0.02)
                    y, ids, share = pending[i]
                    x = share @ embed[ids]
                    p = _softmax((x @ soft + bias)[None])[0]
                    p[y] -= 1
                    step = soft @ p
                    soft -= rate * np.outer(x, p)
                    bias -= rate * 0.05 * p
                    embed[ids] -= rate * 4 * share[:, None] * step
                    steps += 1
            learned += len(pending)

        for whole in batches:
            for batch in C.slabs(whole, most=C.WIDE_SLAB_BYTES):
                for one in _counts(batch):
                    pending.append(one)
                    held += 6 * len(one[1]) + 300
                if held > PENDING_BYTES:
                    learn()
                    pending, held = [], 0
        learn()
        if learned:
            rows = np.vstack([embed @ soft, bias[None]])
            blocks = [rows[i:i + BLOCK].astype(np.float32).tobytes() for i in range(0, len(rows), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.full(len(blocks), learned)), pa.array(blocks, pa.binary())],
                                             names=["block", "n", "rows"])
    return run


def _mean(table: pa.Table) -> pa.Table:
    """The mean of a block's rows over all parts' models, weighted by their texts; in an order of its own."""
    parts = sorted(zip(table.column("n").to_pylist(), table.column("rows").to_pylist(), strict=True))
    total = sum(n for n, _ in parts)
    mean = sum(n / total * np.frombuffer(rows, dtype=np.float32).astype(np.float64) for n, rows in parts)
    return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([total]), "rows": pa.array([mean.tobytes()], pa.binary())})


def _logits(model: Model):
    """(label, held, logits) of a partition's (label, text, held) rows; texts without subwords have the bias alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slabs(whole):
                sums, many = _sums(*_separated(batch.column(1)), model.logits)
                raw = sums / np.maximum(many, 1)[:, None] + model.bias
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(raw), pa.list_(pa.float64()))], names=["y", "held", "raw"])
    return run


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(option, loss): a batch's summed loss at each temperature."""
    for batch in batches:
        if batch.num_rows:
            raw, y = np.array(batch.column(1).to_pylist()), np.asarray(batch.column(0))
            loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(len(y)), y], 1e-12)).sum() for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss), dtype=np.int32)), pa.array(loss)], names=["option", "loss"])


def _right_scores(temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, y = np.array(batch.column(1).to_pylist()), np.asarray(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(_softmax(raw / temperature).max(axis=1)[raw.argmax(axis=1) == y], pa.float64())], names=["score"])
    return run


class Model:
    """Languages, the logits of each bucket, bias, temperature and the rejection threshold."""

    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.languages, self.logits, self.bias, self.temperature, self.threshold = languages, logits, bias, temperature, threshold


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: DataFrame, key: str, text: str = "text", label: str = "lang", rows: int = PART_ROWS) -> Model:
    """Fit on all labelled texts, about ``rows`` of them to a part's model."""
    known = texts.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    names = sorted(r[0] for r in known.select(F.col(label).cast("string")).distinct().collect())
    if not names:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    y = F.array_position(F.array(*map(F.lit, names)), F.col(label).cast("string")) - 1
    draw = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(_DRAWS))
    labelled = known.select(y.cast("int").alias("y"), F.col(text).alias("text"), draw.alias("draw"), (draw % HELD == 0).alias("held"))
    total, back = labelled.agg(F.count(F.lit(1)), F.count(F.when(F.col("held"), 1))).first()
    apart = total >= 2 * HELD and 0 < back < total
    fit = labelled.where("not held") if apart else labelled
    n = total - back if apart else total
    parts = max(1, -(-n // rows))
    epochs = max(1, min(EPOCHS, -(-STEPS // n)))
    dealt = fit.repartition(parts, "draw", "text").sortWithinPartitions("draw", "text", "y").select("y", "text")
    shape = "block int, n long, rows binary"
    models = dealt.mapInArrow(_fitted(len(names), epochs, n / parts), shape).groupBy("block").applyInArrow(_mean, shape)
    blocks = {r["block"]: r["rows"] for r in models.toLocalIterator()}
    if not blocks:
        return Model(names, np.zeros((BUCKETS, len(names))), np.zeros(len(names)), 1.0, 0.0)
    table = np.frombuffer(b"".join(blocks[i] for i in range(len(blocks)))).reshape(BUCKETS + 1, len(names))
    model = Model(names, table[:-1].copy(), table[-1].copy(), 1.0, 0.0)
    if not apart:
        return model
    scored = C.written(labelled.select("y", "text", "held").mapInArrow(_logits(model), "y int, held boolean, raw array<double>"), "logits")
    loss = {r["option"]: r["loss"] for r in scored.where("held").select("y", "raw").mapInArrow(_losses, "option int, loss double").groupBy("option").agg(F.sum("loss").alias("loss")).collect()}
    model.temperature = float(TEMPERATURES[min(loss, key=lambda k: (loss[k], k))])
    right = scored.select("y", "raw").mapInArrow(_right_scores(model.temperature), "score double")
    low = right.agg(F.percentile_approx("score", F.lit(REJECT), F.lit(100000))).first()[0]
    model.threshold = float(min(1.0 / len(names) if low is None else low, 0.5 if len(names) > 1 else 0.0))
    return model


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (of the best language), rejected, and the columns ``carry`` as c0, c1, ..."""
    outs = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages or [UNKNOWN], dtype=object)
        for whole in batches:
            for batch in C.slabs(whole):
                sums, many = _sums(*_separated(batch.column(1)), model.logits)
                p = _softmax((sums / np.maximum(many, 1)[:, None] + model.bias) / model.temperature)
                known = np.asarray(batch.column(2)) & bool(model.languages)
                score = np.where(known, p.max(axis=1), 0.0)
                best = np.where(known, names[p.argmax(axis=1)], UNKNOWN)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score), pa.array(~known | (score < model.threshold)), *batch.columns[3:]],
                                                 names=["doc_id", "lang_pred", "score", "rejected", *outs])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), letters.alias("letters"), *(F.col(c).alias(o) for c, o in zip(carry, outs, strict=True)))
    shape = "doc_id long, lang_pred string, score double, rejected boolean" + "".join(f", {o} {docs.schema[c].dataType.simpleString()}" for c, o in zip(carry, outs, strict=True))
    return rows.mapInArrow(run, shape)


def accepted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose language isn't rejected, with their columns."""
    found = predict(docs, model, doc_id, text, tuple(docs.columns))
    return found.where("not rejected").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
