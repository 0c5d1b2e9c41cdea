"""Mixing sources to target weights by entropy balancing.

Source targets come from a water level: with the sources by code point (null last), weights 5, 2, 1
repeating share 150% of all words; a target stops at 2 times its source's words and the
excess is shared again by weight. The level is found from sums over the sources.

Document rates minimise the relative entropy to rate 1, between 0 and 2, under one word constraint
a source. The dual is one convex function of a multiplier for each source; its stationary point
gives odds tilted exponentially in the size, rate = 2 / (1 + exp(-multiplier * size / mean size)).
Distributed Newton iterations solve it: each sums the words and their derivative over (source,
size) counts, and a bracket keeps each step safe. A source at twice its words has rate 2.

Rates become whole copies: the floor, and one more for a document whose hash is below the
fraction plus its source's offset. The offset is found by two passes of ``BINS`` bin sums over all
documents, so a source's taken words miss its target by one narrow bin's documents at most, and
reruns agree.

A hot source is never one task: documents are only summed (combined before a shuffle) by source, or joined with
the source's row (one a source; broadcast only if their counted size fits).

Defined results: a null text has size 0; size 0 documents are copied by their rate; a null source is a
source of its own; repeated rows of one doc_id are decided alike, and so are ties of a hash; very long texts are whole; an empty table gives an
empty result; other columns, whatever their names, are kept by ``repeated`` and not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm import common as C

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# Newton or bisecting steps after which a source that is not close is an error.
STEPS = 80
# A source's words differ from its target by this share at most when the steps end.
CLOSE = 1e-6
BINS = 1024
SEED = 20240607


def word_count(text: str):
    """Number of words, null: 0."""
    trimmed = F.trim(F.col(text), F.lit(C.SPACE_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.size(F.split(trimmed, C.SPACE))).otherwise(0).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of rows (source, size)."""
    sources = C.written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # Ranks by range partitions: a source's place in its partition, and the sources of the partitions before.
    name = F.col("source").asc_nulls_last()
    placed = C.written(sources.repartitionByRange(name).sortWithinPartitions(name).withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    before, seen = {}, 0
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        before[row["part"]], seen = seen, seen + row["count"]
    offsets = placed.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, offset long")
    rank = F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    sources = C.written(ranked.select("source", "source_size", F.get(weights, F.pmod(rank, F.lit(len(WEIGHTS))).cast("int")).alias("weight")), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) >= MOST * F.col("source_size")
        row = sources.agg(F.sum(F.when(capped, 1).otherwise(0)).alias("n"), F.sum(F.when(capped, MOST * F.col("source_size")).otherwise(0)).alias("held"),
                          F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if row.n is None or row.n == full or not row.open:
            break
        full, level = row.n, (SHARE * total - row.held) / row.open
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.lit(float(MOST)) * F.col("source_size")))


def _rate(multiplier, size):
    """2 / (1 + exp(-multiplier * size)), without overflow."""
    return F.lit(float(MOST)) / (1 + F.exp(F.least(-multiplier * size, F.lit(700.0))))


def document_rates(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, scale, multiplier, full) for rows (source, size): the dual's solution."""
    targets = source_targets(sizes)
    counted = C.written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    mean = counted.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    state = targets.join(mean, targets.source.eqNullSafe(mean.source)).select(
        targets.source, "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("multiplier"),
        F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"),
        (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)).alias("full"))
    state = C.written(state, "dual")
    counted = counted.withColumnRenamed("source", "s")
    few = state.count() * 96 <= C.BROADCAST_BYTES
    for _ in range(STEPS):
        told = counted.join(F.broadcast(state) if few else state, F.col("s").eqNullSafe(F.col("source")))
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("multiplier"), x)
        words = F.col("n") * F.col("size")
        sums = told.groupBy("s").agg(F.sum(words * rate).alias("have"), F.sum(words * rate * (1 - rate / MOST) * x).alias("slope"))
        move = (F.col("target") - F.col("have")) / F.greatest("slope", F.lit(1e-300))
        low = F.when(F.col("have") < F.col("target"), F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(F.col("have") > F.col("target"), F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") + move
        next_ = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = F.col("full") | (F.abs(F.col("have") - F.col("target")) <= CLOSE * F.greatest(F.col("target"), F.lit(1.0)))
        state = C.written(state.join(sums, F.col("s").eqNullSafe(F.col("source"))).select(
            "source", "source_size", "target", "scale", F.when(done, F.col("multiplier")).otherwise(next_).alias("multiplier"),
            F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.col("high")).otherwise(high).alias("high"), "full", done.alias("done")), "dual")
        if not state.where("not done").limit(1).count():
            break
        state = state.drop("done")
    else:
        raise ArithmeticError("the sources' multipliers did not settle")
    return state.select("source", "source_size", "target", "scale", "multiplier", "full")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), rate, copies, taken (copies * size)."""
    sizes = C.written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")), "docs")
    rates = document_rates(sizes.select("source", "size"))
    joined = C.with_small(sizes.withColumnRenamed("source", "s"), rates, F.col("s").eqNullSafe(F.col("source")), "inner", 96).withColumn(
        "rate", F.when(F.col("full"), F.lit(float(MOST))).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("scale"))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = C.written(joined.select("doc_id", "source", "size", "source_size", "target", "rate", "full", F.floor("rate").cast("int").alias("least"), draw.alias("draw"))
                      .withColumn("gap", F.col("draw") - (F.col("rate") - F.col("least"))), "rates")
    # Documents with a gap below the offset get one copy more: find the bin in which a source's words reach its target, then a bin in it.
    open_ = rated.where("not full and size > 0")
    base = rated.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("least") * F.col("size")).alias("have"))
    low = C.written(base.select("source", "target", F.col("have").cast("double").alias("have"), F.lit(-1.0).alias("low")), "offsets")
    width = 2.0
    for _ in range(2):
        width /= BINS
        lows = low.select(F.col("source").alias("s"), "low")
        place = C.with_small(open_, lows, F.col("s").eqNullSafe(F.col("source")), "inner", 48).withColumn("bin", F.floor((F.col("gap") - F.col("low")) / width)).where(f"bin >= 0 and bin < {BINS}")
        bins = C.written(place.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
        run = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        met = run.withColumnRenamed("source", "s").join(low.select("source", "target", "have"), F.col("s").eqNullSafe(F.col("source"))).where("have + upto <= target")
        top = met.groupBy("s").agg(F.max("bin").alias("bin"), F.max("upto").alias("upto"))
        low = C.written(low.join(top, F.col("s").eqNullSafe(F.col("source")), "left").select(
            "source", "target", (F.col("have") + F.coalesce("upto", F.lit(0))).alias("have"),
            (F.col("low") + width * (F.coalesce("bin", F.lit(-1)) + 1)).alias("low")), "offsets")
    offset = low.select(F.col("source").alias("s"), F.col("low").alias("offset"))
    out = C.with_small(rated, offset, F.col("s").eqNullSafe(F.col("source")), "left", 48)
    copies = F.when(F.col("full"), MOST).otherwise(F.least(F.col("least") + F.when(F.col("gap") < F.col("offset"), 1).otherwise(0), F.lit(MOST)))
    return out.select("doc_id", "source", F.col("size").cast("long"), F.col("source_size").cast("long"), F.col("target").cast("double"), "rate", copies.cast("int").alias("copies"),
                      (copies * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents, each as often as its copies say, with all their columns, whatever their names."""
    columns = docs.columns
    inside = [f"c{i}" for i in range(len(columns))]
    copies = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    out = docs.toDF(*inside).join(copies, F.col(inside[columns.index(doc_id)]).eqNullSafe(F.col("_id"))).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*inside).toDF(*columns)
