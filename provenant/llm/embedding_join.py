"""Embedding near-duplicates: an exact metric range join over pivot cells.

Unit vectors with cosine >= c lie within e = sqrt(2 - 2c) of each other. Pivots are a bounded
sample of the distinct vectors (one for ``CELL`` vectors of a label, ``PIVOTS`` a label and ``ALL_PIVOTS`` in all
at most: where vectors lie too far apart for the bounds to prune, each cell holds most vectors of its label, and more
cells would only be more copies); a vector's home
is its nearest pivot of its label. By the triangle inequality a vector within e of x whose home
is h has d(x, h) <= d(x, home of x) + 2e, and d(x, h) <= r(h) + e where r(h) is the farthest
home distance of cell h: x is copied to the cells that satisfy both. All links of a home vector
are then in its own cell, so cells join independently and nothing is found twice. A cell is cut into rings of equal depth
by the distance from its pivot (one for ``BLOCK`` vectors, ``RINGS`` at most); by the triangle inequality two rings more than e apart
hold no link and are never brought together. A ring is compared in blocks of about ``BLOCK`` vectors, so a crowded cell or ring (of many
vectors at one distance, say) is many tasks, and a comparison returns one row a vector, never its pairs.

Equal vectors of one label are one point with a count, so copies never meet each other.

Defined results: a null label, and a vector that is null, empty, zero or holds null or non-finite
components, links with nothing; vectors of different lengths don't link; repeated rows each come
back (rows of one vec_id count as separate vectors); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm import common as C

COSINE = 0.93
# Bounds of the pivots, which every task holds.
PIVOTS = 48
ALL_PIVOTS = 4096
CELL = 2048
BLOCK = 1024
RINGS = 64


def _units(column: pa.Array) -> np.ndarray:
    """Rows of equal dimension as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    top = np.abs(flat).max(axis=1, keepdims=True)
    flat = flat / top
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))


def _by_kind(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    kinds = np.stack((batch.column("label").to_numpy(), batch.column("dim").to_numpy()), axis=1)
    for kind in np.unique(kinds, axis=0):
        yield (int(kind[0]), int(kind[1])), np.flatnonzero((kinds == kind).all(axis=1))


def _home(pivots: dict[tuple[int, int], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for kind, rows in _by_kind(batch):
                if kind in pivots:
                    d = _distances(_units(batch.column("unit").take(pa.array(rows))), pivots[kind])
                    home[rows] = d.argmin(axis=1)
                    far[rows] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(far)], names=[*batch.schema.names, "home", "far"])

    return run


def _copies(pivots: dict[tuple[int, int], np.ndarray], radius: dict[tuple[int, int, int], float], reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, far = batch.column("home").to_numpy(), batch.column("far").to_numpy()
            rows_out, cells_out, far_out = [], [], []
            for kind, rows in _by_kind(batch):
                if kind not in pivots:
                    rows_out.append(rows)
                    cells_out.append(np.zeros(len(rows), dtype=np.int64))
                    far_out.append(np.zeros(len(rows)))
                    continue
                d = _distances(_units(batch.column("unit").take(pa.array(rows))), pivots[kind])
                r = np.array([radius.get((*kind, p), -np.inf) for p in range(len(pivots[kind]))])
                to = (d <= far[rows, None] + 2 * reach) & (d <= r + reach)
                to[np.arange(len(rows)), home[rows]] = True
                row, cell = np.nonzero(to)
                rows_out.append(rows[row])
                cells_out.append(cell)
                far_out.append(d[row, cell])
            if rows_out:
                rows, cells = np.concatenate(rows_out), np.concatenate(cells_out)
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("label", "dim", "point", "cnt", "unit")), pa.array(cells.astype(np.int32)), pa.array(home[rows] == cells), pa.array(np.concatenate(far_out))],
                                                 names=["label", "dim", "point", "cnt", "unit", "cell", "own", "d"])

    return run


CELL_KEYS = ["label", "dim", "cell"]
KEYS = [*CELL_KEYS, "i", "j"]


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.sorted_groups(batches, KEYS):
            side = group.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            unit, point, cnt = _units(group.column("unit")), group.column("point").to_numpy(), group.column("cnt").to_numpy()
            near = unit[left] @ unit[right].T >= cosine
            near &= point[left][:, None] != point[right][None, :]
            links = near @ cnt[right].astype(np.float64)
            keep = links > 0
            if keep.any():
                a, b = np.nonzero(near)
                names, where = np.unique(np.concatenate((point[left], point[right])), return_inverse=True)
                root = names[C.local_components(len(names), where[:len(left)][a], where[len(left):][b])]
                touched = np.unique(np.concatenate((where[:len(left)][a], where[len(left):][b])))
                many = np.zeros(len(names), dtype=np.int64)
                np.add.at(many, where[:len(left)][keep], links[keep].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names[touched]), pa.array(many[touched]), pa.array(root[touched])], names=["point", "links", "root"])

    return run


def with_rings(cells: DataFrame) -> DataFrame:
    """Adds ``ring``: runs of equal depth of the distance ``d``, as many as the cell has blocks, RINGS at most."""
    size = cells.groupBy(*CELL_KEYS).agg(
        F.percentile_approx("d", [k / RINGS for k in range(1, RINGS)], 10_000).alias("_bounds"), F.count("*").alias("_n"))
    rings = F.least(F.ceil(F.col("_n") / BLOCK), F.lit(RINGS))
    placed = C.with_small(cells, size.select(*CELL_KEYS, "_bounds", rings.alias("_rings")), CELL_KEYS, "inner", 8 * RINGS + 64)
    rank = F.when(F.col("_rings") > 1, F.expr("size(filter(_bounds, b -> b < d))")).otherwise(0)
    return placed.withColumn("ring", F.floor(rank * F.col("_rings") / RINGS).cast("long")).drop("_bounds", "_rings")


def ring_pairs(cells: DataFrame, reach: float) -> DataFrame:
    """(cell, i, j, homes, alls, i_blocks, j_blocks): the pairs of rings of a cell that may hold links, from i's home vectors to all of
    j's; at most RINGS * RINGS a cell. ``cells`` has rings."""
    own = F.when(F.col("own"), F.col("d"))
    rings = C.written(cells.groupBy(*CELL_KEYS, "ring").agg(
        F.count(own).alias("homes"), F.min(own).alias("low"), F.max(own).alias("high"),
        F.count("*").alias("alls"), F.min("d").alias("all_low"), F.max("d").alias("all_high")), "rings")
    left = rings.where("homes > 0").select(*CELL_KEYS, F.col("ring").alias("i"), "homes", "low", "high", F.ceil(F.col("homes") / BLOCK).alias("i_blocks"))
    right = rings.select(*CELL_KEYS, F.col("ring").alias("j"), "alls", "all_low", "all_high", F.ceil(F.col("alls") / BLOCK).alias("j_blocks"))
    return left.join(right, CELL_KEYS).where((F.col("all_low") - F.col("high") <= reach) & (F.col("low") - F.col("all_high") <= reach))


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of its label at the cosine or above),
    component_id (smallest vec_id reachable, itself included), kept (vec_id = component_id)."""
    spark = vectors.sparkSession
    # Float components travel as they are; every distance and cosine is taken in double precision.
    kept = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    vectors = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kept).alias("v"), F.col(label).cast("long").alias("label"))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value; the vector's hash names the point and the vector itself decides.
    same = F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))
    known = vectors.withColumn("sound", sound).withColumn("v", F.when(F.col("sound"), same))
    tagged = C.written(known.select("vec_id", "label", "sound", "v", F.when(F.col("sound"), F.xxhash64("label", "v")).alias("point")), "vectors")
    points = C.written(tagged.where("sound").groupBy("point", "label", F.col("v").alias("unit")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt"))
                       .withColumn("dim", F.size("unit")), "points")
    kinds = points.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1").orderBy("label", "dim").limit(ALL_PIVOTS)
    most = max(1, min(PIVOTS, ALL_PIVOTS // max(1, kinds.count())))
    share = points.join(F.broadcast(kinds), ["label", "dim"]).where(F.pmod(F.xxhash64("point", F.lit(3)), F.ceil(F.col("n") / (2 * most))) == 0)
    ranked = share.withColumn("p", F.expr("row_number() over (partition by label, dim order by xxhash64(point, 3), point)")).where((F.col("p") <= most) & (F.col("p") <= F.ceil(F.col("n") / CELL)))
    pivots: dict[tuple[int, int], list] = {}
    for row in ranked.select("label", "dim", "unit").limit(ALL_PIVOTS).toArrow().to_pylist():
        pivots.setdefault((row["label"], row["dim"]), []).append(row["unit"])
    chosen = {k: _units(pa.array(v)) for k, v in pivots.items()}
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    kind = "label long, dim int, point long, cnt long, unit " + kept
    homes = C.written(points.select("label", "dim", "point", "cnt", "unit").mapInArrow(_home(chosen), kind + ", home int, far double"), "homes")
    # Only labels with pivots have cells to reach: one row a pivot at most.
    with_pivots = spark.createDataFrame(list(chosen), "label long, dim int")
    radii = homes.join(F.broadcast(with_pivots), ["label", "dim"]).groupBy("label", "dim", "home").agg(F.max("far").alias("far"))
    radius = {(r.label, r.dim, r.home): r.far for r in radii.collect()}
    cells = C.written(homes.mapInArrow(_copies(chosen, radius, reach), kind + ", cell int, own boolean, d double"), "cells")
    cells = C.written(with_rings(cells), "rings-of-cells")
    pairs = C.written(ring_pairs(cells, reach), "ring-pairs")

    def block(ring, of):
        return F.expr(f"shiftleft({ring}, 32) + pmod(xxhash64(point, 5), {of})")

    def every(ring, of):
        return F.explode(F.expr(f"transform(sequence(0L, {of} - 1), k -> shiftleft({ring}, 32) + k)"))

    def side(which, rows, own_ring, own_blocks, other_ring, other_blocks):
        met = C.with_small(rows.withColumnRenamed("ring", own_ring), pairs.select(*CELL_KEYS, "i", "j", "i_blocks", "j_blocks"), [*CELL_KEYS, own_ring], "inner", 64)
        return met.select(*CELL_KEYS, "point", "cnt", "unit", F.lit(which).alias("side"), block(own_ring, own_blocks).alias(f"_{own_ring}"),
                          every(other_ring, other_blocks).alias(f"_{other_ring}")).withColumnsRenamed({"_i": "i", "_j": "j"})

    left = side(0, cells.where("own").drop("own", "d"), "i", "i_blocks", "j", "j_blocks")
    right = side(1, cells.drop("own", "d"), "j", "j_blocks", "i", "i_blocks")
    names = [*KEYS, "side", "point", "cnt", "unit"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = C.written(left.select(names).unionByName(right.select(names)).repartition(tasks, *KEYS).sortWithinPartitions(*KEYS)
                      .mapInArrow(_compare(cosine), "point long, links long, root long"), "links")
    groups = C.components(found.select(F.col("point").alias("a"), F.col("root").alias("b")))
    reps = points.select("point", "rep", "cnt")
    named = C.written(groups.withColumnRenamed("node", "point").join(reps, "point").select("point", "root", "rep"), "named")
    first = named.groupBy("root").agg(F.min("rep").alias("first"))
    out = C.written(reps.join(found.groupBy("point").agg(F.sum("links").alias("links")), "point", "left")
                    .join(named.select("point", "root").join(first, "root").select("point", "first"), "point", "left"), "out")
    have = tagged.where("sound").select("vec_id", "point").join(out, "point").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    none = tagged.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return have.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
