"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; texts with equal sets are one class. Each class
carries ``COORDS`` min-hash coordinates. A run is a tree: a node sends each of its
sets to one child for each of ``BRANCH`` coordinates that the node's path chooses, named by
the set's value there, so two sets of similarity J stay together in a child with probability
J. Nodes of at most ``SMALL`` sets are leaves and compared by brute force; larger nodes are
split again; a node whose sets already agree (a group of near copies) or that is still
large after ``DEPTH`` levels is compared whole, in blocks, so no node is ever cut short.
All trees choose among the same coordinates, so their losses are not independent: a pair that
agrees in k of them is lost by one tree with probability q = (1 - k / COORDS (1 - q)) ** BRANCH
over ``DEPTH`` levels, and trees are taken until the mean of q ** trees over k ~ Bin(COORDS, J)
is at most 1 - ``RECALL`` at the threshold itself.

Leaves with the same members are compared once, a pair counts in the smallest leaf both
share, and links are verified on the full shingle sets. A comparison returns one row a set
(how many texts it links and a local root), never the pairs, so the rows stay linear in the
leaves' members. Components come from the roots.

Defined results: a null or empty text, one without words or one without a doc_id links with
nothing and is its own class; repeated rows each come back; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm import common as C

SIMILARITY = 0.8
SHINGLE = 5
COORDS = 64
BRANCH = 2
SMALL = 512
DEPTH = 9
# A node whose sets agree in this share of its coordinates' pairs is a group of near copies.
DENSE = 0.5
RECALL = 0.9999
# Pairs whose min-hash agreement is this many standard errors below the threshold aren't verified.
SIGMAS = 5.5


def _least() -> float:
    """The agreeing coordinates below which a pair isn't verified."""
    return COORDS * SIMILARITY - SIGMAS * math.sqrt(COORDS * SIMILARITY * (1 - SIMILARITY))


def loss(similarity: float, runs: int) -> float:
    """Probability that a pair shares no leaf of ``runs`` trees over the same coordinates, or isn't verified."""
    total = 0.0
    for k in range(COORDS + 1):
        q = 0.0
        for _ in range(DEPTH):
            q = (1 - k / COORDS * (1 - q)) ** BRANCH
        total += math.comb(COORDS, k) * similarity ** k * (1 - similarity) ** (COORDS - k) * (1.0 if k < _least() else q ** runs)
    return total


def runs_for(similarity: float, recall: float = RECALL) -> int:
    """Trees needed for the recall of pairs at the threshold."""
    for runs in range(1, COORDS + 1):
        if loss(similarity, runs) <= 1 - recall:
            return runs
    raise ValueError(f"{COORDS} coordinates can't give recall {recall}")


def _seeds(n: int) -> np.ndarray:
    return C.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(batch: pa.RecordBatch):
    data, offsets = C.text_bytes(batch.column(1))
    starts, ends, bounds = C.word_bounds(data, offsets)
    return C.distinct_in(*C.shingles(C.span_hashes(data, starts, ends), bounds, SHINGLE))


def _keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set: sums of two hashes of its members."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix(values ^ np.uint64(salt)))))
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
    return out[0], out[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = _seeds(COORDS)
    for whole in batches:
        for batch in C.slabs(whole):
            values, bounds = _sets(batch)
            n = np.diff(bounds)
            n[np.asarray(batch.column(0).is_null())] = 0
            k1, k2 = _keys(values, bounds)
            signs = np.zeros((len(n), COORDS), dtype=np.uint32)
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                for j, seed in enumerate(seeds):
                    signs[full, j] = (np.minimum.reduceat(values * seed, bounds[:-1][full]) >> np.uint64(20)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(k1), pa.array(k2), pa.array([x.tobytes() for x in signs], pa.binary())],
                names=["doc_id", "n", "k1", "k2", "sig"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in C.slabs(whole):
            values, bounds = _sets(batch)
            yield pa.RecordBatch.from_arrays([pa.array(_keys(values, bounds)[0]), C.binaries(values, bounds)], names=["set_id", "tokens"])


def _leaf_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    return column.flatten().to_numpy(zero_copy_only=False), bounds


def _shared(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Counts of common values of every two of n lists: products of 0/1 slices of the values in two or more."""
    out = np.zeros((n, n), dtype=np.float64)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    column, owner = column[keep], owner[keep]
    if not len(column):
        return out
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(256, (1 << 21) // n)
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((n, int(column[b - 1]) - low + 1), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _open_pairs(group: pa.Table) -> np.ndarray:
    """Upper pairs of a comparison that no smaller shared leaf compares, across its two blocks if it has two."""
    n = group.num_rows
    here = group.column("leaf")[0].as_py()
    values, bounds = _leaf_lists(group.column("leaves"))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    less = values < here
    may = np.triu(_shared(values[less], owner[less], n) == 0, 1)
    if group.column("i")[0].as_py() != group.column("j")[0].as_py():
        side = group.column("block").to_numpy()
        may &= side[:, None] != side[None, :]
    size = group.column("n").to_numpy().astype(np.float64)
    return may & (np.minimum(size[:, None], size) >= SIMILARITY * np.maximum(size[:, None], size))


KEYS = ["leaf", "i", "j"]


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each comparison that may have a link in it, by their min-hashes."""
    least = _least()
    names = [*KEYS, "block", "set_id", "n", "cnt", "leaves"]
    for group in C.sorted_groups(batches, KEYS):
        may = _open_pairs(group)
        if not may.any():
            continue
        signs = C.rows_of(group.column("sig"), COORDS, np.uint32)
        same = np.zeros(may.shape, dtype=np.uint8)
        for j in range(COORDS):
            same += signs[:, j, None] == signs[None, :, j]
        may &= same >= least
        keep = may.any(0) | may.any(1)
        if keep.any():
            yield from group.select(names).filter(pa.array(keep)).combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each comparison, exactly: for each set the texts it links and its root here."""
    for group in C.sorted_groups(batches, KEYS):
        sets = group.column("set_id").to_numpy()
        _, first = np.unique(sets, return_index=True)
        group = group.take(pa.array(np.sort(first))).combine_chunks()
        sets = group.column("set_id").to_numpy()
        n, size, cnt = len(sets), group.column("n").to_numpy().astype(np.float64), group.column("cnt").to_numpy()
        if n < 2:
            continue
        tokens = [np.frombuffer(x, dtype=np.uint64) for x in group.column("tokens").to_pylist()]
        both = _shared(np.concatenate(tokens), np.repeat(np.arange(n), [len(x) for x in tokens]), n)
        links = _open_pairs(group) & (both >= SIMILARITY * (size[:, None] + size - both) - 1e-9)
        if not links.any():
            continue
        a, b = np.nonzero(links)
        many = np.bincount(a, cnt[b], n) + np.bincount(b, cnt[a], n)
        order = np.argsort(sets)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        root = sets[order][C.local_components(n, rank[a], rank[b])][rank]
        keep = many > 0
        yield pa.RecordBatch.from_arrays([pa.array(sets[keep]), pa.array(many[keep].astype(np.int64)), pa.array(root[keep])], names=["set_id", "links", "root"])


def _chosen(path: str, branch: int) -> str:
    """The child of ``path`` that a set goes to in one branch: the value of the coordinate that the path chooses."""
    at = f"cast(pmod(xxhash64({path}, {branch}), {COORDS}) as int)"
    return f"xxhash64({path}, {branch}, substring(sig, 4 * {at} + 1, 4))"


def _children(nodes: DataFrame) -> DataFrame:
    """(path, parent, branch, set_id) of the next level, of rows (path, set_id, sig)."""
    step = F.explode(F.array(*(F.struct(F.lit(b).alias("branch"), F.expr(_chosen("path", b)).alias("child")) for b in range(BRANCH))))
    return nodes.select("path", "set_id", step.alias("c")).select(
        F.col("c.child").alias("path"), F.col("path").alias("parent"), F.col("c.branch").alias("branch"), "set_id")


def _leaves(sets: DataFrame, runs: int) -> DataFrame:
    """(path, set_id, cnt) of all nodes to compare: recursion on the nodes that are still large."""
    roots = F.explode(F.array(*(F.xxhash64(F.lit("run"), F.lit(r)) for r in range(runs))))
    members = C.written(_children(sets.select(roots.alias("path"), "set_id", "sig")), "paths")
    done = []
    for level in range(1, DEPTH + 1):
        sizes = C.written(members.groupBy("path", "parent", "branch").agg(F.count("*").alias("size"), F.sum(F.xxhash64("set_id", F.lit(1)).cast("decimal(20,0)")).alias("mark"))
                          .where("size > 1"), "sizes")
        # A parent whose children still hold most pairs of it is a group of near copies: it is compared itself.
        if level > 1:
            agree = sizes.groupBy("parent").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("pairs"))
            alike = large.join(agree, large.path == agree.parent).where(f"pairs >= {DENSE} * {BRANCH} * size * size").select("path", "size", "mark")
            done.append((large_rows.join(alike.select("path", "size", "mark"), "path", "left_semi"), alike))
            sizes = sizes.join(alike.select(F.col("path").alias("parent")), "parent", "left_anti")
        stop = sizes if level == DEPTH else sizes.where(F.col("size") <= SMALL)
        done.append((members, stop.select("path", "size", "mark")))
        if level == DEPTH:
            break
        large = sizes.where(F.col("size") > SMALL).select("path", "size", "mark")
        if not large.limit(1).count():
            break
        large = C.written(large, "large")
        large_rows = C.written(members.join(large, "path").join(sets.select("set_id", "sig"), "set_id").select("path", "set_id", "sig"), "rows")
        members = C.written(_children(large_rows), "paths")
    names = done[0][1]
    for _, more in done[1:]:
        names = names.unionByName(more)
    # Nodes with the same members (equal sums of two hashes and counts) are compared once.
    names = C.written(names.groupBy("mark", "size").agg(F.min("path").alias("path")), "leaves")
    out = None
    for rows, _ in done:
        part = rows.select("path", "set_id").join(names.select("path", "size"), "path")
        out = part if out is None else out.unionByName(part)
    return C.written(out.distinct(), "members")


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int | None = None) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id reachable by links or equal sets),
    n_same (other documents of its shingle set), n_links (other documents at the similarity or above), kept."""
    runs = runs or runs_for(SIMILARITY)
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = C.written(docs.mapInArrow(_sign, "doc_id long, n int, k1 long, k2 long, sig binary"), "signed")
    classes = C.written(signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("cnt"), F.min("sig").alias("sig"))
                        .withColumnRenamed("k1", "set_id"), "classes")
    members = _leaves(classes, runs)
    lists = members.groupBy("set_id").agg(F.array_sort(F.collect_set("path")).alias("leaves"))
    blocks = F.ceil(F.col("size") / SMALL).cast("int")
    mine = F.expr("cast(pmod(xxhash64(set_id, 7), blocks) as int)")
    rows = (members.withColumn("blocks", blocks).withColumn("block", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.col("path").alias("leaf"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    full = rows.join(lists.join(classes.select("set_id", "n", "cnt", "sig"), "set_id"), "set_id")
    kinds = "leaf long, i int, j int, block int, set_id long, n int, cnt long, leaves array<long>"
    maybe = C.written(full.select(*KEYS, "block", "set_id", "n", "cnt", "leaves", "sig").repartition(tasks, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_screen, kinds), "maybe")
    wanted = classes.join(maybe.select("set_id").distinct(), "set_id", "left_semi").select(F.col("rep").alias("doc_id"))
    tokens = C.with_small(docs, wanted, "doc_id", "left_semi", 16).mapInArrow(_tokens, "set_id long, tokens binary")
    found = C.written(maybe.join(tokens, "set_id").repartition(tasks, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_verify, "set_id long, links long, root long"), "links")
    linked = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    groups = C.components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    named = groups.withColumnRenamed("node", "set_id").join(classes.select("set_id", "rep"), "set_id")
    named = C.written(named, "named")
    first = named.groupBy("root").agg(F.min("rep").alias("first"))
    out = (classes.select("set_id", "k2", "n", "rep", "cnt").join(linked, "set_id", "left")
           .join(named.select("set_id", "root").join(first, "root"), "set_id", "left")
           .select("set_id", "k2", "n", F.coalesce("first", "rep").alias("first"), F.col("cnt"), F.coalesce("links", F.lit(0)).alias("links")))
    out = C.written(out, "classes")
    s = signed.where("n > 0").select("doc_id", "n", "k1", "k2")
    have = s.join(out, (s.k1 == out.set_id) & (s.k2 == out.k2) & (s.n == out.n)).select(
        s.doc_id, F.col("first").alias("class_id"), (F.col("cnt") - 1).alias("n_same"), (F.col("cnt") - 1 + F.col("links")).alias("n_links"))
    none = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_same"), F.lit(0).cast("long").alias("n_links"))
    return have.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
