"""Shared helpers: written scratch tables, words of Arrow text columns as numpy
arrays, 64-bit word and shingle hashes, sorted groups, and components of links.

A word is ``[^\\x20\\x09-\\x0D]+``. Words are found on the UTF-8 bytes of an Arrow
column without making Python strings, so one core reads tens of MB a second
and memory is bounded by the slab size, not by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.session import scratch_path, ship_package

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

# Bytes of text that one numpy pass holds at most (a longer word or text gets a pass of its own): a pass over bytes makes some ten numbers of
# 8 bytes for each. Passes that keep few numbers a byte take wide slabs.
SLAB_BYTES = 1 << 19
WIDE_SLAB_BYTES = 2 << 20
# A side is broadcast only if its rows times its row width are below this.
BROADCAST_BYTES = 8 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_tables: dict[str, np.ndarray] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared scratch folder and read it back."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_small(df: DataFrame, small: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join with ``small``: by broadcast if its counted rows fit BROADCAST_BYTES, else by shuffle."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return df.join(small, on, how)


def frame(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*columns)


def fold(remainder_of: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(remainder_of).cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    offsets = offsets.astype(np.int64) if len(offsets) else np.zeros(1, dtype=np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slabs(batch: pa.RecordBatch, column: str = "text", most: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``most`` bytes of text each (one row may be longer)."""
    if not batch.num_rows:
        return
    at = text_bytes(batch.column(batch.schema.get_field_index(column)))[1]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 bounds of each text's words among them."""
    inside = ~_IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    at = cuts[cuts < len(data)]
    first[at] = inside[at]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, SLAB_BYTES) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte (or code point) span; spans are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLAB_BYTES, side="right")))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + _U(1)) * up[:high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    return mix(out)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles, and the n + 1 bounds of each text's shingles.

    A text of 1 to size - 1 words has one shingle, all its words; a text without words has none.
    """
    counts = np.diff(bounds)
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(many)))
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], many)
    at = np.repeat(bounds[:-1], many) + within
    left = np.repeat(np.minimum(counts, size), many)
    padded = np.concatenate((words, np.zeros(size, dtype=np.uint64)))
    out = left.astype(np.uint64)
    for k in range(size):
        out = out * _U(0xD6E8FEB86659FD93) + np.where(left > k, padded[at + k], _U(0))
    return mix(out), ends


def distinct_in(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each segment, and their bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(bounds)))


def rows_of(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=dtype).reshape(len(column), width)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Segments of an array as a binary column."""
    size = values.dtype.itemsize
    return pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) if size else None


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal (integer) keys in batches that are sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        n = table.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        for key in keys:
            column = table.column(key).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        table = table.combine_chunks()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each of ``n`` nodes over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new[label]]
        if np.array_equal(new, label):
            break
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes on ``edges`` (a, b): root is the smallest node reachable.

    Minimum labels travel over the links and then jump to their own label's label, so the
    rounds grow with the logarithm of a chain's length. Every join is between two written
    tables on a key, so a hub's rows can be split; minima are combined before they are
    shuffled. Only one changed-row count reaches the driver each round.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a != b").distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        told = both.join(label, both.a == label.node).select(F.col("b").alias("node"), "root")
        low = written(told.unionByName(label).groupBy("node").agg(F.min("root").alias("root")), "labels")
        up = low.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = written(low.join(up, "root").select("node", F.col("top").alias("root")), "labels")
        changed = new.join(label.withColumnRenamed("root", "old"), "node").where("root != old").limit(1).count()
        label = new
        if not changed:
            return label
