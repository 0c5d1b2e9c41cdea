"""Table maintenance: last-write-wins upserts, first-write-wins inserts,
append-only ledgers and immutable run snapshots.

Plain Parquet has no row-level MERGE, so an upsert rewrites the target from
``old ∪ new`` keeping one row per key. ``row_number() = 1`` is planned with a
partial WindowGroupLimit before the shuffle, so each map task forwards at most
one row per key and a key holding a third of all rows is reduced map-side.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _order(cols: list, descending: bool) -> list[Column]:
    out = []
    for c in cols:
        col = F.col(c) if isinstance(c, str) else c
        out.append(col.desc_nulls_last() if descending else col.asc_nulls_last())
    return out


def latest_per_key(df: DataFrame, keys: list[str], order: list, descending: bool = True) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_order(order, descending))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def upsert_latest(new: DataFrame, keys: list[str], order: list, existing: DataFrame | None = None,
                  run_seq_col: str = "run_seq") -> DataFrame:
    """``insert or replace`` by key: later run wins, then later source row.

    ``new`` and ``existing`` must carry ``run_seq_col`` (monotone per run) plus
    the ``order`` columns; ``existing`` rows are older than any ``new`` row.
    """
    both = new if existing is None else existing.unionByName(new)
    return latest_per_key(both, keys, [run_seq_col, *order], descending=True)


def insert_if_absent(new: DataFrame, keys: list[str], order: list,
                     existing: DataFrame | None = None) -> DataFrame:
    """``insert or ignore`` by key: the first new row per key, and only for keys
    not already present. Returns the rows to append."""
    first = latest_per_key(new, keys, order, descending=False)
    if existing is None:
        return first
    return first.join(existing.select(*keys), keys, "left_anti")


def write_snapshot(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Immutable per-run landing: fails if the run path already exists."""
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def append_ledger(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    writer = df.write.mode("append").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


# Spark's setting that removes a query's shuffle files at its end.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: the written table stands for them."""
    before = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared scratch folder and read it back. Its shuffle files are removed."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
