"""Readers for the driver-provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan with an explicit projection so only needed columns are read."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


# A joined side is broadcast only if its counted rows times ROW_BYTES are below this.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 64


def lookup(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: broadcast if its counted rows fit, else merged. Left to itself, the planner estimates
    it by its compressed files and sends millions of rows to the driver and every executor."""
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan across the cluster's cores when it has fewer input
    splits than cores (e.g. one small file with a single row group). At scale a
    scan has far more splits than cores and this adds no shuffle. Hashing on a
    key (not round-robin) keeps the shuffle deterministic without a local sort."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, *keys) if keys else df.repartition(target)
    return df
