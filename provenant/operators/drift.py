"""What changed between two runs' sources, from ledgers that every run appends.

A run leaves two small tables: how many records of each feed carry each top-level key, and an additive digest of each
feed's records in ``BUCKETS`` buckets of the record id. Two runs are compared by joining their rows, whatever the
size of the feeds, and a changed bucket says where to look. Both aggregates combine map-side.

Records: record_type, record_id, raw_json. A null id falls into the empty id's bucket; a record whose text is no JSON object
has no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256  # the first two hexadecimal digits of the id's hash


def source_keys(records: DataFrame, run_id: str) -> DataFrame:
    """(run_id, record_type, key, records). Key sets are counted before they are taken apart: few differ."""
    sets = records.select("record_type", F.json_object_keys("raw_json").alias("_keys")).groupBy("record_type", "_keys") \
        .agg(F.count(F.lit(1)).alias("_n"))
    return sets.select("record_type", F.explode(F.array_distinct("_keys")).alias("key"), "_n").groupBy("record_type", "key") \
        .agg(F.sum("_n").alias("records")).select(F.lit(run_id).alias("run_id"), "record_type", "key", "records")


def source_buckets(records: DataFrame, run_id: str, row_hash: Column | None = None) -> DataFrame:
    """(run_id, record_type, bucket, records, digest); the digest does not depend on order or partitions."""
    row_hash = F.sha2("raw_json", 256) if row_hash is None else row_hash
    bucket = F.substring(F.sha2(F.coalesce(F.col("record_id"), F.lit("")), 256), 1, 2)
    hashed = records.select("record_type", bucket.alias("bucket"), row_hash.alias("_h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(4)]
    n = F.count(F.lit(1))
    return hashed.groupBy("record_type", "bucket").agg(n.alias("records"), F.sha2(F.concat_ws(":", n.cast("string"), *parts), 256).alias("digest")) \
        .select(F.lit(run_id).alias("run_id"), "record_type", "bucket", "records", "digest")


def _sides(ledger: DataFrame, before: str, after: str, on: list[str], values: list[str]) -> DataFrame:
    old = ledger.filter(F.col("run_id") == before).select(*on, *[F.col(v).alias(f"before_{v}") for v in values])
    new = ledger.filter(F.col("run_id") == after).select(*on, *[F.col(v).alias(f"after_{v}") for v in values])
    return old.join(new, on, "full_outer")


def _change() -> Column:
    return (F.when(F.col("before_records").isNull(), F.lit("added")).when(F.col("after_records").isNull(), F.lit("removed"))
            .otherwise(F.lit("changed")))


def _counts() -> list[Column]:
    return [F.coalesce(f"{s}_records", F.lit(0)).cast("long").alias(f"{s}_records") for s in ("before", "after")]


def key_changes(ledger: DataFrame, before: str, after: str) -> DataFrame:
    """Keys that only one of the two runs' feeds has."""
    sides = _sides(ledger, before, after, ["record_type", "key"], ["records"])
    return sides.select("record_type", "key", _change().alias("change"), *_counts()).filter(F.col("change") != "changed")


def bucket_changes(ledger: DataFrame, before: str, after: str) -> DataFrame:
    """Buckets whose records differ between the two runs."""
    sides = _sides(ledger, before, after, ["record_type", "bucket"], ["records", "digest"])
    return sides.filter(~F.col("before_digest").eqNullSafe(F.col("after_digest"))) \
        .select("record_type", "bucket", _change().alias("change"), *_counts())
