"""Hashing helpers: content hashes, short ids and order-insensitive digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import as_column, python_text


def sha256_hex(c) -> Column:
    return F.sha2(as_column(c).cast("string"), 256)


def content_hash(*cols) -> Column:
    """sha256 of ``a|b|c`` where a null renders as the text ``None``."""
    return F.sha2(F.concat_ws("|", *[python_text(c) for c in cols]), 256)


def short_id(prefix_text: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(prefix_text, 256), 1, length)


# Fixed value: the byte form that contract fingerprints are taken over.
_FINGERPRINT_FORM = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical_json_sha256(document: dict) -> str:
    """Driver-side fingerprint of a small config document (contracts)."""
    digest = hashlib.sha256()
    for part in _FINGERPRINT_FORM.iterencode(document):
        digest.update(part.encode())
    return digest.hexdigest()


def unordered_digest(df: DataFrame, row_hash: Column) -> DataFrame:
    """Order-insensitive SHA-256 of a whole table, fully map-side combinable.

    Each row contributes a sha256; its first 60 hex digits are read as four
    60-bit integers and summed column-wise (an additive multiset hash). Sums
    are plain aggregates, so no group is ever collected into one row or task,
    and the result does not depend on partitioning or row order.
    Returns one row: ``digest``, ``rows``.
    """
    return digest_of_sums(df.select(row_hash.alias("_h")).agg(F.count(F.lit(1)).alias("rows"), *digest_sums("_h")))


def _sum(value: Column, i: int) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,0)")).alias(f"_s{i}")


def digest_sums(hashed: str) -> list[Column]:
    """The four sums of :func:`unordered_digest` over a column of SHA-256 texts."""
    return [_sum(F.conv(F.substring(hashed, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"), i) for i in range(4)]


def sums_of_sums() -> list[Column]:
    """The sums of several groups' sums."""
    return [_sum(F.col(f"_s{i}"), i) for i in range(4)]


def digest_of_sums(agg: DataFrame) -> DataFrame:
    """``digest`` and ``rows`` of an aggregate's ``rows`` and sums."""
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return agg.select(F.sha2(text, 256).alias("digest"), F.col("rows").cast("long").alias("rows"))
