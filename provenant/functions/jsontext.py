"""Canonical JSON text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column


def canonical_text(text: str | None) -> str | None:
    """Keys sorted at every depth, one separator form, other than ASCII characters as they are; numbers in their shortest form,
    integers whole. Of a repeated key the last value stays. Null stays null; text that is no JSON, or can't be
    written so (lone surrogates, very deep nesting), stays as it is."""
    if text is None:
        return None
    try:
        out = json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
        out.encode()
        return out
    except (ValueError, RecursionError):
        return text


def canonical_json(c) -> Column:
    """:func:`canonical_text` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(canonical_text, na_action="ignore")

    return run(as_column(c))
