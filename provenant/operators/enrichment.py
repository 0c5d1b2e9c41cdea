"""Enrichment joins that replace live lookups with landed reference tables.

Alias, currency and rate tables are small fixed lists and are broadcast; the
atlas comes from ``nation`` (25 rows by definition). Indicator values are
reduced to one row per country with ``max_by`` before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

REGIONAL_PATTERN = "(?i)region|africa$"


def regional_label(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("is_regional", F.col(col).rlike(REGIONAL_PATTERN))


def country_conform(counts: DataFrame, aliases: DataFrame, atlas: DataFrame) -> DataFrame:
    """country counts -> atlas ids: lower-case, alias, match, sum; unmatched dropped."""
    labelled = counts.withColumn("label", F.lower(T.py_strip("country")))
    with_alias = labelled.join(F.broadcast(aliases), "label", "left") \
        .withColumn("atlas_name", F.coalesce(F.col("atlas_name"), F.col("label")))
    return with_alias.join(F.broadcast(atlas), "atlas_name") \
        .groupBy("atlas_id").agg(F.sum("records").alias("records"))


def fx_convert(awards: DataFrame, rates: DataFrame) -> DataFrame:
    """amount x USD rate when a currency is present and is not USD."""
    j = awards.join(F.broadcast(rates), "currency", "left")
    convert = F.col("amount").isNotNull() & F.col("currency").isNotNull() & (F.col("currency") != "USD")
    # money in decimal arithmetic: amounts carry 2 places, rates 8
    converted = (F.col("amount").cast("decimal(20,2)") * F.col("usd_rate").cast("decimal(20,8)"))
    return j.withColumn("usd_amount", F.when(convert, F.round(converted, 2).cast("double"))
                        .otherwise(F.col("amount")))


def latest_indicators(indicators: DataFrame, names: dict[str, str]) -> DataFrame:
    """Most recent non-empty value of each named indicator, one row per country (the ``mrnev=1`` rule): ``names`` gives the output
    column of each indicator, its year is ``<column>_year``."""
    found = []
    for column, name in names.items():
        year = F.when((F.col("indicator") == name) & F.col("value").isNotNull(), F.col("year"))
        found += [F.max(year).alias(f"{column}_year"), F.max_by("value", year).alias(column)]
    return indicators.groupBy("country").agg(*found)


def country_context(countries: DataFrame, indicators: DataFrame, attributes: DataFrame, names: dict[str, str]) -> DataFrame:
    """Attributes (code, region, currencies) and latest indicators of each country. Regional labels have none of them, and a
    country that the attributes don't know is ``unavailable``. ``attributes`` has one row per country."""
    regional = F.coalesce(F.col("country").rlike(REGIONAL_PATTERN), F.lit(False))
    known = attributes.withColumn("_known", F.lit(True))
    j = countries.join(known, "country", "left").join(latest_indicators(indicators, names), "country", "left")
    ready = ~regional & F.col("_known").isNotNull()
    values = ["code", "region", "currencies", *[c for n in names for c in (n, f"{n}_year")]]
    return j.select("country", F.when(regional, F.lit("regional")).when(ready, F.lit("ready")).otherwise(F.lit("unavailable")).alias("context_status"),
                    *[F.when(ready, F.col(c)).alias(c) for c in values])


def project_context(projects: DataFrame, api: DataFrame) -> DataFrame:
    """Title, sector, approval date and status of the project service's record, by its fallback field names; a project without a
    record is ``unavailable``. ``api`` has one row per project."""
    found = api.select("project_id", F.coalesce("proj_name", "project_name").alias("title"),
                       F.coalesce(F.col("sector1.Name"), F.col("sector_name")).alias("sector"),
                       F.col("boardapprovaldate").alias("approval_date"), "status", F.lit("ready").alias("_status"))
    return projects.select("project_id").join(found, "project_id", "left").select(
        "project_id", F.coalesce("_status", F.lit("unavailable")).alias("context_status"), "title", "sector", "approval_date", "status")
