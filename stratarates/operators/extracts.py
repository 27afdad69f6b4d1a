"""Extracts of rate tables for downstream programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.operators.classify import recode
from stratarates.operators.rates import PER, rate_rows, Variants

SERIES = ("corrected", "Subtype", "Year", "Count", "atrisk", "ageadjustedrate")


def series(asr: DataFrame) -> DataFrame:
    """The columns a trend-fitting program needs."""
    return asr.select(*SERIES)


def later_years(df: DataFrame, after: int) -> DataFrame:
    return df.where(F.col("Year") > after)


def extract(
    df: DataFrame,
    years: Sequence[int],
    columns: Sequence[str],
    strata: Sequence[str] | None = None,
    variant: str | None = None,
) -> DataFrame:
    """Chosen years (and strata, and one variant) of a rate table."""
    out = df.where(F.col("Year").isin(list(years)))
    if strata is not None:
        out = out.where(F.col("Subtype").isin(list(strata)))
    if variant is not None:
        out = out.where(F.col("corrected") == variant)
    return out.select(*columns)


def append_standardised(
    rates: DataFrame,
    asr: DataFrame,
    label: str,
    variant: str,
    total: str,
    per: float = PER,
) -> DataFrame:
    """Age series of the total stratum with its standardised rate appended as a
    pseudo age, whose Count and atrisk are 0."""
    by_age = rates.where(F.col("Subtype") == total).select(
        "Age",
        "Year",
        "Count",
        "atrisk",
        (F.col("agespecificrate") * per).alias("agespecificrate"),
    )
    overall = asr.where((F.col("corrected") == variant) & (F.col("Subtype") == total)).select(
        F.col("Subtype").alias("Age"),
        "Year",
        F.lit(0).cast("long").alias("Count"),
        F.lit(0.0).alias("atrisk"),
        F.col("ageadjustedrate").alias("agespecificrate"),
    )
    return by_age.unionByName(overall).withColumn("Age", recode("Age", {total: label}))


def append_standardised_long(
    rates: DataFrame, asr: DataFrame, label: str, variants: Variants, per: float = PER
) -> DataFrame:
    """The same without strata, both variants in long form."""
    by_age = rate_rows(rates, ["Age", "Year"], variants, per)
    overall = asr.select(
        F.lit(label).alias("Age"), "corrected", "Year", F.col("ageadjustedrate").alias("rate")
    )
    return by_age.select("Age", "corrected", "Year", "rate").unionByName(overall)
