"""Exposure-corrected and directly standardised rates.

The populations, standards and cells handled here are aggregates, one row per
(stratum, year, band).  Joins carry no broadcast hint: Catalyst and AQE know
these sizes and broadcast below the session's threshold, and shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratarates.functions.nulls import safe_div, strict_sum
from stratarates.operators.reshape import lengthen_groups

PER = 100_000


@dataclass(frozen=True)
class Variants:
    """Labels of the two rate variants in long tables."""

    corrected: str = "corrected for hyst"
    uncorrected: str = "not corrected for hyst"


INCIDENCE_VARIANTS = Variants()
MORTALITY_VARIANTS = Variants("rate", "rate_nc")


def exposed_population(
    pop: DataFrame, fractions: DataFrame, keys: Sequence[str] = ("Year", "Age")
) -> DataFrame:
    """``withouthyst = pop * fraction``; bands without a fraction disappear."""
    return pop.join(fractions, list(keys)).select(
        *keys, "pop", (F.col("pop") * F.col("fraction")).alias("withouthyst")
    )


def standard(pop: DataFrame, ref_year: int) -> DataFrame:
    """The reference year's bands: (Age, standardpop, withouthyststandardpop)."""
    return pop.where(F.col("Year") == ref_year).select(
        "Age",
        F.col("pop").alias("standardpop"),
        F.col("withouthyst").alias("withouthyststandardpop"),
    )


def age_specific_rates(
    cells: DataFrame,
    pop: DataFrame,
    std: DataFrame,
    how: str = "inner",
    inflate_weights: bool = True,
) -> DataFrame:
    """Rates per cell, with and without exposure correction.

    ``atrisk`` is the exposed population plus the cases themselves.  The
    standard weight also has the cell's own (current-year) count added, so
    weights exceed the reference total outside the reference year;
    ``inflate_weights=False`` leaves the reference exposure as it is.
    ``how="left"`` keeps cells without a population, with NULL rates.
    """
    count = F.col("Count")
    weight = F.col("withouthyststandardpop")
    keys = [c for c in cells.columns if c != "Count"]
    return (
        cells.join(pop, ["Year", "Age"], how)
        .join(std, ["Age"], how)
        .withColumn("atrisk", F.col("withouthyst") + count)
        .withColumn("atriskstandardpop", weight + count if inflate_weights else weight)
        .select(
            *keys,
            "Count",
            "atrisk",
            "pop",
            "atriskstandardpop",
            "standardpop",
            safe_div("Count", "atrisk").alias("agespecificrate"),
            safe_div("Count", "pop").alias("agespecificrate_nc"),
        )
    )


def reference_totals(
    rates: DataFrame, ref_year: int, total: str | None = None, stratum: str = "Subtype"
) -> DataFrame:
    """One row (totalpop, totalatrisk): the reference year's bands, of the total
    stratum where there are strata.  Without such rows every rate would be NULL,
    so that is an error."""
    kept = rates.where(F.col("Year") == ref_year)
    if total is not None:
        kept = kept.where(F.col(stratum) == total)
    of = "" if total is None else f" of stratum {total}"
    missing = F.raise_error(F.lit(
        f"no rows of reference year {ref_year}{of}: add total rows (with_totals) or check the year"
    )).cast("double")
    some = F.count(F.lit(1)) > 0
    return kept.agg(
        *(
            F.when(some, strict_sum(c).cast("double")).otherwise(missing).alias(f"total{c}")
            for c in ("pop", "atrisk")
        )
    )


def variant_rows(
    df: DataFrame,
    ids: Sequence[str],
    corrected: Column,
    uncorrected: Column,
    variants: Variants,
    into: str = "rate",
) -> DataFrame:
    """One row per variant: (ids, corrected = variant label, value)."""
    both = df.select(*ids, corrected.alias("_c"), uncorrected.alias("_u"))
    groups: Mapping[str, Mapping[str, str]] = {
        variants.corrected: {into: "_c"},
        variants.uncorrected: {into: "_u"},
    }
    return lengthen_groups(both, ids, groups, "corrected")


def rate_rows(
    rates: DataFrame, ids: Sequence[str], variants: Variants, per: float = PER
) -> DataFrame:
    """Age-specific rates in long form, scaled."""
    return variant_rows(
        rates,
        ids,
        F.col("agespecificrate") * per,
        F.col("agespecificrate_nc") * per,
        variants,
    )


def standardised_rates(
    rates: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    variants: Variants = INCIDENCE_VARIANTS,
    per: float = PER,
) -> DataFrame:
    """Directly standardised rate per ``keys`` and variant, with the sums of its
    parts.

    Weighted rates are summed for both variants in one aggregate over the cells
    and only the result is made long, so the aggregation does not see every cell
    twice.  The reference totals enter as one scalar subquery.
    """
    parts = ("Count", "atrisk", "pop", "atriskstandardpop", "standardpop")
    sums = rates.groupBy(*keys).agg(
        *[strict_sum(p).alias(p) for p in parts],
        strict_sum(F.col("agespecificrate") * F.col("atriskstandardpop")).alias("_weighted"),
        strict_sum(F.col("agespecificrate_nc") * F.col("standardpop")).alias("_weighted_nc"),
    )
    both = totals.select(F.struct("totalatrisk", "totalpop")).scalar()
    sums = sums.withColumn("_totals", both)
    return variant_rows(
        sums,
        [*keys, *parts],
        safe_div("_weighted", "_totals.totalatrisk") * per,
        safe_div("_weighted_nc", "_totals.totalpop") * per,
        variants,
        into="ageadjustedrate",
    ).select(*keys, "corrected", *parts, "ageadjustedrate")
