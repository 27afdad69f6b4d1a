"""Mortality: counts in narrow bands to age-standardised rates, no strata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.functions.nulls import not_in
from stratarates.functions.text import hyphen_to_en_dash
from stratarates.operators.bands import rollup_long
from stratarates.operators.counts import counts
from stratarates.operators.extracts import append_standardised_long, extract
from stratarates.operators.rates import (
    age_specific_rates,
    reference_totals,
    standard,
    standardised_rates,
)
from stratarates.plans.settings import (
    MORTALITY,
    MORTALITY_EXCLUDED_AGES,
    MORTALITY_ROWS,
    RateSettings,
)
from stratarates.sources.staging import stage


def mortality_fact(sheet: DataFrame, settings: RateSettings = MORTALITY) -> DataFrame:
    """The rows and columns of a published count sheet that are analysed."""
    rows = sheet.where(not_in("age_group_years", MORTALITY_EXCLUDED_AGES))
    rows = rows.where(F.col("year") >= settings.years[0])
    for column, value in MORTALITY_ROWS.items():
        rows = rows.where(F.col(column) == value)
    return rows.select(
        F.col("year").alias("Year"),
        hyphen_to_en_dash("age_group_years").alias("Age"),
        F.col("count").alias("Count"),
    )


def reband_counts(fact: DataFrame, bands: Mapping[str, Sequence[str]]) -> DataFrame:
    """(Year, Age, Count) in wide bands; a missing narrow band gives NULL."""
    return rollup_long(fact, ["Year"], "Age", bands, ["Count"])


class MortalityRates:
    """Every table of the mortality analysis as a DataFrame.

    ``cells`` has (Year, Age, Count) in wide bands, ``exposed`` (Year, Age, pop,
    withouthyst).  Both are staged first, since both are used more than once;
    ``inputs_staged`` skips that where they come from small staged tables.
    ``rates`` is staged on first use; everything else is lazy.
    """

    def __init__(
        self,
        cells: DataFrame,
        exposed: DataFrame,
        settings: RateSettings,
        inputs_staged: bool = False,
    ) -> None:
        self.settings = settings
        self.cells = cells if inputs_staged else stage(cells, "cells")
        self.exposed = exposed if inputs_staged else stage(exposed, "exposed")

    @cached_property
    def standard(self) -> DataFrame:
        return standard(self.exposed, self.settings.ref_year)

    @cached_property
    def rates(self) -> DataFrame:
        return stage(age_specific_rates(self.cells, self.exposed, self.standard), "rates")

    @cached_property
    def totals(self) -> DataFrame:
        return reference_totals(self.rates, self.settings.ref_year)

    @cached_property
    def standardised(self) -> DataFrame:
        return standardised_rates(self.rates, self.totals, ["Year"], self.settings.variants)

    def fraction_inputs(self) -> DataFrame:
        columns = ["Age", "Year", "Count", "atrisk"]
        return extract(self.rates, self.settings.extract_years, columns)

    def age_series(self) -> DataFrame:
        s = self.settings
        return append_standardised_long(
            self.rates, self.standardised, s.standardised_label, s.variants
        )

    def rate_slice(self, year: int, variant: str | None = None) -> DataFrame:
        rows = self.age_series().where(F.col("Year") == year)
        return rows if variant is None else rows.where(F.col("corrected") == variant)

    def deaths(self, keys: Sequence[str] = ()) -> DataFrame:
        return counts(self.cells, keys)
