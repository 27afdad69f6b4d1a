"""Incidence: classified, reallocated counts to age-standardised rates."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.functions.nulls import not_in, strict_sum
from stratarates.operators.classify import classify, split_in_two
from stratarates.operators.counts import cell_counts, counts
from stratarates.operators.extracts import (
    append_standardised,
    extract,
    later_years,
    series,
)
from stratarates.operators.rates import (
    age_specific_rates,
    reference_totals,
    standard,
    standardised_rates,
)
from stratarates.operators.reallocate import (
    append_reallocated,
    reallocate,
    stratum_shares,
    unspecified_share,
)
from stratarates.sources.staging import stage
from stratarates.plans.settings import (
    INCIDENCE_ROWS,
    INCIDENCE_SUMMARY_AGES,
    RateSettings,
)


def incidence_fact(sheet: DataFrame) -> DataFrame:
    """The rows and columns of a published count sheet that are analysed."""
    rows = sheet.where(not_in("age_group_years", INCIDENCE_SUMMARY_AGES))
    for column, value in INCIDENCE_ROWS.items():
        rows = rows.where(F.col(column) == value)
    return rows.select(
        "cancer_type",
        F.col("year").alias("Year"),
        F.col("age_group_years").alias("Age"),
        F.col("count_for_cancer_type").alias("Count"),
        F.col("total_count_for_uterine_cancer").alias("ALLUterineCancers"),
        "i_d",
    )


def fact_cells(fact: DataFrame) -> DataFrame:
    """One staged row per code, year and band: the one pass over a fact of any
    size (sheet rows or single events), whatever is computed afterwards."""
    cells = fact.groupBy("i_d", "cancer_type", "Year", "Age").agg(
        strict_sum("Count").alias("Count"),
        F.max("ALLUterineCancers").alias("ALLUterineCancers"),
    )
    return stage(cells, "fact-cells")


class IncidenceRates:
    """Every table of the incidence analysis as a DataFrame.

    ``fact`` has (i_d, cancer_type, Year, Age, Count, ALLUterineCancers), with a
    NULL i_d on published total rows; ``exposed`` has (Year, Age, pop,
    withouthyst).  Both feed several branches, so they are aggregated and staged
    first: whatever their sources, each is read once.  ``inputs_staged`` skips
    that for cells that already are small staged tables.  ``counts`` (the cleaned
    cells) and ``rates`` (one row per stratum, year and band) feed all other
    tables and are staged on first use; everything else is lazy.
    """

    def __init__(
        self,
        fact: DataFrame,
        exposed: DataFrame,
        settings: RateSettings,
        inputs_staged: bool = False,
    ) -> None:
        self.settings = settings
        self.exposed = exposed if inputs_staged else stage(exposed, "exposed")
        cells = fact if inputs_staged else fact_cells(fact)
        self.classified = classify(
            cells, "i_d", settings.strata, total=settings.total, default=settings.blank
        )

    @cached_property
    def shares(self) -> DataFrame:
        return stratum_shares(self.classified, self.settings.targets)

    @cached_property
    def reallocated(self) -> DataFrame:
        kind = self.settings.unspecified
        rows = self.classified.where(F.col("cancer_type") == kind)
        return reallocate(rows, self.shares).withColumn("cancer_type", F.lit(kind))

    @cached_property
    def counts(self) -> DataFrame:
        """Cleaned counts: reallocated rows in, rows without a stratum out."""
        cleaned = append_reallocated(
            self.classified, self.reallocated, blank=self.settings.blank
        )
        return stage(cleaned, "counts")

    @cached_property
    def standard(self) -> DataFrame:
        return standard(self.exposed, self.settings.ref_year)

    @cached_property
    def rates(self) -> DataFrame:
        cells = cell_counts(
            self.counts, ["Subtype", "Year", "Age"], self.settings.excluded_bands
        )
        return stage(age_specific_rates(cells, self.exposed, self.standard), "rates")

    @cached_property
    def totals(self) -> DataFrame:
        return reference_totals(self.rates, self.settings.ref_year, self.settings.total)

    @cached_property
    def standardised(self) -> DataFrame:
        return standardised_rates(
            self.rates, self.totals, ["Subtype", "Year"], self.settings.variants
        )

    # exports ---------------------------------------------------------------

    @cached_property
    def trend_series(self) -> DataFrame:
        return series(self.standardised)

    def later_series(self) -> DataFrame:
        return later_years(self.trend_series, self.settings.late_after)

    def age_series(self) -> DataFrame:
        s = self.settings
        return append_standardised(
            self.rates, self.standardised, s.standardised_label, s.variants.corrected, s.total
        )

    def fraction_inputs(self) -> DataFrame:
        s = self.settings
        columns = ["Subtype", "Age", "Year", "Count", "atrisk"]
        return extract(self.rates, s.extract_years, columns, [*s.targets, s.total])

    def attributable_inputs(self) -> DataFrame:
        s = self.settings
        return extract(
            self.trend_series,
            s.extract_years,
            self.trend_series.columns,
            [*s.targets, s.total],
            s.variants.corrected,
        )

    # sensitivities -----------------------------------------------------------

    def pooled_standardised(self) -> DataFrame:
        """Rates of the pooled strata against the main analysis' totals."""
        s = self.settings
        rows = self.counts.where(F.col("Subtype").isin(list(s.pooled)))
        cells = cell_counts(rows, ["Year", "Age"], s.excluded_bands)
        rates = age_specific_rates(cells, self.exposed, self.standard)
        asr = standardised_rates(rates, self.totals, ["Year"], s.variants)
        return asr.select("corrected", "Year", "ageadjustedrate")

    def grouped_rates(self) -> DataFrame:
        """Cell rates of the target strata with an early/late group; cells without
        a population are kept."""
        s = self.settings
        rows = self.counts.where(F.col("Subtype").isin([*s.targets, s.total]))
        cells = cell_counts(rows, ["Subtype", "Year", "Age"], s.excluded_bands)
        rates = age_specific_rates(cells, self.exposed, self.standard, how="left")
        group = split_in_two("Age", s.early_bands, s.early_label, s.late_label)
        return rates.withColumn("age_group", group)

    def grouped_standardised(self) -> DataFrame:
        """What each age group contributes to the overall rate: numerators are
        split by group, denominators are the all-age reference totals."""
        s = self.settings
        rates = stage(self.grouped_rates(), "grouped-rates")
        totals = reference_totals(rates, s.ref_year, s.total)
        asr = standardised_rates(rates, totals, ["Subtype", "Year", "age_group"], s.variants)
        return asr.where(F.col("corrected") == s.variants.corrected).select(
            "corrected", "Subtype", "age_group", "Year", "Count", "atrisk", "ageadjustedrate"
        )

    # descriptives --------------------------------------------------------------

    def unspecified_share(self) -> DataFrame:
        is_unspecified = F.col("cancer_type") == self.settings.unspecified
        return unspecified_share(self.counts, is_unspecified)

    def adult(self) -> DataFrame:
        return self.counts.where(~F.col("Age").isin(list(self.settings.excluded_bands)))

    def cases_by_type(self) -> DataFrame:
        return counts(self.adult(), ["cancer_type", "i_d"])

    def cases_by_stratum(self, where=None) -> DataFrame:
        return counts(self.adult(), ["Subtype"], where)

    def cases_by_band(self) -> DataFrame:
        return counts(self.counts, ["Age"], F.col("Subtype") != self.settings.total)

    def young_cases(self, band: str) -> DataFrame:
        where = (F.col("Age") == band) & (F.col("Subtype") != self.settings.total)
        return counts(self.counts, ["Year", "Age", "cancer_type"], where, drop_zero=True)

    def cases_by_stratum_year(self) -> DataFrame:
        return counts(self.rates, ["Subtype", "Year"])
