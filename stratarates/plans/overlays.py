"""Trend overlays: modeled trends of another program, laid over observed rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.functions.text import before
from stratarates.operators import trends
from stratarates.operators.classify import label_rank
from stratarates.operators.rates import Variants, rate_rows
from stratarates.plans.settings import AGE_PANELS


class StratumOverlay:
    """Every table of a chart by stratum and variant, from the trend and AAPC sheets."""

    def __init__(
        self,
        trend: DataFrame,
        aapc: DataFrame,
        endpoints: tuple[int, int],
        rules: trends.AnchorRules,
        modeled: str,
        full_names: Mapping[str, str] | None = None,
    ) -> None:
        self.trend, self.aapc, self.endpoints = trend, aapc, endpoints
        self.rules, self.modeled, self.full_names = rules, modeled, full_names or {}

    @cached_property
    def tidy(self) -> DataFrame:
        return trends.tidy_by_stratum(self.trend, self.endpoints, self.full_names)

    @cached_property
    def markers(self) -> DataFrame:
        return trends.change_points(self.tidy, trends.CHANGE_POINT, "corrected", "Joinpoints")

    @cached_property
    def labels(self) -> DataFrame:
        return self.aapc.select(
            before("Cohort", " /").alias("Subtype"),
            trends.cohort_variant("Cohort").alias("corrected"),
            trends.aapc_label("AAPC").alias("label"),
        )

    @cached_property
    def labelled(self) -> DataFrame:
        return trends.attach_labels(self.tidy, self.labels, ["Subtype", "corrected"])

    @cached_property
    def anchors(self) -> DataFrame:
        rows = trends.label_rows(self.labelled, self.endpoints[1])
        return trends.label_anchors(rows, self.rules, self.modeled)


def share_series(shares: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Stratum shares in percent, ranked in panel order."""
    return shares.select(
        "Year",
        "Subtype",
        (F.col("proportion") * 100).alias("proportion"),
        label_rank("Subtype", levels).alias("panel"),
    )


def age_rate_series(rates: DataFrame, variants: Variants) -> DataFrame:
    """Age-specific rates per stratum in both variants, scaled."""
    return rate_rows(rates, ["Subtype", "Year", "Age"], variants)


def observed_by_age(
    series: DataFrame,
    variant: str,
    panels: Sequence[str] = AGE_PANELS,
    observed: str = "Observed Rate",
) -> DataFrame:
    """One variant of a series by age, tagged as observed and ranked in panel order;
    ages without a panel have a NULL rank."""
    return (
        series.where(F.col("corrected") == variant)
        .withColumn("observed", F.lit(observed))
        .withColumn("panel", label_rank("Age", panels))
    )
