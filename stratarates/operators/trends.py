"""Tidy tables from the results of an external trend fit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarates.functions.nulls import as_col, is_in, once, to_number
from stratarates.functions.text import (
    before,
    drop_trailing_star,
    first_word,
    fixed_decimals,
    has_star,
    mend_en_dash,
    short_decimals,
)
from stratarates.operators.classify import label_rank, recode

CHANGE_POINT = "Joinpoint Location"
MODELED_CORRECTED = "Modeled hysterectomy-corrected trend"
MODELED_UNCORRECTED = "Modeled hysterectomy-uncorrected trend"


def trend_points(
    df: DataFrame, endpoints: Sequence[int], change_point: str = CHANGE_POINT
) -> DataFrame:
    """Keep the first and last year and every change point."""
    return df.where(F.col("Year").isin(list(endpoints)) | F.col(f"`{change_point}`").isNotNull())


def cohort_variant(cohort: Column | str) -> Column:
    """``… / corrected…`` and ``… / not…`` to the names of the modeled trends."""
    c = as_col(cohort)
    return F.when(c.contains("/ corrected"), MODELED_CORRECTED).when(
        c.contains("/ not"), MODELED_UNCORRECTED
    )


def tidy_by_stratum(
    df: DataFrame, endpoints: Sequence[int], rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Points of a fit by stratum: the stratum is the cohort's first word (with
    ``rename`` for names of two words), the variant follows the slash."""
    stratum = recode(first_word("Cohort"), rename or {})
    return (
        trend_points(df, endpoints)
        .withColumn("Subtype", stratum)
        .withColumn("corrected", cohort_variant("Cohort"))
        .withColumn("observed", F.lit("Modeled trend"))
        .withColumn("group", F.concat_ws(" ", *[F.coalesce(c, F.lit("NA")) for c in ("Subtype", "corrected")]))
        .drop("Cohort")
    )


def tidy_by_age(
    df: DataFrame, endpoints: Sequence[int], separator: str, flag: str | None = None
) -> DataFrame:
    """Points of a fit by age: the band is the cohort up to ``separator``, its
    en dash mended.  ``flag`` replaces the change point's place by a text."""
    point = F.col(f"`{CHANGE_POINT}`")
    mark = point if flag is None else F.when(point.isNotNull(), flag)
    return (
        trend_points(df, endpoints)
        .withColumn("Age", mend_en_dash(before("Cohort", separator)))
        .withColumn("observed", F.lit("Modeled Trend"))
        .withColumn("Joinpoint", mark)
        .drop("Cohort", CHANGE_POINT)
    )


def change_points(df: DataFrame, change_point: str, column: str, label: str) -> DataFrame:
    """Only the change points, relabelled in ``column``."""
    return df.where(F.col(f"`{change_point}`").isNotNull()).withColumn(column, F.lit(label))


def _number(aapc: Column | str) -> Column:
    return once(drop_trailing_star(aapc), to_number)


def aapc_label(aapc: Column | str) -> Column:
    """``APC=-1.20*``: two decimals, a trailing space in place of a missing star,
    a space after ``=`` unless a minus sign stands there."""
    end = F.when(has_star(aapc), "*").otherwise(" ")

    def label(number: Column) -> Column:
        start = F.when(number.contains("-"), "APC=").otherwise("APC= ")
        return F.concat(start, number, end)

    return once(fixed_decimals(_number(aapc), 2), label)


def with_padded_aapc_label(df: DataFrame, aapc: str = "AAPC", into: str = "label") -> DataFrame:
    """``<number> <star>``, numbers padded to the width of the widest.

    The width is one aggregate over the table and enters as a scalar subquery;
    no window gathers the rows.
    """
    numbers = df.withColumn("_number", fixed_decimals(_number(aapc), 2))
    width = numbers.agg(F.max(F.length("_number")).alias("width")).scalar()
    star = F.when(has_star(aapc), "*").otherwise("")
    padded = F.concat(F.repeat(F.lit(" "), width - F.length("_number")), "_number")
    return numbers.withColumn(into, F.concat(padded, F.lit(" "), star)).drop("_number")


def aapc_label_short(aapc: Column | str) -> Column:
    """``<number> <star or space>``, the number without trailing zeros."""
    star = F.when(has_star(aapc), "*").otherwise(" ")
    return F.concat(short_decimals(_number(aapc), 2), F.lit(" "), star)


def attach_labels(trend: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels joined by ``keys``.  NULL keys match each other: a cohort that names no
    variant has a NULL variant in both tables and keeps its label."""
    other = labels.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(and_, (trend[k].eqNullSafe(other[f"_{k}"]) for k in keys))
    return trend.join(other, same).drop(*(f"_{k}" for k in keys))


def label_rows(trend: DataFrame, year: int, shift: float = 0.0) -> DataFrame:
    """The last year's rows, where labels go, optionally moved left."""
    rows = trend.where(F.col("Year") == year)
    return rows.withColumn("Year", F.col("Year") + F.lit(shift)) if shift else rows


@dataclass(frozen=True)
class AnchorRules:
    """Vertical places of labels.  A shift list is read top down: the first entry
    whose strata (``None``: any) match wins."""

    corrected_shift: Sequence[tuple[Sequence[str] | None, float]]
    uncorrected_shift: Sequence[tuple[Sequence[str] | None, float]]
    anchor_shift: Sequence[tuple[Sequence[str], float]]
    uncorrected_gap: Sequence[tuple[Sequence[str] | None, float]]
    corrected: str = MODELED_CORRECTED
    uncorrected: str = MODELED_UNCORRECTED
    stratum: str = field(default="Subtype")

    def _pick(self, shifts) -> Column:
        out = F.lit(None).cast("double")
        for strata, shift in reversed(list(shifts)):
            value = F.lit(float(shift))
            out = (
                value
                if strata is None
                else F.when(is_in(self.stratum, strata), value).otherwise(out)
            )
        return out


def label_anchors(df: DataFrame, rules: AnchorRules, modeled: str) -> DataFrame:
    """Shift each label off its line, and anchor the uncorrected label a fixed
    gap below the corrected one of its stratum."""
    is_corrected = F.col("corrected") == rules.corrected
    is_uncorrected = F.col("corrected") == rules.uncorrected
    value = F.col(f"`{modeled}`")
    shifted = F.when(is_corrected, value + rules._pick(rules.corrected_shift)).when(
        is_uncorrected, value + rules._pick(rules.uncorrected_shift)
    )
    own = F.when(is_corrected, value + rules._pick(rules.anchor_shift))
    in_stratum = (
        Window.partitionBy(rules.stratum)
        .orderBy("corrected")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    first_own = F.first("_own", ignorenulls=True).over(in_stratum)
    anchor = (
        F.when(is_corrected, F.col("_own"))
        .when(is_uncorrected, first_own - rules._pick(rules.uncorrected_gap))
        .otherwise(value)
    )
    return (
        df.withColumn(modeled, shifted)
        .withColumn("_own", own)
        .withColumn("yaxis", anchor)
        .drop("_own")
    )


def chart_series(
    df: DataFrame,
    variant_names: Mapping[str, str],
    levels: Sequence[str],
    label: str = "Subtype",
    observed: str = "Observed Rate",
) -> DataFrame:
    """Observed series of the chosen labels: variants renamed, tagged, and ranked
    in panel order."""
    return (
        df.where(F.col(label).isin(list(levels)))
        .withColumn("corrected", recode("corrected", variant_names, keep_others=False))
        .withColumn("observed", F.lit(observed))
        .withColumn("panel", label_rank(label, levels))
    )


