"""Grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarates.functions.nulls import strict_sum


def counts(
    df: DataFrame,
    keys: Sequence[str] = (),
    where: Column | None = None,
    measure: str = "Count",
    into: str = "Count",
    drop_zero: bool = False,
) -> DataFrame:
    """Sum of a count measure by keys (or overall): one partial and one final
    aggregate, so a hot key costs one row per task in the shuffle.  Integers stay
    integers, and weighted counts keep their fractions."""
    rows = df if where is None else df.where(where)
    total = strict_sum(measure).alias(into)
    out = rows.groupBy(*keys).agg(total) if keys else rows.agg(total)
    return out.where(F.col(into) != 0) if drop_zero else out


def with_totals(
    events: DataFrame,
    code: str,
    cell: Sequence[str],
    measure: str,
    into: str = "Count",
    all_cases: str = "ALLUterineCancers",
) -> DataFrame:
    """Events counted per code and cell, plus a total row (NULL code) per cell and
    the cell's total on every row: (code, cell, into, all_cases).

    Published counts bring these rows; events do not, and rates refer to them.  A
    NULL code of an event is counted under ``UNKNOWN``, so it is never taken for
    a total.  One aggregate makes both levels; the window that follows has one
    row per code in a partition.
    """
    named = events.withColumn(code, F.coalesce(code, F.lit("UNKNOWN")))
    keys = [F.col(code), *(F.col(c) for c in cell)]
    both = named.groupingSets([keys, keys[1:]], *keys).agg(strict_sum(measure).alias(into))
    total = F.max(F.when(F.col(code).isNull(), F.col(into))).over(Window.partitionBy(*cell))
    return both.withColumn(all_cases, total)


def cell_counts(
    df: DataFrame, keys: Sequence[str], exclude_bands: Sequence[str] = (), band: str = "Age"
) -> DataFrame:
    """Counts per cell without the excluded bands.  The band filter is applied
    before the aggregation; bands are keys, so the result is the same."""
    kept = df.where(~F.col(band).isin(list(exclude_bands))) if exclude_bands else df
    return counts(kept, keys)
