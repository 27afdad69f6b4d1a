"""Reallocation of unspecified counts to strata."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarates.functions.nulls import lenient_sum, safe_div, strict_sum
from stratarates.operators.classify import BLANK
from stratarates.sources.places import with_places
from stratarates.sources.staging import stage


def stratum_shares(
    df: DataFrame,
    targets: Sequence[str],
    by: str = "Year",
    stratum: str = "Subtype",
    measure: str = "Count",
) -> DataFrame:
    """Share of each target stratum in the targets' total, per ``by`` and over
    all ages: (by, stratum, proportion).

    Counts are aggregated first; the window then sees one row per target.
    """
    sums = (
        df.where(F.col(stratum).isin(list(targets)))
        .groupBy(by, stratum)
        .agg(strict_sum(measure).alias("_n"))
    )
    w = Window.partitionBy(by)
    known = F.count("_n").over(w) == F.count(F.lit(1)).over(w)
    total = F.when(known, F.sum("_n").over(w))
    return sums.select(by, stratum, safe_div("_n", total).alias("proportion"))


def reallocate(
    unspecified: DataFrame,
    shares: DataFrame,
    cell: Sequence[str] = ("Year", "Age"),
    by: str = "Year",
    stratum: str = "Subtype",
    measure: str = "Count",
    keep_parts: bool = False,
) -> DataFrame:
    """Largest-remainder split of each cell's unspecified count over the shares.

    Every stratum gets the floor of ``n * proportion``; the units still missing
    from ``n`` go one each to the largest fractions, ties in stratum order, so
    the parts are integers and add up to ``n``.  Of a count with a fraction the
    same formula is taken: as many units as fit into the remainder go out.  Parts
    have the type of the count.  Cells are aggregated to one row first, so a window partition holds at most one row per target stratum.
    """
    cells = unspecified.groupBy(*cell).agg(strict_sum(measure).alias("n"))
    raw = F.col("n") * F.col("proportion")
    parts = (
        cells.join(shares, by)
        .withColumn("raw", raw)
        .withColumn("floor_val", F.floor("raw").cast("double"))
        .withColumn("decimal", F.col("raw") - F.col("floor_val"))
    )
    w = Window.partitionBy(*cell)
    by_fraction = w.orderBy(F.col("decimal").desc(), F.col(stratum).asc())
    parts = parts.withColumn(
        "remainder", F.col("n") - F.sum("floor_val").over(w)
    ).withColumn("add_one", F.row_number().over(by_fraction) <= F.col("remainder"))
    kind = cells.schema["n"].dataType
    count = (F.col("floor_val") + F.col("add_one").cast("int")).cast(kind).alias(measure)
    kept = [*cell, stratum, count]
    if keep_parts:
        kept += ["n", "proportion", "raw", "remainder", "add_one"]
    return parts.select(*kept)


def shares_of_all(
    df: DataFrame,
    by: str = "Year",
    stratum: str = "Subtype",
    measure: str = "Count",
) -> DataFrame:
    """:func:`stratum_shares` of all strata, of which there may be millions: the total is a
    second aggregate joined back, not a window over the strata."""
    sums = df.groupBy(by, stratum).agg(strict_sum(measure).alias("_n"))
    totals = df.groupBy(by).agg(strict_sum(measure).alias("_total"))
    return sums.join(totals, by).select(by, stratum, safe_div("_n", "_total").alias("proportion"))


#: remainders are counted in so many buckets per cell
BUCKETS = 4096


def reallocate_many(
    unspecified: DataFrame,
    shares: DataFrame,
    cell: Sequence[str] = ("Year", "Age"),
    by: str = "Year",
    stratum: str = "Subtype",
    measure: str = "Count",
) -> DataFrame:
    """:func:`reallocate` for cells of any number of strata: (cell, stratum, measure).

    Which strata get one more unit is a selection, the strata of a cell with the largest
    fractions up to its remainder, and needs no sort of the cell.  A histogram of the
    fractions, counted map-side, finds the bucket in which the last unit falls: strata in
    higher buckets get a unit, those in lower ones none.  Only that bucket is ranked, by
    fraction and then stratum, and if all strata of a cell tie there, by a sort over ranges
    of rows whose places come from their positions on disk.
    """
    cells = unspecified.groupBy(*cell).agg(strict_sum(measure).alias("n"))
    raw = F.col("n") * F.col("proportion")
    parts = stage(
        cells.join(shares, by)
        .select(*cell, stratum, "n", F.floor(raw).cast("double").alias("_floor"), (raw - F.floor(raw).cast("double")).alias("_rest"))
        .withColumn("_bucket", F.coalesce(F.floor(F.col("_rest") * BUCKETS).cast("int"), F.lit(-1))),
        "parts",
    )
    # per cell and bucket: at most BUCKETS + 1 rows for a cell
    counted = parts.groupBy(*cell, "_bucket").agg(F.count(F.lit(1)).alias("_strata"), F.sum("_floor").alias("_floors"), F.first("n").alias("n"))
    whole = Window.partitionBy(*cell)
    higher = whole.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("n") - F.sum("_floors").over(whole)
    edge = (
        counted.select(
            *cell,
            "_bucket",
            "_strata",
            left.alias("_left"),
            F.coalesce(F.sum("_strata").over(higher), F.lit(0)).alias("_higher"),
        )
        .where(F.col("_higher") < F.col("_left"))
        .groupBy(*[F.col(c).alias(f"_{c}") for c in cell])
        .agg(F.min(F.struct("_bucket", "_higher", "_strata", "_left")).alias("_edge"))
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell])
    at = F.col("_edge._bucket")
    split = F.col("_edge._higher") + F.col("_edge._strata") > F.col("_edge._left")
    rows = parts.join(edge, same, "left").withColumns({
        "_more": F.coalesce(F.col("_bucket") >= at, F.lit(False)),
        "_ranked": F.coalesce((F.col("_bucket") == at) & split, F.lit(False)),
    })
    kept = [*cell, stratum, "n", "_floor", "_more"]
    tied = rows.where("_ranked").select(
        *cell, stratum, "n", "_floor", "_rest", F.col("_edge._higher").alias("_higher"), F.col("_edge._left").alias("_left")
    )
    order = [*cell, F.desc("_rest"), stratum]
    placed = with_places(stage(tied.orderBy(*order), "tied"), cell, "_place")
    chosen = placed.withColumn("_more", F.col("_higher") + F.col("_place") + 1 <= F.col("_left"))
    both = rows.where("NOT _ranked").select(*kept).unionByName(chosen.select(*kept))
    kind = cells.schema["n"].dataType
    count = (F.col("_floor") + F.col("_more").cast("int")).cast(kind).alias(measure)
    return both.select(*cell, stratum, count)


def append_reallocated(
    df: DataFrame, reallocated: DataFrame, stratum: str = "Subtype", blank: str = BLANK
) -> DataFrame:
    """Append by name (columns absent on one side are NULL) and drop rows without
    a stratum: roll-up levels and the unspecified rows just replaced."""
    return df.unionByName(reallocated, allowMissingColumns=True).where(
        F.col(stratum) != blank
    )


def unspecified_share(
    df: DataFrame,
    is_unspecified: Column,
    measure: str = "Count",
    all_cases: str = "ALLUterineCancers",
    cell: Sequence[str] = ("Year", "Age"),
    by: str = "Year",
) -> DataFrame:
    """Unspecified count as a percentage of all cases, per ``by``.

    The all-cases total is constant within a cell and only missing on appended
    rows, so carrying it forward there equals taking the cell's maximum: one
    aggregate with map-side combine instead of an ordered window.
    """
    per_cell = (
        df.groupBy(*cell)
        .agg(
            F.count(F.when(is_unspecified, F.lit(1))).alias("_rows"),
            lenient_sum(F.when(is_unspecified, F.col(measure))).alias("_count"),
            F.max(all_cases).alias("_all"),
        )
        .where(F.col("_rows") > 0)
    )
    per_year = per_cell.groupBy(by).agg(
        strict_sum("_count").alias(measure),
        strict_sum("_all").alias(all_cases),
    )
    return per_year.withColumn("prop", safe_div(measure, all_cases) * 100)
