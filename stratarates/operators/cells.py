"""Cells that can be added to: new events are merged into stored cells.

A sum that must be NULL if any input was NULL cannot be merged from sums alone: a partial
sum does not tell whether it skipped something.  A cell's state keeps three numbers per
measure: the sum of the known values, the rows, and the rows with a known value.  States are
merged by adding them up, in any order and grouping, with map-side combine, and only the end
decides what a missing value means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarates.sources.headers import quoted

ROWS = "cell_rows"
BATCH = "cell_batch"


def _sum(measure: str) -> str:
    return f"{measure}_sum"


def _known(measure: str) -> str:
    return f"{measure}_known"


def cell_states(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys, cell_rows, <measure>_sum and <measure>_known): the states of the cells of ``df``."""
    aggregates = [F.count(F.lit(1)).alias(ROWS)]
    for m in measures:
        value = F.col(quoted(m))
        aggregates += [F.coalesce(F.sum(value), F.lit(0)).alias(_sum(m)), F.count(value).alias(_known(m))]
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*aggregates)


def merged(states: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One state per cell from any number of them."""
    parts = [ROWS, *[name(m) for m in measures for name in (_sum, _known)]]
    sums = [F.sum(F.col(quoted(c))).alias(c) for c in parts]
    return states.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*sums)


def cell_values(states: DataFrame, keys: Sequence[str], measures: Sequence[str], strict: bool = True) -> DataFrame:
    """(keys, measures) of merged states.  Strict sums are NULL if any input was; lenient
    ones skip NULLs and are 0 over nothing but NULLs."""
    out = [F.col(quoted(k)) for k in keys]
    for m in measures:
        total = F.col(quoted(_sum(m)))
        out.append((F.when(F.col(quoted(_known(m))) == F.col(ROWS), total) if strict else total).alias(m))
    return states.select(*out)


def store_batch(df: DataFrame, path: str, batch: str, keys: Sequence[str], measures: Sequence[str]) -> None:
    """Add the events of ``df`` to the cells stored under ``path``.

    A batch is a folder of its own, so what is stored already is neither read nor written,
    and storing a batch again, after a failure or with corrected events, replaces it."""
    cell_states(df, keys, measures).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def stored_cells(spark: SparkSession, path: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One state per cell over all batches: reads cells, not events."""
    return merged(spark.read.parquet(path).drop(BATCH), keys, measures)


def compact(spark: SparkSession, path: str, into: str, keys: Sequence[str], measures: Sequence[str]) -> None:
    """Write one batch of all cells to the folder ``into``, so that many small batches need not be
    merged on each read.  ``path`` is left as it is."""
    stored_cells(spark, path, keys, measures).write.mode("overwrite").parquet(f"{into}/{BATCH}=all")
