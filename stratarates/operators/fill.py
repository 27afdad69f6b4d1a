"""Last observation carried forward, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarates.sources.headers import quoted
from stratarates.sources.places import with_file
from stratarates.sources.staging import stage


def fill_forward(
    df: DataFrame, group: Sequence[str], order: str, value: str, blocks: int | None = None
) -> DataFrame:
    """Replace a NULL ``value`` by the last non-NULL one before it in its group.

    ``order`` is any column that can be sorted, not NULL and unique within a group.  Groups
    may be arbitrarily large: the rows are sorted by (group, order) in ``blocks`` ranges
    (default: the session's shuffle partitions) and staged, so a large group lies in several
    files.  Each file hands on one row per group, its last known value; what earlier files
    know enters the rows of a file as a leading row.

    The input is read once, to be sorted.  The staged rows are read twice: their group
    and value for the files' last values, and the whole rows for the result, which are
    shuffled by (group, file).  No quantiles are taken.
    """
    keys = [F.col(quoted(c)) for c in group]
    by = [*keys, F.col(quoted(order))]
    ranges = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
    rows = with_file(stage(ranges.sortWithinPartitions(*by), "fill"))

    known = F.max_by(quoted(value), F.when(F.col(quoted(value)).isNotNull(), F.col("_at")))
    earlier = Window.partitionBy(*keys).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, "_file")
        .agg(known.alias("_last"))
        .select(
            *keys,
            "_file",
            F.lit(-1).cast("long").alias("_at"),
            F.last("_last", ignorenulls=True).over(earlier).alias(value),
        )
        .where(F.col(quoted(value)).isNotNull())
    )
    so_far = (
        Window.partitionBy(*keys, "_file")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .withColumn(value, F.last(F.col(quoted(value)), ignorenulls=True).over(so_far))
        .where("_at >= 0")
        .select(*[F.col(quoted(c)) for c in df.columns])
    )
