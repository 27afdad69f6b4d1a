"""Row numbers from positions in staged files: no task sees more than its share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarates.sources.headers import quoted


def with_file(rows: DataFrame, file: str = "_file", at: str = "_at") -> DataFrame:
    """``rows``, read straight from a staged table, with the number of their file among
    the files written and their position in it."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return rows.select("*", number.alias(file), F.col("_metadata.row_index").alias(at))


def with_places(
    rows: DataFrame,
    group: Sequence[str] = (),
    place: str = "place",
    size: str | None = None,
    file: str | None = None,
) -> DataFrame:
    """``rows`` with each row's place in its group, from 0, the group's ``size`` and the
    number of the row's ``file``.

    ``rows`` is read straight from a staged table whose files hold the rows of a group without
    a gap, in the wanted order: rows sorted globally, or within their partitions.  A
    row's place is its position in its file plus the group's rows in earlier files, so
    what is summed up in order is one row per file and group.  NULL keys are a group.
    """
    keys = [F.col(quoted(c)) for c in group]
    placed = with_file(rows)
    named = [key.alias(f"_key{n}") for n, key in enumerate(keys)]
    whole = Window.partitionBy(*[f"_key{n}" for n in range(len(keys))])
    earlier = whole.orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy(F.col("_file").alias("_number"), *named)
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"))
        .withColumn("_size", F.sum("_rows").over(whole))
        .drop("_first", "_rows")
    )
    same = F.col("_file") == F.col("_number")
    for n, key in enumerate(keys):
        same &= key.eqNullSafe(F.col(f"_key{n}"))
    out = [*[F.col(quoted(c)) for c in rows.columns], (F.col("_at") + F.col("_shift")).alias(place)]
    if size:
        out.append(F.col("_size").alias(size))
    if file:
        out.append(F.col("_file").alias(file))
    return placed.join(runs, same).select(*out)
