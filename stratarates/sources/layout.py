"""Tables laid out by date, so that cuts by year or day read only what they keep.

A year filter on a timestamp column reaches the Parquet scan but skips nothing if rows
lie in any order, and year() over a column does not even reach it.  A laid-out table has
one folder per year and, within a folder, files whose rows ascend by day, with the day in
a DATE column of its own: a cut prunes folders by their name and row groups by their least and
greatest day.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarates.sources.headers import quoted

YEAR, DAY = "layout_year", "layout_day"


def write_by_date(df: DataFrame, path: str, date: str, then: Sequence[str] = (), files: int | None = None) -> None:
    """Write ``df`` to ``path`` by year and day of its ``date`` column.

    Rows are dealt out by ranges of (day, a hash of the row), so a day with a third of all
    rows fills several files; ``then`` orders the rows of a day further.  ``files`` is the
    number of ranges (default: the session's shuffle partitions).  A range mostly lies within
    one year, so there are about as many files as ranges.  Rows without a date have a
    folder of their own.
    """
    dated = df.withColumn(DAY, df[quoted(date)].cast("date")).withColumn(YEAR, F.year(DAY))
    spread = F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
    ranges = [YEAR, DAY, spread]
    parted = dated.repartitionByRange(files, *ranges) if files else dated.repartitionByRange(*ranges)
    ordered = parted.sortWithinPartitions(YEAR, DAY, *[F.col(quoted(c)) for c in then])
    ordered.write.mode("overwrite").partitionBy(YEAR).parquet(path)


def read_by_date(
    spark: SparkSession,
    path: str,
    start: datetime.date | None = None,
    end: datetime.date | None = None,
) -> DataFrame:
    """Rows of a laid-out table from ``start`` to before ``end``; without a cut all rows,
    those without a date included."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (YEAR, DAY)]
    if start is not None:
        rows = rows.where((F.col(YEAR) >= start.year) & (F.col(DAY) >= F.lit(start)))
    if end is not None:
        last = end - datetime.timedelta(days=1)
        rows = rows.where((F.col(YEAR) <= last.year) & (F.col(DAY) < F.lit(end)))
    return rows.select(*[F.col(quoted(c)) for c in columns])


def read_years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows of the years ``first`` to ``last``: folders alone decide."""
    return read_by_date(spark, path, datetime.date(first, 1, 1), datetime.date(last + 1, 1, 1))
