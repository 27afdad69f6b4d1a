"""Small tables written down in code (band maps, code maps, periods)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def literal_table(
    spark: SparkSession, fields: Sequence[tuple[str, pa.DataType]], rows: Sequence[tuple]
) -> DataFrame:
    """A local relation.  Its exact size is known to Catalyst, so a join with it
    is a broadcast join because the size was checked, not because of a hint."""
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), type=t) for c, (_, t) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[n for n, _ in fields]))
