"""Indexed CSV export of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarates.sources.headers import quoted
from stratarates.sources.places import with_file, with_places
from stratarates.sources.staging import stage

DIGITS = 15


def with_row_index(
    df: DataFrame, order_by: Sequence[Column | str], name: str = "row"
) -> DataFrame:
    """Number the rows 1..n in export order; ``order_by`` must be a total order.

    The rows are sorted once, by ranges, and staged; their numbers come from their positions
    on disk, so they never meet in one task.
    """
    placed = with_places(stage(df.orderBy(*order_by), "ordered"), place="_place")
    return placed.select((F.col("_place") + 1).alias(name), *[F.col(quoted(c)) for c in df.columns])


def quoted_text(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def number_text(c: Column) -> Column:
    """A DOUBLE as text with up to 15 significant digits: ``2.5``, ``3``, ``1e+05``; in
    decimal notation, with all digits before the point, unless scientific notation is shorter."""
    text = F.format_string(f"%.{DIGITS - 1}e", F.abs(c))
    digits = F.rtrim(F.replace(F.substring_index(text, "e", 1), F.lit(".")), F.lit("0"))
    digits = F.when(digits == "", "0").otherwise(digits)
    exponent = F.substring_index(text, "e", -1).try_cast("int")
    n = F.length(digits)
    size = F.abs(exponent)
    scientific = F.concat(
        F.substring(digits, 1, 1),
        F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, DIGITS))).otherwise(""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(size.cast("string"), F.greatest(F.lit(2), F.length(size.cast("string"))), F.lit("0")),
    )
    behind = F.substr(digits, exponent + 2)
    fixed = F.when(
        exponent >= 0,
        F.concat(
            F.rpad(F.substr(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")),
            F.when(n > exponent + 1, F.concat(F.lit("."), behind)).otherwise(""),
        ),
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), size - 1), digits))
    # whole numbers of more digits show them all
    fixed = F.when(exponent < DIGITS, fixed).when(F.abs(c) < 2.0**63, F.abs(c).cast("bigint").cast("string"))
    shorter = F.when(F.length(fixed) <= F.length(scientific), fixed).otherwise(scientific)
    sign = F.when(c < 0, "-").otherwise("")
    return (
        F.when(c.isNull(), F.lit(None))
        .when(F.isnan(c), "NaN")
        .when(F.abs(c) == float("inf"), F.concat(sign, F.lit("Inf")))
        .otherwise(F.concat(sign, shorter))
    )


def field_text(c: Column, kind: T.DataType) -> Column:
    """A value as a field: texts quoted, with doubled quotes, numbers and dates bare, booleans
    as ``TRUE`` and ``FALSE``, NULL as a bare ``NA``; an empty text is ``""``."""
    if isinstance(kind, T.StringType):
        text = quoted_text(c)
    elif isinstance(kind, T.DoubleType):
        text = number_text(c)
    elif isinstance(kind, T.FloatType):
        text = number_text(c.cast("string").cast("double"))
    elif isinstance(kind, T.BooleanType):
        text = F.upper(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NA"))


def csv_line(df: DataFrame, index: str, columns: Sequence[str]) -> Column:
    """The ``columns`` of a row as a CSV line that begins with the quoted row number."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [field_text(F.col(quoted(c)), kinds[c]) for c in columns]
    return F.concat_ws(",", quoted_text(F.col(quoted(index)).cast("string")), *fields)


def header_line(columns: Sequence[str]) -> str:
    return ",".join('"' + name.replace('"', '""') + '"' for name in ["", *columns])


def write_indexed_csv(df: DataFrame, path: str, order_by: Sequence[Column | str]) -> None:
    """Write a result table as CSV: ordered, numbered from 1 in a column without a
    name, texts and row numbers quoted, NULL as a bare ``NA``, a header in each file.

    The rows are sorted once.  A staged file becomes a part file: its rows go to the task
    of its number as they are, so part files in name order hold the table in row order
    whatever its size.
    """
    spark = df.sparkSession
    ordered = stage(df.orderBy(*order_by), "ordered")
    parts = max(1, len(ordered.inputFiles()))
    placed = with_places(ordered, place="_place", file="_part").withColumn("_row", F.col("_place") + 1)
    lines = placed.select("_part", "_row", csv_line(placed, "_row", df.columns).alias("value"))
    tops = spark.range(parts).select(
        F.col("id").alias("_part"), F.lit(0).cast("long").alias("_row"), F.lit(header_line(df.columns)).alias("value")
    )
    dealt = lines.unionByName(tops).repartitionById(parts, F.col("_part").cast("int"))
    dealt.sortWithinPartitions("_row").select("value").write.mode("overwrite").text(path)
    _end_in_csv(spark, path)


def _end_in_csv(spark: SparkSession, path: str) -> None:
    """Name the part files as CSV.  They are written as plain text, since Spark's CSV writer
    would quote the lines again; one rename per file."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            system.rename(status.getPath(), context._jvm.org.apache.hadoop.fs.Path(path, name[:-4] + ".csv"))
