"""Sheets exported as CSV, and their clean-up."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarates.functions.nulls import not_in, to_number
from stratarates.sources.headers import quoted

# Labels of the metadata rows below the header of a statistical
# time-series sheet.
METADATA_ROWS = (
    "Unit",
    "Series Type",
    "Data Type",
    "Frequency",
    "Collection Month",
    "Series Start",
    "Series End",
    "No. Obs",
    "Series ID",
)


def read_sheet(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    skip: int = 0,
    header: str | None = None,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Scan exported sheets (one file or a folder of them).

    Without a preamble this is the plain CSV scan: splittable, column-pruned,
    headers validated against ``schema``.  A schema may name blank and repeated
    headers by their place, as ``...1`` and ``x...7``.  With ``skip`` preamble lines
    :func:`body_lines` finds the table below them, in files that are split like any other
    text.  The line after the preamble must be ``header`` (default: the schema's
    names), else the read fails.  So does a malformed line, unless ``mode`` is
    ``PERMISSIVE``: notes below a table then become rows of NULLs, which the
    row filters of the analyses drop.  A file without any line gives no rows.
    """
    if skip == 0:
        mended = any(re.search(r"\.\.\.[0-9]+$", name) for name in schema.names)
        if mended:
            _check_header(spark, path, schema)
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", mended)
            .option("nullValue", "NA")
            .option("mode", mode)
            .csv(path)
        )
    lines = body_lines(spark, path, skip, header or ",".join(schema.names))
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    options = {"mode": mode, "nullValue": "NA"}
    row = F.from_csv("line", ddl, options).alias("row")
    return lines.where(F.trim("line") != "").select(row).select("row.*")


#: files up to which the list of their first blocks is broadcast: about 30 MB
BROADCAST_FILES = 100_000


def body_lines(spark: SparkSession, path: str, skip: int, header: str) -> DataFrame:
    """The lines below ``skip`` preamble lines and a header line, of each file under ``path``.

    A text scan does not tell a line's place in its file, only its block (file, start,
    length).  Within a task row numbers grow from line to line, so a line's place in its block is
    its number less the block's least one, and a block's first place in its file is the sum
    of the lines of earlier blocks: one aggregate over the lines, one row per block.  Only blocks
    that reach into the preamble, about one per file, are joined back, so the second pass
    is a filter over a splittable scan.

    Both passes must cut the files alike.  Should the session's parallelism have changed
    in between, the first block of a file is not found again, which is an error.
    """
    text = spark.read.text(path)
    files = len(text.inputFiles())
    lines = text.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"),
        F.monotonically_increasing_id().alias("_id"),
    )
    block = ["_file", "_start", "_length"]
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*block).agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_lines"))
    placed = blocks.select(
        *block,
        (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_least")).alias("_shift"),
        (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) <= skip).alias("_early"),
        F.sum("_lines").over(Window.partitionBy("_file")).alias("_all"),
    )
    ends = F.raise_error(F.concat(F.lit("unexpected header: (the file ends before it) in "), "_file"))
    first = placed.where("_early").select(
        *block, F.when(F.col("_all") > skip, F.col("_shift")).otherwise(ends).alias("_shift")
    )
    if files <= BROADCAST_FILES:
        first = F.broadcast(first)
    found = F.replace("line", F.lit('"'), F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("unexpected header: "), found, F.lit(" in "), "_file"))
    apart = F.raise_error(F.concat(F.lit("cut into other blocks than in the first pass: "), "_file"))
    place = F.col("_id") + F.col("_shift")
    below = (
        F.when(F.col("_shift").isNull(), F.when(F.col("_start") > 0, True).otherwise(apart.cast("boolean")))
        .when(place == skip, F.when(found == header, False).otherwise(wrong.cast("boolean")))
        .otherwise(place > skip)
    )
    # a line above the table is no line, so that no filter on parsed rows can meet it first
    return lines.join(first, block, "left").select(F.when(below, F.col("line")).alias("line")).where("line IS NOT NULL")


def mended_headers(headers: Sequence[str]) -> list[str]:
    """Blank headers named by their place (``...1``), repeated ones with it (``x...7``)."""
    return [
        name if name and headers.count(name) == 1 else f"{name}...{place}"
        for place, name in enumerate(headers, 1)
    ]


def _check_header(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """The scan compares headers as they stand, so mended ones are compared here:
    the first line of each file, one row per file."""
    first = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = first.where("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("line"))
    for row in lines.toLocalIterator():
        found = mended_headers(next(csv.reader([row["line"]]), []))
        if found != schema.names:
            raise ValueError(f"unexpected header in {row['file_path']}: {found}, not {schema.names}")


def drop_metadata_rows(
    df: DataFrame, label_column: str, labels: Sequence[str] = METADATA_ROWS
) -> DataFrame:
    """Remove the metadata rows wherever they stand in the sheet."""
    return df.where(not_in(df[quoted(label_column)], labels))


def cast_all_strings(df: DataFrame) -> DataFrame:
    """Every text column to DOUBLE; text that is no number becomes NULL."""
    return df.select(
        *[
            to_number(df[quoted(f.name)]).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else df[quoted(f.name)]
            for f in df.schema.fields
        ]
    )
