"""Spreadsheet date serials."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratarates.functions.nulls import as_col

# Day 0 of the 1900 date system for serials after its phantom 29 February 1900.
SERIAL_EPOCH = "1899-12-30"


def serial_to_date(c: Column | str) -> Column:
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(as_col(c)).cast("int"))


def serial_to_year(c: Column | str) -> Column:
    return F.year(serial_to_date(c))


def date_to_serial(c: Column | str) -> Column:
    return F.datediff(as_col(c), F.lit(SERIAL_EPOCH).cast("date"))


def in_years(c: Column | str, first: int, last: int) -> Column:
    """``year(c) BETWEEN first AND last`` as a range over the bare column, which
    reaches the Parquet scan and skips row groups; ``year()`` would not."""
    c = as_col(c)
    start, end = datetime.date(first, 1, 1), datetime.date(last + 1, 1, 1)
    return (c >= F.lit(start)) & (c < F.lit(end))
