"""Aggregates, division and predicates whose missing-data rule is explicit.

Spark's ``sum`` skips NULLs, ANSI division raises on zero and ``isin`` is NULL
on a NULL operand.  Rates need the opposite in each case: a missing cell must
make its sum missing, a zero denominator must give NULL and set membership
must always be true or false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once per row, however often ``body`` uses it.  Columns are
    formulas: without this, formulas that use others several times grow by powers."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL if any input is NULL, and 0 over no rows."""
    if isinstance(c, str):
        return F.expr(f"CASE WHEN count(`{c}`) = count(1) THEN coalesce(sum(`{c}`), 0) END")
    return F.when(F.count(c) == F.count(F.lit(1)), F.coalesce(F.sum(c), F.lit(0)))


def lenient_sum(c: Column | str) -> Column:
    """Sum over the non-NULL inputs, and 0 if there are none."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as DOUBLE, NULL on a zero or NULL denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def is_in(c: Column | str, values: Iterable) -> Column:
    """Membership that is false, not NULL, on a NULL operand."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def not_in(c: Column | str, values: Iterable) -> Column:
    """Negated membership that keeps NULL operands."""
    return ~is_in(c, values)


NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def to_number(c: Column | str) -> Column:
    """Text to DOUBLE; text that is no decimal number becomes NULL instead of an
    error.  A cast alone would read type suffixes such as ``5d`` as numbers."""
    text = as_col(c).cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
