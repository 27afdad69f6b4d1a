"""Codes to strata and label recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratarates.functions.nulls import as_col
from stratarates.sources.headers import quoted
from stratarates.sources.literals import literal_table

TOTAL = "Total"
BLANK = " "


def classify(
    df: DataFrame,
    code: str,
    strata: Mapping[str, Sequence[str]],
    into: str = "Subtype",
    total: str = TOTAL,
    default: str = BLANK,
) -> DataFrame:
    """Add the stratum of each code: NULL code -> ``total`` (the published total
    row), unlisted code -> ``default``.

    The map is a local relation, so the lookup is a broadcast hash join whatever
    the size of ``df`` and the number of codes.
    """
    rows = [(c, label) for label, codes in strata.items() for c in codes]
    if len({c for c, _ in rows}) != len(rows):
        raise ValueError("a code is listed under two strata")
    lookup = literal_table(
        df.sparkSession, [("_code", pa.string()), ("_label", pa.string())], rows
    )
    code_col = df[quoted(code)]
    return (
        df.join(lookup, code_col == lookup["_code"], "left")
        .withColumn(
            into,
            F.when(code_col.isNull(), total).otherwise(F.coalesce("_label", F.lit(default))),
        )
        .drop("_code", "_label")
    )


def recode(
    c: Column | str, labels: Mapping[str, str], keep_others: bool = True
) -> Column:
    """Replace listed labels; others stay, or become NULL."""
    c = as_col(c)
    out = c if keep_others else F.lit(None).cast("string")
    for old, new in labels.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def split_in_two(c: Column | str, low: Sequence[str], low_name: str, high_name: str) -> Column:
    """``low_name`` for the listed labels, ``high_name`` for all others."""
    return F.when(as_col(c).isin(list(low)), low_name).otherwise(high_name)


def label_rank(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based place in a custom label order; 0 for a label not listed."""
    return F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c)).cast("int")
