"""Explicit schemas of the sheet exports.  Reads fail on a mismatch."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


_text, _int, _long, _double = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

INCIDENCE_COUNTS = _schema(
    i_d=_text,
    cancer_type=_text,
    sex=_text,
    age_grouping=_text,
    age_group_years=_text,
    year=_int,
    count_for_cancer_type=_long,
    total_count_for_uterine_cancer=_long,
)

MORTALITY_COUNTS = _schema(
    cancer_group_site=_text,
    sex=_text,
    data_type=_text,
    year=_int,
    age_group_years=_text,
    count=_long,
)

AAPC = _schema(Cohort=_text, AAPC=_text)


def trend_schema(modeled: str) -> T.StructType:
    """Result table of a trend fit; ``modeled`` names the fitted-rate column."""
    return T.StructType(
        [
            T.StructField("Cohort", _text),
            T.StructField("Year", _int),
            T.StructField("Joinpoint Location", _double),
            T.StructField(modeled, _double),
        ]
    )


def wide_text_schema(headers: list[str]) -> T.StructType:
    """A sheet whose headers are data (one column per sex and age): all text."""
    return T.StructType([T.StructField(h, _text) for h in headers])


def fraction_schema(period_columns: list[str]) -> T.StructType:
    return T.StructType(
        [T.StructField("Age", _text)] + [T.StructField(p, _double) for p in period_columns]
    )
