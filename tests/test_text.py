import decimal
import random

import pytest
from helpers import values
from pyspark.sql import functions as F

from stratarates.functions.dates import (
    date_to_serial,
    in_years,
    serial_to_date,
    serial_to_year,
)
from stratarates.functions.text import (
    before,
    fixed_decimals,
    hyphen_to_en_dash,
    mend_en_dash,
    round_half_even,
    short_decimals,
)
from stratarates.operators.trends import (
    aapc_label,
    aapc_label_short,
    with_padded_aapc_label,
)


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "x, want",
    [(0.125, 0.12), (0.375, 0.38), (2.675, 2.67), (-0.125, -0.12), (1.005, 1.0), (3.0, 3.0)],
)
def test_round_goes_to_the_nearer_decimal_and_ties_to_even(spark, x, want):
    assert one(spark, round_half_even(F.lit(x), 2)) == want


def exact(x, digits):
    step = decimal.Decimal(1).scaleb(-digits)
    return float(decimal.Decimal(x).quantize(step, decimal.ROUND_HALF_EVEN, decimal.Context(prec=400)))


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 7, 12])
def test_rounding_equals_that_of_the_exact_expansion(spark, digits):
    rng = random.Random(digits)
    step = 10.0**-digits
    numbers = [k * step + half * step / 2 for k in range(-60, 60) for half in (0, 1)]
    numbers += [n / 2**k for n in range(-40, 41) for k in (1, 2, 3, 4, 9)]
    numbers += [2.0**k * s for k in range(-60, 70) for s in (1, 1 - 2**-53, 1 + 2**-52)]
    numbers += [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-15, 9) for _ in range(4000)]
    numbers += [0.0, 5e-324, 1e308, 2.0**53 - 0.5, 4503599627370495.5, 0.285, 1.115, 5.015, 1.005, 2.675]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for r in df.select("x", round_half_even("x", digits).alias("v")).collect():
        assert r["v"] == exact(r["x"], digits), r


def test_rounding_of_no_numbers(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert repr(values(df.select(round_half_even("x", 2).alias("v")), "v")) == "[None, nan, inf, -inf]"
    with pytest.raises(ValueError):
        round_half_even("x", 13)


def test_number_texts(spark):
    df = spark.createDataFrame([(1.2,), (10.0,), (-0.001,), (1234.567,), (None,)], "x double")
    assert values(df.select(fixed_decimals("x", 2).alias("v")), "v") == [
        "1.20", "10.00", "0.00", "1234.57", None,
    ]
    assert values(df.select(short_decimals("x", 2).alias("v")), "v") == [
        "1.2", "10", "0", "1234.57", None,
    ]


def test_dashes(spark):
    assert one(spark, hyphen_to_en_dash(F.lit("25-29"))) == "25–29"
    assert one(spark, mend_en_dash(F.lit("25â€“34"))) == "25–34"


def test_text_before_a_separator(spark):
    assert one(spark, before(F.lit("Clear cell / corrected / x"), " /")) == "Clear cell"
    assert one(spark, before(F.lit("85+"), " -")) == "85+"


def test_serials(spark):
    assert one(spark, serial_to_year(F.lit(37043.0))) == 2001
    assert str(one(spark, serial_to_date(F.lit(37043)))) == "2001-06-01"
    assert one(spark, date_to_serial(F.to_date(F.lit("2001-06-01")))) == 37043


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("-1.2*",), ("0.5",), ("10",), (None,)], "AAPC string")


def test_aapc_label(labels):
    got = values(labels.select(aapc_label("AAPC").alias("v")), "v")
    assert got == ["APC=-1.20*", "APC= 0.50 ", "APC= 10.00 ", None]


def test_padded_aapc_label(labels):
    assert values(with_padded_aapc_label(labels), "label") == [
        "-1.20 *", " 0.50 ", "10.00 ", None,
    ]


def test_short_aapc_label(labels):
    got = values(labels.select(aapc_label_short("AAPC").alias("v")), "v")
    assert got == ["-1.2 *", "0.5  ", "10  ", None]


def test_labels_make_each_step_once(spark, labels):
    """Formulas that repeat others grow by powers, and so does the time of a row."""
    made = [labels.select(aapc_label("AAPC").alias("v")), labels.select(aapc_label_short("AAPC").alias("v")),
            labels.select(fixed_decimals(F.col("AAPC").cast("double"), 2).alias("v"))]
    for df in made:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("LOG2(") == 1


def test_years_as_a_range(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'1995-12-31 23:59:59'), (timestamp_ntz'1996-01-01'),"
        " (timestamp_ntz'1997-12-31 23:59:59.9'), (timestamp_ntz'1998-01-01'), (null) AS t(x)"
    )
    kept = df.where(in_years("x", 1996, 1997)).select(F.year("x").alias("y"))
    assert values(kept, "y") == [1996, 1997]
