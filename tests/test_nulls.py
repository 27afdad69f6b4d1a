import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from stratarates.functions.nulls import (
    lenient_sum,
    not_in,
    safe_div,
    strict_sum,
    to_number,
)


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(
        [("full", 1), ("full", 2), ("gap", 3), ("gap", None), ("none", None)], "g string, x int"
    )


def test_strict_sum_is_null_on_a_gap(groups):
    got = groups.groupBy("g").agg(strict_sum("x"), strict_sum(F.col("x")))
    assert rows(got) == [("full", 3, 3), ("gap", None, None), ("none", None, None)]


def test_strict_sum_of_nothing_is_zero(groups):
    assert rows(groups.where("false").agg(strict_sum("x"), strict_sum(F.col("x")))) == [(0, 0)]


def test_lenient_sum_skips_gaps(groups):
    got = groups.groupBy("g").agg(lenient_sum("x"))
    assert rows(got) == [("full", 3), ("gap", 3), ("none", 0)]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert values(df.select(safe_div("a", "b").alias("q")), "q") == [None, None, 0.25]


def test_negated_membership_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert rows(df.where(not_in("x", ["a"]))) == [("b",), (None,)]


def test_only_decimal_numbers_are_numbers(spark):
    texts = ["5d", "12f", "3D", "1e3", " 7 ", "0x1A", "1.", ".5", "+2", "1 2", "", "-", "%"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(to_number("x")).collect()]
    assert got == [None, None, None, 1000.0, 7.0, None, 1.0, 0.5, 2.0, None, None, None, None]


def test_text_that_is_no_number_becomes_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("-2",)], "x string")
    assert values(df.select(to_number("x").alias("n")), "n") == [1.5, None, None, -2.0]
