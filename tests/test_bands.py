import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from stratarates.operators.bands import (
    band_of,
    cross_years,
    period_fractions,
    rollup_long,
    rollup_wide,
    unit_members,
)
from stratarates.operators.reshape import (
    lengthen,
    lengthen_by_pattern,
    widen,
)
from stratarates.plans.populations import population_bands, population_bands_long
from stratarates.plans.settings import (
    AGE_BANDS,
    AGE_UNITS,
    HISTOLOGY_STRATA,
    INCIDENCE,
    MORTALITY_COUNT_BANDS,
)
from stratarates.sources.sheets import METADATA_ROWS

BANDS = {"x": ("a", "b"), "y": ("c",)}


def test_rollup_is_null_without_every_member(spark):
    df = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (2, "c", None), (3, "a", 1),
         (3, "a", 1), (1, "other", 9)],
        "Year int, Age string, n int",
    )
    assert rows(rollup_long(df, ["Year"], "Age", BANDS, ["n"])) == [
        (1, "x", 3), (1, "y", 3),
        (2, "x", None), (2, "y", None),
        (3, "x", None), (3, "y", None),  # one member lost, one doubled
    ]


def test_a_lost_and_a_doubled_member_do_not_make_a_band(spark):
    df = spark.createDataFrame(
        [(2001, "a", 1), (2001, "a", 10), (2002, "a", 1), (2002, "b", 10), (2003, "a", 1), (2003, "b", 2),
         (2003, "b", None), (2003, "c", 5)],
        "Year int, Age string, n int",
    )
    assert rows(rollup_long(df, ["Year"], "Age", BANDS, ["n"])) == [
        (2001, "x", None), (2001, "y", None), (2002, "x", 11), (2002, "y", None),
        (2003, "x", None), (2003, "y", 5),  # a doubled member counts, even a NULL one
    ]


def test_bands_of_more_members_than_a_word_has_bits(spark):
    wide = {"all": tuple(range(150)), "rest": (150,)}
    full = [(1, u, u) for u in range(151)]
    lost = [(2, u if u != 100 else 99, u) for u in range(151)]
    df = spark.createDataFrame(full + lost, "k int, u int, n int").repartition(5)
    assert rows(rollup_long(df, ["k"], "u", wide, ["n"])) == [
        (1, "all", sum(range(150))), (1, "rest", 150), (2, "all", None), (2, "rest", 150)]


def test_rollup_is_one_aggregation_without_distinct(spark):
    df = spark.range(10).selectExpr("id % 4 AS k", "CAST(id % 3 AS INT) AS u", "id AS n")
    plan = plan_of(rollup_long(df, ["k"], "u", {"x": (0, 1), "y": (2,)}, ["n"]))
    assert plan.count("Exchange") == 1 and "Expand" not in plan and "distinct" not in plan


def test_wide_and_long_rollup_agree(spark):
    wide = spark.createDataFrame([(1, 1, 2, 3), (2, 1, None, 3)], "Year int, a int, b int, c int")
    long = lengthen(wide, ["Year"], ["a", "b", "c"], "Age", "n")
    got = rows(rollup_wide(wide, ["Year"], BANDS, "n"))
    assert got == [(1, "x", 3), (1, "y", 3), (2, "x", None), (2, "y", 3)]
    assert rows(rollup_long(long, ["Year"], "Age", BANDS, ["n"])) == got


def test_band_of_a_unit(spark):
    members = unit_members([0, 15, 25], last_unit=100, open_end=True)
    assert list(members) == ["0–14", "15–24", "25+"]
    df = spark.range(-1, 102).withColumn("u", F.col("id").cast("int"))
    banded = df.withColumn("band", band_of("u", members)).groupBy("band").count()
    assert dict(rows(banded)) == {"0–14": 15, "15–24": 10, "25+": 76, None: 2}


def test_age_bands_cover_all_ages_once():
    units = [u for m in AGE_UNITS.values() for u in m]
    assert units == list(range(101))
    assert len(AGE_UNITS) == 15 and len(AGE_BANDS) == 9
    assert AGE_BANDS["25–34"] == ("25–29", "30–34") and AGE_BANDS["85+"] == ("85+",)
    assert MORTALITY_COUNT_BANDS["85+"] == ("85–89", "90+")
    assert len(MORTALITY_COUNT_BANDS) == 7


def test_code_map_size():
    sizes = {label: len(codes) for label, codes in HISTOLOGY_STRATA.items()}
    assert sizes == {
        "Endometrioid": 14, "Serous": 4, "Clear cell": 1, "Carcinosarcoma": 4,
        "Sarcoma": 27, "Other": 32,
    }
    assert len({c for codes in HISTOLOGY_STRATA.values() for c in codes}) == 82


def test_period_fractions_recode_the_open_band(spark):
    df = spark.createDataFrame([("80–84", 0.5, 0.6), ("90+", 0.7, 0.8)], "Age string, p double, q double")
    periods = {"p": (2001, 2001), "q": (2002, 2003)}
    got = rows(period_fractions(df, periods, (2001, 2004), {"90+": "85+"}), "Age", "Year")
    assert got == [
        (2001, "80–84", 0.5), (2002, "80–84", 0.6), (2003, "80–84", 0.6), (2004, "80–84", None),
        (2001, "85+", 0.7), (2002, "85+", 0.8), (2003, "85+", 0.8), (2004, "85+", None),
    ]


def test_cross_years(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert rows(cross_years(df, 1, 2)) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_pivot_names_and_absent_cells(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 2.0), (1, "b", 3, 4.0), (2, "a", 5, 6.0)], "Year int, Age string, n int, m double"
    )
    one = widen(df, ["Year"], "Age", ["a", "b"], "n", prefix="Age")
    assert one.columns == ["Year", "Agea", "Ageb"]
    assert rows(one) == [(1, 1, 3), (2, 5, None)]
    two = widen(df, ["Year"], "Age", ["a", "b"], ["n", "m"])
    assert two.columns == ["Year", "n_a", "n_b", "m_a", "m_b"]
    back = lengthen_by_pattern(two, ["Year"], two.columns[1:], "(.*)_(.*)", "Age")
    assert rows(back) == [(1, "a", 1, 2.0), (1, "b", 3, 4.0), (2, "a", 5, 6.0), (2, "b", None, None)]


def sheet(spark, years, missing=None):
    """A population sheet of all single ages, age a in year y counting 10y + a."""
    names = ["...1"]
    for sex in ("Male", "Female"):
        names += [
            f"Estimated Resident Population ;  {sex} ;  {a if a < 100 else '100 and over'} ;"
            for a in range(101)
        ]
    serial = {2000: "36678", 2001: "37043", 2002: "37408"}
    body = [
        (serial[y], *["1"] * 101, *[None if a == missing else str(10 * y + a) for a in range(101)])
        for y in years
    ]
    top = [(label, *["x"] * 202) for label in METADATA_ROWS]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(top + body, schema)


def test_population_sheet_to_bands(spark):
    got = population_bands(sheet(spark, [2000, 2001, 2002]), INCIDENCE)
    by_key = {(y, a): p for y, a, p in rows(got)}
    assert len(by_key) == 2 * 15
    assert by_key[2001, "0–14"] == sum(20010 + a for a in range(15))
    assert by_key[2002, "85+"] == sum(20020 + a for a in range(85, 101))
    singles = spark.createDataFrame(
        [(y, a, float(10 * y + a)) for y in (2000, 2001, 2002) for a in range(101)],
        "Year int, unit_age int, pop double",
    )
    assert rows(population_bands_long(singles, INCIDENCE)) == rows(got)


def test_population_band_with_a_missing_age_is_null(spark):
    got = population_bands(sheet(spark, [2001], missing=27), INCIDENCE)
    missing = [a for _, a, p in rows(got) if p is None]
    assert missing == ["25–29"]


@pytest.mark.parametrize("order", [1, -1])
def test_rollup_does_not_depend_on_row_order(spark, order):
    data = [(1, "a", 1), (1, "b", 2), (1, "c", 3)][::order]
    df = spark.createDataFrame(data, "Year int, Age string, n int")
    assert rows(rollup_long(df, ["Year"], "Age", BANDS, ["n"])) == [(1, "x", 3), (1, "y", 3)]
