import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from stratarates.operators.trends import (
    CHANGE_POINT,
    MODELED_CORRECTED,
    MODELED_UNCORRECTED,
    aapc_label,
    attach_labels,
    change_points,
    chart_series,
    cohort_variant,
    label_anchors,
    label_rows,
    tidy_by_age,
    tidy_by_stratum,
)
from stratarates.plans.settings import LARGE_PANELS, OBSERVED_NAMES, SUBTYPE_ANCHORS
from stratarates.sources.schemas import trend_schema

MODELED = "Modeled ageadjustedrate"


@pytest.fixture(scope="module")
def results(spark):
    data = [
        (c, y, 2010.0 if y == 2010 else None, base + (y - 2001))
        for c, base in [
            ("Total / corrected for hyst", 30.0),
            ("Total / not corrected for hyst", 20.0),
            ("Clear cell / corrected for hyst", 1.0),
            ("Clear cell / not corrected for hyst", 0.5),
            ("Serous / corrected", 3.0),
            ("Serous / neither", 9.0),
        ]
        for y in (2001, 2005, 2010, 2020)
    ]
    return spark.createDataFrame(data, trend_schema(MODELED))


@pytest.fixture(scope="module")
def tidy(results):
    return tidy_by_stratum(results, (2001, 2020), {"Clear": "Clear cell"})


def test_only_endpoints_and_change_points_are_kept(tidy):
    assert tidy.count() == 6 * 3
    assert rows(tidy.select("Year").distinct()) == [(2001,), (2010,), (2020,)]
    assert tidy.columns == ["Year", CHANGE_POINT, MODELED, "Subtype", "corrected", "observed", "group"]


def test_cohort_names_are_parsed(tidy):
    got = rows(tidy.select("Subtype", "corrected", "group").distinct())
    assert ("Clear cell", MODELED_CORRECTED, f"Clear cell {MODELED_CORRECTED}") in got
    assert ("Serous", None, "Serous NA") in got
    assert len(got) == 6


def test_change_points(tidy):
    got = change_points(tidy, CHANGE_POINT, "corrected", "Joinpoints")
    assert rows(got.select("Year", "corrected").distinct()) == [(2010, "Joinpoints")]


def test_labels_and_anchors(spark, tidy):
    aapc = spark.createDataFrame(
        [("Total / corrected", "-1.2*"), ("Total / not corrected", "0.5"),
         ("Clear cell / corrected", "2*"), ("Clear cell / not corrected", "3"),
         ("Serous / corrected", "4")],
        "Cohort string, AAPC string",
    )
    labels = aapc.select(
        F.substring_index("Cohort", " /", 1).alias("Subtype"),
        cohort_variant("Cohort").alias("corrected"),
        aapc_label("AAPC").alias("label"),
    )
    placed = label_anchors(
        label_rows(attach_labels(tidy, labels, ["Subtype", "corrected"]), 2020),
        SUBTYPE_ANCHORS,
        MODELED,
    )
    got = {
        (s, v): (label, m, y)
        for s, v, label, m, y in rows(placed.select("Subtype", "corrected", "label", MODELED, "yaxis"))
    }
    near = pytest.approx
    assert got["Total", MODELED_CORRECTED] == ("APC=-1.20*", near(50.0), near(50.0))
    assert got["Total", MODELED_UNCORRECTED] == ("APC= 0.50 ", near(38.0), near(42.0))
    assert got["Clear cell", MODELED_CORRECTED] == ("APC= 2.00*", near(20.3), near(20.3))
    assert got["Clear cell", MODELED_UNCORRECTED] == ("APC= 3.00 ", near(19.2), near(19.7))
    assert got["Serous", MODELED_CORRECTED] == ("APC= 4.00 ", near(22.3), near(22.0))
    assert len(got) == 5


def test_label_rows_can_be_moved_left(tidy):
    assert set(values(label_rows(tidy, 2020, -0.5), "Year")) == {2019.5}


def test_age_cohorts(spark):
    data = [("25â€“34 - Total", 2001, None, 1.0), ("85+ - Total", 2007, 2007.0, 2.0),
            ("85+ - Total", 2008, None, 2.0)]
    df = spark.createDataFrame(data, trend_schema("Modeled agespecificrate"))
    got = tidy_by_age(df, (2001, 2020), " -")
    assert rows(got.select("Age", "observed", "Joinpoint")) == [
        ("25–34", "Modeled Trend", None), ("85+", "Modeled Trend", 2007.0),
    ]
    flagged = tidy_by_age(df, (2001, 2020), " -", flag="Joinpoint ")
    assert rows(flagged.select("Age", "Joinpoint")) == [("25–34", None), ("85+", "Joinpoint ")]


def test_chart_series(spark):
    df = spark.createDataFrame(
        [("corrected for hyst", "Total", 1.0), ("not corrected for hyst", "Endometrioid", 2.0),
         ("corrected for hyst", "Other", 3.0)],
        "corrected string, Subtype string, ageadjustedrate double",
    )
    got = chart_series(df, OBSERVED_NAMES, LARGE_PANELS)
    assert rows(got) == [
        ("Observed hysterectomy-corrected rate", "Total", 1.0, "Observed Rate", 1),
        ("Observed hysterectomy-uncorrected rate", "Endometrioid", 2.0, "Observed Rate", 2),
    ]
