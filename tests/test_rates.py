"""Formulas, and the identities that follow from them, on small tables."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stratarates.operators.extracts import append_standardised, append_standardised_long
from stratarates.operators.rates import (
    INCIDENCE_VARIANTS,
    MORTALITY_VARIANTS,
    age_specific_rates,
    exposed_population,
    reference_totals,
    standard,
    standardised_rates,
)
from stratarates.plans.incidence import IncidenceRates, incidence_fact
from stratarates.plans.mortality import MortalityRates, mortality_fact, reband_counts
from stratarates.plans.populations import exposed_bands
from stratarates.plans.settings import (
    AGE_UNITS,
    FRACTION_PERIODS,
    HISTOLOGY_STRATA,
    INCIDENCE,
    INCIDENCE_SUMMARY_AGES,
    MORTALITY,
    MORTALITY_COUNT_BANDS,
)
from stratarates.sources.schemas import INCIDENCE_COUNTS, MORTALITY_COUNTS

WIDE = ["25–34", "35–44", "45–54", "55–64", "65–74", "75–84", "85+"]
YEARS = range(2001, 2021)


def test_exposed_population_drops_bands_without_a_fraction(spark):
    pop = spark.createDataFrame([(1, "a", 10), (1, "b", 20)], "Year int, Age string, pop long")
    frac = spark.createDataFrame([(1, "a", 0.5)], "Year int, Age string, fraction double")
    assert rows(exposed_population(pop, frac)) == [(1, "a", 10, 5.0)]


@pytest.fixture(scope="module")
def tiny(spark):
    pop = spark.createDataFrame(
        [(1, "a", 100, 80.0), (1, "b", 50, 40.0), (2, "a", 200, 150.0), (2, "b", 0, 0.0)],
        "Year int, Age string, pop long, withouthyst double",
    )
    cells = spark.createDataFrame(
        [("Total", 1, "a", 20), ("Total", 1, "b", 10), ("Total", 2, "a", 50), ("Total", 2, "b", 0),
         ("x", 2, "z", 5)],
        "Subtype string, Year int, Age string, Count long",
    )
    return pop, cells


def test_cell_rates(tiny):
    pop, cells = tiny
    got = rows(age_specific_rates(cells, pop, standard(pop, 1)))
    assert got == [
        ("Total", 1, "a", 20, 100.0, 100, 100.0, 100, 0.2, 0.2),
        ("Total", 1, "b", 10, 50.0, 50, 50.0, 50, 0.2, 0.2),
        ("Total", 2, "a", 50, 200.0, 200, 130.0, 100, 0.25, 0.25),
        # nobody at risk: no rate, and no error
        ("Total", 2, "b", 0, 0.0, 0, 40.0, 50, None, None),
    ]
    plain = age_specific_rates(cells, pop, standard(pop, 1), inflate_weights=False)
    assert rows(plain.select("atriskstandardpop").distinct()) == [(40.0,), (80.0,)]


def test_left_join_keeps_cells_without_a_population(tiny):
    pop, cells = tiny
    got = age_specific_rates(cells, pop, standard(pop, 1), how="left")
    assert rows(got.where("Age = 'z'")) == [
        ("x", 2, "z", 5, None, None, None, None, None, None)
    ]


def test_standardised_rates(tiny):
    pop, cells = tiny
    rates = age_specific_rates(cells, pop, standard(pop, 1))
    totals = reference_totals(rates, 1, "Total")
    assert rows(totals) == [(150.0, 150.0)]
    asr = standardised_rates(rates, totals, ["Subtype", "Year"]).select(
        "Year", "corrected", "Count", "ageadjustedrate"
    )
    got = {(y, v): (n, r) for y, v, n, r in rows(asr)}
    assert got[1, INCIDENCE_VARIANTS.corrected] == (30, pytest.approx(20000))
    assert got[1, INCIDENCE_VARIANTS.uncorrected] == (30, pytest.approx(20000))
    # one cell has no rate: the sum is missing, not smaller
    assert got[2, INCIDENCE_VARIANTS.corrected] == (50, None)


def test_missing_total_rows_are_an_error(tiny):
    pop, cells = tiny
    rates = age_specific_rates(cells, pop, standard(pop, 1))
    for year, stratum in ((99, "Total"), (1, "nothing")):
        with pytest.raises(Exception, match="no rows of reference year"):
            reference_totals(rates, year, stratum).collect()


def test_appended_rows(spark, tiny):
    pop, cells = tiny
    rates = age_specific_rates(cells, pop, standard(pop, 1)).where("Year = 1")
    totals = reference_totals(rates, 1, "Total")
    asr = standardised_rates(rates, totals, ["Subtype", "Year"])
    got = append_standardised(rates, asr, "All", INCIDENCE_VARIANTS.corrected, "Total")
    assert rows(got) == [
        ("All", 1, 0, 0.0, pytest.approx(20000)),
        ("a", 1, 20, 100.0, pytest.approx(20000)),
        ("b", 1, 10, 50.0, pytest.approx(20000)),
    ]
    plain = rates.drop("Subtype")
    long = standardised_rates(plain, totals, ["Year"], MORTALITY_VARIANTS)
    both = append_standardised_long(plain, long, "All", MORTALITY_VARIANTS)
    assert sorted(r[:2] for r in rows(both)) == [
        (a, v) for a in ("All", "a", "b") for v in ("rate", "rate_nc")
    ]


# the analyses with their real settings on made-up sheets ------------------------------


@pytest.fixture(scope="module")
def fractions(spark):
    periods = list(FRACTION_PERIODS)
    narrow = [a for a in AGE_UNITS if a != "85+"] + ["85–89", "90+"]
    data = [
        (age, *[0.95 - 0.02 * i + 0.01 * p for p in range(4)]) for i, age in enumerate(narrow)
    ]
    schema = "Age string, " + ", ".join(f"`{p}` double" for p in periods)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def exposed(spark, fractions):
    data = [
        (y, age, 1000 * (20 - i) + 13 * (y - 2000))
        for y in range(2001, 2023)
        for i, age in enumerate(AGE_UNITS)
    ]
    narrow = spark.createDataFrame(data, "Year int, Age string, pop long")
    return exposed_bands(narrow, fractions, MORTALITY).cache()


@pytest.fixture(scope="module")
def sheet(spark):
    rng = random.Random(3)
    leaf = [codes[0] for codes in HISTOLOGY_STRATA.values()] + ["U1.01.02.02.02"]
    data = []
    for year in YEARS:
        for age in ["0–14", "15–24", *WIDE]:
            n = {code: rng.randint(1, 30) for code in leaf}
            nos = rng.randint(0, 12)
            whole = sum(n.values()) + nos
            data += [(c, f"type {c}", "Females", year, age, v, whole) for c, v in n.items()]
            data.append(("U1.01.02.06.01", "Adenocarcinoma, NOS", "Females", year, age, nos, whole))
            data.append(("U1.01", "Carcinomas", "Females", year, age, whole - 1, whole))
            data.append((None, "All", "Females", year, age, whole, whole))
            data.append((leaf[0], "x", "Males", year, age, 999, 999))
        data.append((leaf[0], "x", "Females", year, INCIDENCE_SUMMARY_AGES[0], 999, 999))
    full = [(i, c, s, "10-year age groups", a, y, n, w) for i, c, s, y, a, n, w in data]
    full.append((leaf[0], "x", "Females", "5-year age groups", "25–29", 2001, 999, 999))
    rng.shuffle(full)
    return spark.createDataFrame(full, INCIDENCE_COUNTS)


@pytest.fixture(scope="module")
def analysis(sheet, exposed):
    kept = exposed.where("Year <= 2020")
    return IncidenceRates(incidence_fact(sheet).cache(), kept, INCIDENCE)


def totals_by_cell(df):
    return {k: n for *k_, n in rows(df) for k in [tuple(k_)]}


def test_reallocation_adds_up_to_the_published_total(analysis):
    parts = analysis.counts.where("Subtype <> 'Total'")
    split = parts.groupBy("Year", "Age").agg(F.sum("Count"))
    whole = analysis.counts.where("Subtype = 'Total'").select("Year", "Age", "Count")
    assert totals_by_cell(split) == totals_by_cell(whole)
    assert analysis.counts.where("i_d = 'U1.01'").isEmpty()


def test_reference_year_rate_is_the_crude_rate(analysis):
    t = analysis.totals.first()
    asr = analysis.standardised.where("Subtype = 'Total' AND Year = 2001")
    got = {r["corrected"]: r for r in asr.collect()}
    a = got[INCIDENCE_VARIANTS.corrected]
    assert a["ageadjustedrate"] == pytest.approx(a["Count"] / t["totalatrisk"] * 1e5)
    b = got[INCIDENCE_VARIANTS.uncorrected]
    assert b["ageadjustedrate"] == pytest.approx(b["Count"] / t["totalpop"] * 1e5)


def test_row_counts_of_the_exports(analysis):
    assert analysis.trend_series.count() == 7 * 20 * 2
    assert analysis.later_series().count() == 7 * 15 * 2
    assert analysis.age_series().count() == 7 * 20 + 20
    assert analysis.fraction_inputs().count() == 4 * 7 * 3
    assert analysis.attributable_inputs().count() == 4 * 3
    assert analysis.pooled_standardised().count() == 20 * 2
    assert analysis.grouped_standardised().count() == 4 * 2 * 20
    assert analysis.cases_by_stratum().count() == 7
    assert analysis.cases_by_stratum_year().count() == 7 * 20
    assert analysis.cases_by_band().count() == 9
    assert analysis.unspecified_share().count() == 20


def test_groups_add_up_to_the_overall_rate(analysis):
    parts = analysis.grouped_standardised().groupBy("Subtype", "Year").agg(
        F.sum("ageadjustedrate").alias("r")
    )
    whole = analysis.standardised.where(F.col("corrected") == INCIDENCE_VARIANTS.corrected)
    both = parts.join(whole, ["Subtype", "Year"]).select("r", "ageadjustedrate")
    assert both.count() == 4 * 20
    for a, b in rows(both):
        assert a == pytest.approx(b)


def test_uncorrected_rates_are_additive_over_strata(analysis):
    nc = analysis.standardised.where(F.col("corrected") == INCIDENCE_VARIANTS.uncorrected)
    total = {y: r for y, r in rows(nc.where("Subtype = 'Total'").select("Year", "ageadjustedrate"))}
    parts = nc.where("Subtype <> 'Total'").groupBy("Year").agg(F.sum("ageadjustedrate"))
    for y, r in rows(parts):
        assert r == pytest.approx(total[y])


def test_pooled_strata_use_the_main_totals(analysis):
    nc = INCIDENCE_VARIANTS.uncorrected
    main = analysis.standardised.where(
        (F.col("corrected") == nc) & F.col("Subtype").isin("Serous", "Carcinosarcoma")
    )
    want = dict(rows(main.groupBy("Year").agg(F.sum("ageadjustedrate"))))
    pooled = analysis.pooled_standardised().where(F.col("corrected") == nc)
    for y, r in rows(pooled.select("Year", "ageadjustedrate")):
        assert r == pytest.approx(want[y])


def test_result_does_not_depend_on_row_order(analysis, sheet, exposed):
    again = IncidenceRates(
        incidence_fact(sheet.orderBy(F.rand(5))), exposed.where("Year <= 2020"), INCIDENCE
    )
    assert rows(again.reallocated.drop("cancer_type")) == rows(
        analysis.reallocated.drop("cancer_type")
    )


def test_line_level_facts_give_the_same_rates(analysis, sheet, exposed):
    """Every count split into many rows, a third of them of one code."""
    fact = incidence_fact(sheet)
    parts = F.when(F.col("i_d") == "U1.01.02.01.01", 20).otherwise(3)
    first = F.col("Count") - F.floor(F.col("Count") / F.col("parts")) * (F.col("parts") - 1)
    split = (
        fact.withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(1), "parts")))
        .withColumn(
            "Count",
            F.when(F.col("part") == 1, first)
            .otherwise(F.floor(F.col("Count") / F.col("parts")))
            .cast("long"),
        )
        .select(fact.columns)
    )
    lines = IncidenceRates(split, exposed.where("Year <= 2020"), INCIDENCE)
    assert rows(lines.rates) == rows(analysis.rates)


def test_mortality(spark, exposed):
    ages = [f"{a:02d}-{a + 4:02d}" for a in range(0, 90, 5)] + ["90+", "All ages combined"]
    data = [
        ("Uterine cancer", sex, kind, y, age, 1 + i + (y % 5))
        for sex in ("Females", "Males")
        for kind in ("Actual", "Projections")
        for y in range(1999, 2023)
        for i, age in enumerate(ages)
    ]
    sheet = spark.createDataFrame(data, MORTALITY_COUNTS)
    cells = reband_counts(mortality_fact(sheet), MORTALITY_COUNT_BANDS)
    assert cells.count() == 22 * 7
    assert rows(cells.where("Year = 2001 AND Age = '25–34'")) == [(2001, "25–34", 7 + 8)]
    m = MortalityRates(cells, exposed, MORTALITY)
    assert m.fraction_inputs().count() == 7 * 3
    series = m.age_series()
    assert series.count() == 8 * 22 * 2
    assert series.where("rate IS NULL").isEmpty()
    assert m.rate_slice(2022, "rate").count() == 8
    assert m.deaths(["Age"]).count() == 7
    t = m.totals.first()
    whole = m.deaths().first()[0]
    assert whole == sum(n for *_, n in rows(cells))
    first = {r["corrected"]: r for r in m.standardised.where("Year = 2001").collect()}
    count = first["rate"]["Count"]
    assert first["rate"]["ageadjustedrate"] == pytest.approx(count / t["totalatrisk"] * 1e5)
    assert first["rate_nc"]["ageadjustedrate"] == pytest.approx(count / t["totalpop"] * 1e5)


def test_a_missing_narrow_band_makes_the_rate_missing(spark, exposed):
    holes = [(2001, a, 5) for a in WIDE if a != "45–54"] + [(2001, "45–54", None)]
    cells = spark.createDataFrame(holes, "Year int, Age string, Count long")
    m = MortalityRates(cells, exposed, MORTALITY)
    assert set(r["ageadjustedrate"] for r in m.standardised.collect()) == {None}
