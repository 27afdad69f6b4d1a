"""Sheet exports on disk -> rates -> CSV, against a plain pandas computation."""

import csv
import math
import os
import random

import pandas as pd
import pytest
from helpers import rows

from stratarates.plans.incidence import IncidenceRates, incidence_fact
from stratarates.plans.populations import exposed_bands, population_bands
from stratarates.plans.settings import (
    FRACTION_PERIODS,
    HISTOLOGY_STRATA,
    INCIDENCE,
    INCIDENCE_SUMMARY_AGES,
)
from stratarates.sources.schemas import INCIDENCE_COUNTS, fraction_schema, wide_text_schema
from stratarates.sources.sheets import METADATA_ROWS, read_sheet
from stratarates.sources.sinks import write_indexed_csv

YEARS = range(2001, 2021)
YOUNG = ["0–14", "15–24"]
WIDE = ["25–34", "35–44", "45–54", "55–64", "65–74", "75–84", "85+"]
NARROW = [*YOUNG, *[f"{a}–{a + 4}" for a in range(25, 85, 5)], "85+"]
NOS = "Adenocarcinoma, NOS"


def write_csv(folder, lines, preamble=()):
    os.makedirs(folder)
    with open(os.path.join(folder, "sheet.csv"), "w", encoding="utf-8", newline="") as f:
        for line in preamble:
            f.write(line + "\n")
        csv.writer(f, lineterminator="\n").writerows(lines)
    return str(folder)


def people(year, age):
    return 5000 - 31 * age + 17 * (year - 2000) + (age * year) % 13


def fraction(band_index, period_index):
    return round(0.97 - 0.02 * band_index + 0.005 * period_index, 3)


@pytest.fixture(scope="module")
def counts_table():
    rng = random.Random(11)
    data = []
    for year in YEARS:
        for age in YOUNG + WIDE:
            n = {codes[-1]: rng.randint(0, 25) for codes in HISTOLOGY_STRATA.values()}
            nos = rng.randint(0, 15)
            whole = sum(n.values()) + nos
            data += [[c, f"type, {c}", year, age, v, whole] for c, v in n.items()]
            data.append(["U1.01.02.06.01", NOS, year, age, nos, whole])
            data.append(["U1", "All groups", year, age, whole, whole])
            data.append([None, "Published total", year, age, whole, whole])
    return pd.DataFrame(data, columns=["code", "type", "Year", "Age", "Count", "All"])


@pytest.fixture(scope="module")
def folders(tmp_path_factory, counts_table):
    root = tmp_path_factory.mktemp("sheets")
    body = [
        ["" if r.code is None else r.code, r.type, "Females", "10-year age groups", r.Age, r.Year,
         r.Count, r.All]
        for r in counts_table.itertuples()
    ]
    summary = ["", "Published total", "Females", "10-year age groups", INCIDENCE_SUMMARY_AGES[1],
               2001, 7, 7]
    counts = write_csv(
        root / "counts", [INCIDENCE_COUNTS.names, *body, summary],
        ["Book 1", "Counts, by type", "", "Notes"],
    )
    headers = ["...1"] + [
        f"Estimated Resident Population ;  {sex} ;  {a if a < 100 else '100 and over'} ;"
        for sex in ("Male", "Female")
        for a in range(101)
    ]
    serial = lambda y: (pd.Timestamp(y, 6, 1) - pd.Timestamp(1899, 12, 30)).days
    population = write_csv(
        root / "population",
        [
            ["", *headers[1:]],
            *[[label] + ["000"] * 202 for label in METADATA_ROWS],
            *[
                [serial(y)] + [1] * 101 + [people(y, a) for a in range(101)]
                for y in range(1999, 2023)
            ],
        ],
    )
    labels = [b if b != "85+" else "90+" for b in NARROW]
    fractions = write_csv(
        root / "fractions",
        [["Age", *FRACTION_PERIODS]]
        + [[b] + [fraction(i, p) for p in range(4)] for i, b in enumerate(labels)],
    )
    return counts, population, headers, fractions


@pytest.fixture(scope="module")
def analysis(spark, folders):
    counts, population, headers, fractions = folders
    sheet = read_sheet(spark, counts, INCIDENCE_COUNTS, skip=4)
    pop = population_bands(
        read_sheet(spark, population, wide_text_schema(headers)), INCIDENCE
    )
    frac = read_sheet(spark, fractions, fraction_schema(list(FRACTION_PERIODS)))
    return IncidenceRates(incidence_fact(sheet), exposed_bands(pop, frac, INCIDENCE), INCIDENCE)


def reallocated(table, stratum_of):
    """Largest remainder per year and age, in plain Python."""
    out = []
    table = table.assign(Subtype=[stratum_of(c) for c in table.code])
    targets = table[table.Subtype.isin(["Endometrioid", "Serous", "Clear cell"])]
    by_year = targets.groupby(["Year", "Subtype"]).Count.sum()
    for r in table[table.type == NOS].itertuples():
        share = by_year[r.Year] / by_year[r.Year].sum()
        raw = {s: r.Count * share[s] for s in sorted(share.index)}
        low = {s: math.floor(v) for s, v in raw.items()}
        left = r.Count - sum(low.values())
        order = sorted(raw, key=lambda s: (low[s] - raw[s], s))
        out += [(s, r.Year, r.Age, low[s] + (order.index(s) < left)) for s in raw]
    kept = table[table.Subtype != " "][["Subtype", "Year", "Age", "Count"]]
    return pd.concat([kept, pd.DataFrame(out, columns=kept.columns)])


def expected_series(table):
    strata = {c: s for s, codes in HISTOLOGY_STRATA.items() for c in codes}
    cleaned = reallocated(table, lambda c: "Total" if c is None else strata.get(c, " "))
    cells = cleaned.groupby(["Subtype", "Year", "Age"]).Count.sum()
    pop, free = {}, {}
    for y in YEARS:
        p = next(i for i, (lo, hi) in enumerate(FRACTION_PERIODS.values()) if lo <= y <= hi)
        for at, wide in enumerate(WIDE):
            narrow = range(2 + 2 * at, 4 + 2 * at) if wide != "85+" else [len(NARROW) - 1]
            pop[y, wide] = free[y, wide] = 0
            for i in narrow:
                first = 25 + 5 * (i - 2)
                ages = range(first, first + 5) if wide != "85+" else range(85, 101)
                n = sum(people(y, a) for a in ages)
                pop[y, wide] += n
                free[y, wide] += n * fraction(i, p)
    ref_pop = sum(pop[2001, a] for a in WIDE)
    ref_free = sum(free[2001, a] + cells["Total", 2001, a] for a in WIDE)
    series = {}
    for s in ["Total", *HISTOLOGY_STRATA]:
        for y in YEARS:
            n = {a: cells[s, y, a] for a in WIDE}
            yes = sum(n[a] / (free[y, a] + n[a]) * (free[2001, a] + n[a]) for a in WIDE)
            no = sum(n[a] / pop[y, a] * pop[2001, a] for a in WIDE)
            at_risk = sum(free[y, a] + n[a] for a in WIDE)
            both = {"corrected for hyst": yes / ref_free, "not corrected for hyst": no / ref_pop}
            for variant, rate in both.items():
                series[variant, s, y] = (sum(n.values()), at_risk, rate * 1e5)
    return series


def test_series_equals_the_plain_computation(analysis, counts_table):
    want = expected_series(counts_table)
    got = {(v, s, y): (n, r, a) for v, s, y, n, r, a in rows(analysis.trend_series)}
    assert got.keys() == want.keys() and len(want) == 7 * 20 * 2
    for key, (n, at_risk, rate) in want.items():
        assert got[key] == (n, pytest.approx(at_risk), pytest.approx(rate))


def test_descriptive_counts(analysis, counts_table):
    adult = counts_table[counts_table.Age.isin(WIDE) & ~counts_table.code.isin(["U1"])]
    by_type = {(t, c): n for t, c, n in rows(analysis.cases_by_type())}
    assert by_type["Published total", None] == adult[adult.type == "Published total"].Count.sum()
    # the unspecified type is there only with its reallocated rows, which have no code
    assert by_type[NOS, None] == adult[adult.type == NOS].Count.sum()
    young = analysis.young_cases("0–14")
    assert young.where("Count = 0").isEmpty()
    first = counts_table[(counts_table.Age == "0–14") & counts_table.Count.gt(0)]
    kinds = first[~first.code.isin([None, "U1"]) & first.code.notna()]
    assert young.count() == len(kinds.groupby(["Year", "type"]))


def test_export_is_numbered_and_ordered(spark, analysis, tmp_path):
    out = str(tmp_path / "series")
    write_indexed_csv(analysis.trend_series, out, ["corrected", "Subtype", "Year"])
    files = sorted(f for f in os.listdir(out) if f.endswith(".csv"))
    table = pd.concat(pd.read_csv(os.path.join(out, f)) for f in files)
    assert list(table.iloc[:, 0]) == list(range(1, 281))
    keys = list(zip(table.corrected, table.Subtype, table.Year))
    assert keys == sorted(keys)
