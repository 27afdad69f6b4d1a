import random

import numpy as np
import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from stratarates.operators.classify import classify, label_rank, recode, split_in_two
from stratarates.operators.counts import cell_counts, counts, with_totals
from stratarates.operators.reallocate import (
    append_reallocated,
    reallocate,
    reallocate_many,
    shares_of_all,
    stratum_shares,
    unspecified_share,
)


def shares_of(spark, parts, year=2001):
    return spark.createDataFrame(
        [(year, s, p) for s, p in parts.items()], "Year int, Subtype string, proportion double"
    )


def cell(spark, n, year=2001, age="25–34"):
    return spark.createDataFrame([(year, age, n)], "Year int, Age string, Count long")


def test_classify(spark):
    df = spark.createDataFrame([("a1",), ("b1",), (None,), ("zz",)], "code string")
    got = classify(df, "code", {"A": ["a1", "a2"], "B": ["b1"]})
    assert rows(got) == [("a1", "A"), ("b1", "B"), ("zz", " "), (None, "Total")]


def test_a_code_listed_twice_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "code string")
    with pytest.raises(ValueError):
        classify(df, "code", {"A": ["a"], "B": ["a"]})


def test_recodes(spark):
    df = spark.createDataFrame([("90+",), ("80–84",), (None,)], "x string")
    kept = df.select(recode("x", {"90+": "85+"}).alias("v"))
    assert rows(kept) == [("80–84",), ("85+",), (None,)]
    lost = df.select(recode("x", {"90+": "85+"}, keep_others=False).alias("v"))
    assert rows(lost) == [("85+",), (None,), (None,)]
    two = df.select(split_in_two("x", ["90+"], "low", "high").alias("v"))
    assert rows(two) == [("high",), ("high",), ("low",)]
    ranked = df.select(label_rank("x", ["80–84", "90+"]).alias("v"))
    assert sorted(r[0] or 0 for r in ranked.collect()) == [0, 1, 2]


def test_ties_go_to_the_first_stratum(spark):
    third = 1 / 3
    got = reallocate(cell(spark, 10), shares_of(spark, {"C": third, "A": third, "B": third}))
    assert rows(got.select("Subtype", "Count")) == [("A", 4), ("B", 3), ("C", 3)]


def test_whole_parts_need_no_remainder(spark):
    got = reallocate(cell(spark, 8), shares_of(spark, {"A": 0.5, "B": 0.25, "C": 0.25}))
    assert rows(got.select("Subtype", "Count")) == [("A", 4), ("B", 2), ("C", 2)]


def test_a_missing_count_stays_missing(spark):
    got = reallocate(cell(spark, None), shares_of(spark, {"A": 0.5, "B": 0.5}))
    assert rows(got.select("Subtype", "Count")) == [("A", None), ("B", None)]


def brute_force(n, parts):
    raw = {s: n * p for s, p in parts.items()}
    low = {s: int(v) for s, v in raw.items()}
    left = n - sum(low.values())
    order = sorted(parts, key=lambda s: (-(raw[s] - low[s]), s))
    return {s: low[s] + (order.index(s) < left) for s in parts}


def test_reallocation_keeps_every_count(spark):
    rng = random.Random(7)
    years = range(2001, 2006)
    counts_by_year = {y: {s: rng.randint(1, 50) for s in "ABCD"} for y in years}
    classified = spark.createDataFrame(
        [(y, s, float(n)) for y, c in counts_by_year.items() for s, n in c.items()],
        "Year int, Subtype string, Count double",
    )
    cells = {(y, f"{a}"): rng.randint(0, 40) for y in years for a in range(6)}
    # several rows per cell, in any order
    lines = [(y, a, part) for (y, a), n in cells.items() for part in (n // 2, n - n // 2)]
    rng.shuffle(lines)
    unspecified = spark.createDataFrame(lines, "Year int, Age string, Count long")
    shares = stratum_shares(classified, ["A", "B", "C"])
    total = shares.groupBy("Year").agg(F.sum("proportion").alias("p"))
    assert all(abs(p - 1) < 1e-12 for _, p in rows(total))
    got = {(y, a, s): n for y, a, s, n in rows(reallocate(unspecified, shares))}
    for (y, a), n in cells.items():
        targets = {s: counts_by_year[y][s] for s in "ABC"}
        whole = float(sum(targets.values()))
        want = brute_force(n, {s: c / whole for s, c in targets.items()})
        assert {s: got[y, a, s] for s in "ABC"} == want
        assert sum(want.values()) == n


def test_shares_with_a_missing_count_are_missing(spark):
    df = spark.createDataFrame(
        [(1, "A", 1), (1, "B", None), (2, "A", 1), (2, "B", 3)], "Year int, Subtype string, Count long"
    )
    got = rows(stratum_shares(df, ["A", "B"]))
    assert got == [(1, "A", None), (1, "B", None), (2, "A", 0.25), (2, "B", 0.75)]


def test_append_drops_blank_strata(spark):
    df = spark.createDataFrame(
        [("A", "x", 1, 10), (" ", "NOS", 2, 10)], "Subtype string, cancer_type string, Count long, ALL long"
    )
    more = spark.createDataFrame([("A", 2)], "Subtype string, Count long")
    assert rows(append_reallocated(df, more)) == [("A", "x", 1, 10), ("A", None, 2, None)]


def test_unspecified_share_uses_the_total_of_the_cell(spark):
    df = spark.createDataFrame(
        [
            (1, "a", "x", 6, 10), (1, "a", "NOS", 3, None), (1, "a", "NOS", 1, None),
            (1, "b", "x", 10, 10), (1, "b", "NOS", None, None),
            (1, "c", "x", 99, 99),
        ],
        "Year int, Age string, cancer_type string, Count long, ALLUterineCancers long",
    )
    got = unspecified_share(df, F.col("cancer_type") == "NOS")
    assert rows(got) == [(1, 4, 20, 20.0)]


def test_counts(spark):
    df = spark.createDataFrame(
        [("a", "0–14", 1), ("a", "25–34", 2), ("b", "25–34", 0), ("c", "25–34", None)],
        "k string, Age string, Count long",
    )
    assert rows(counts(df, ["k"])) == [("a", 3), ("b", 0), ("c", None)]
    assert rows(counts(df, ["k"], drop_zero=True)) == [("a", 3)]
    assert rows(counts(df, where=F.col("k") != "c")) == [(3,)]
    assert rows(cell_counts(df, ["k"], ["0–14"])) == [("a", 2), ("b", 0), ("c", None)]


def test_counts_keep_fractions(spark):
    df = spark.createDataFrame([("a", 0.7), ("a", 0.7)], "k string, Count double")
    assert rows(counts(df, ["k"])) == [("a", 1.4)]
    whole = spark.createDataFrame([("a", 1), ("a", 2)], "k string, Count int")
    assert counts(whole, ["k"]).schema["Count"].dataType.simpleString() == "bigint"


def test_reallocation_follows_the_formula_on_fractions(spark):
    n = spark.createDataFrame([(2001, "25–34", 1.4)], "Year int, Age string, Count double")
    got = reallocate(n, shares_of(spark, {"A": 0.75, "B": 0.25}))
    assert rows(got.select("Subtype", "Count")) == [("A", 1.0), ("B", 0.0)]


def test_with_totals(spark):
    events = spark.createDataFrame(
        [("x", 1, 2.5), ("y", 1, 1.0), (None, 1, 0.5), ("x", 2, 1.0)], "code string, Year int, w double"
    )
    got = with_totals(events, "code", ["Year"], "w")
    assert rows(got.select("code", "Year", "Count", "ALLUterineCancers")) == sorted(
        [("x", 1, 2.5, 4.0), ("y", 1, 1.0, 4.0), ("UNKNOWN", 1, 0.5, 4.0), (None, 1, 4.0, 4.0),
         ("x", 2, 1.0, 1.0), (None, 2, 1.0, 1.0)], key=repr)


def parts_of(df):
    return sorted((r["Year"], r["Age"] or "", r["Subtype"], r["Count"]) for r in df.collect())


def test_many_strata_are_chosen_like_few(spark):
    """Ties across and within cells, a NULL share, a NULL cell, fractions and nothing left over."""
    rng = random.Random(3)
    shares = [(y, f"s{k:03d}", rng.choice((0.001, 0.0025, 0.01, rng.random() / 60))) for y in (1, 2) for k in range(120)]
    shares += [(3, f"s{k}", 0.25) for k in range(4)] + [(4, "a", None), (4, "b", 0.5)]
    cells = [(y, a, n) for y in (1, 2) for a, n in (("x", 700), ("y", 3), ("z", 0), (None, 95))]
    cells += [(3, "x", 6), (3, "y", 8), (4, "x", 3), (5, "x", 9), (1, "w", None)]
    for kind in ("long", "double"):
        unspecified = spark.createDataFrame([(y, a, n if kind == "long" or n is None else n + 0.75) for y, a, n in cells],
                                            f"Year int, Age string, Count {kind}")
        of = spark.createDataFrame(shares, "Year int, Subtype string, proportion double").repartition(3)
        want = parts_of(reallocate(unspecified, of))
        got = reallocate_many(unspecified, of)
        assert parts_of(got) == want and got.schema["Count"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)


def test_a_cell_of_a_million_strata(spark):
    """Two thirds of the strata tie in the bucket where the last unit falls."""
    n, units = 1_000_000, 2_400_000
    weight = "CASE id % 3 WHEN 0 THEN 3 ELSE 2 END"
    of = spark.range(n).selectExpr("1 AS Year", "lpad(id, 7, '0') AS Subtype", f"{weight} AS Count").repartition(8)
    unspecified = spark.createDataFrame([(1, "x", units)], "Year int, Age string, Count long")
    shares = shares_of_all(of)
    got = reallocate_many(unspecified, shares).toPandas().sort_values("Subtype")["Count"].to_numpy()
    counts = np.where(np.arange(n) % 3 == 0, 3, 2)
    raw = units * (counts / counts.sum())
    low = np.floor(raw)
    order = np.lexsort((np.arange(n), -(raw - low)))
    want = low.copy()
    want[order[: int(units - low.sum())]] += 1
    assert (got == want).all() and got.sum() == units


def test_no_window_holds_the_strata_of_a_cell(spark):
    of = spark.range(50).selectExpr("1 AS Year", "CAST(id AS STRING) AS Subtype", "0.02D AS proportion")
    unspecified = spark.createDataFrame([(1, "x", 75)], "Year int, Age string, Count long")
    plan = plan_of(reallocate_many(unspecified, of))
    for line in plan.splitlines():  # windows are over buckets and files
        if "Window [" in line:
            assert "_strata" in line or "_rows" in line or "_floors" in line, line
