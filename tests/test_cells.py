import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from stratarates.functions.nulls import lenient_sum, strict_sum
from stratarates.operators.cells import cell_states, cell_values, compact, merged, store_batch, stored_cells

KEYS, MEASURES = ["a.b", "g"], ["n", "w"]


@pytest.fixture(scope="module")
def events(spark):
    """A hot cell, a NULL key, cells that are NULL in one half only, and cells of one half."""
    data = [(i % 5 if i % 3 else 0, None if i % 11 == 0 else f"g{i % 4}", None if i % 37 == 0 else i, i / 8) for i in range(400)]
    data += [(9, "late", 1, None)]
    return spark.createDataFrame(data, "`a.b` int, g string, n long, w double")


def one_pass(events, total):
    return events.groupBy("`a.b`", "g").agg(*[total(m).alias(m) for m in MEASURES])


@pytest.mark.parametrize("strict", [True, False])
def test_halves_merged_equal_one_pass(events, strict):
    half = F.coalesce(F.col("n"), F.lit(0)) % 2 == 0
    both = cell_states(events.where(half), KEYS, MEASURES).unionByName(cell_states(events.where(~half), KEYS, MEASURES))
    got = cell_values(merged(both, KEYS, MEASURES), KEYS, MEASURES, strict)
    assert rows(got) == rows(one_pass(events, strict_sum if strict else lenient_sum))


def test_batches_are_added_replaced_and_compacted(spark, events, tmp_path):
    path, whole = str(tmp_path / "cells"), str(tmp_path / "compact")
    for at in range(3):
        part = events.where(F.coalesce(F.col("n"), F.lit(0)) % 3 == at)
        store_batch(part.limit(3) if at == 1 else part, path, f"b{at}", KEYS, MEASURES)
    store_batch(events.where(F.coalesce(F.col("n"), F.lit(0)) % 3 == 1), path, "b1", KEYS, MEASURES)
    want = rows(one_pass(events, strict_sum))
    assert rows(cell_values(stored_cells(spark, path, KEYS, MEASURES), KEYS, MEASURES)) == want
    compact(spark, path, whole, KEYS, MEASURES)
    assert rows(cell_values(stored_cells(spark, whole, KEYS, MEASURES), KEYS, MEASURES)) == want
    assert spark.read.parquet(whole).count() == len(want)


def test_states_are_one_partial_and_one_final_aggregate(events):
    plan = plan_of(cell_states(events.repartition(3), KEYS, MEASURES))
    assert plan.count("hashpartitioning") == 1 and "Expand" not in plan
