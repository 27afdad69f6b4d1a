"""Every registered query against its SQL oracle, on the smallest tables."""

import re

import pandas as pd
import pytest
from check_oracles import compare, duck, type_differences
from helpers import plan_of

import __spark_entry__ as entry_module
from catalogue.oracles import ORACLES
from catalogue.queries import QUERIES




@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def plain(table):
    df = table.to_pandas(types_mapper=pd.ArrowDtype).astype(object)
    return df.where(df.notna(), None)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    relation = con.sql(ORACLES[name])
    assert not type_differences(df, relation)
    want = relation.arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert compare(plain(df.toArrow()), plain(want)) is None

    # no cross joins, no Python workers, and one pass over each big table
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert banned not in plan
    scans = re.findall(r"FileScan parquet [^\n]*/(?:lineitem|orders)\.parquet", plan)
    # fill_forward reads its rows once and their per-block summary once
    assert len(scans) <= (2 if name == "fill_forward" else 1)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_registers_the_catalogue():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 6 * 7 * 2
