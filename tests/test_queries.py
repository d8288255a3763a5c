"""Queries of the engine's own operators against their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, difference

from textloom import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) & set(plans.ORACLE_SQL)))
def test_against_sql(spark, con, name):
    assert difference(spark, con, plans.QUERIES[name], plans.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_others_run(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert len(df.toArrow().column_names) == len(set(df.columns))
