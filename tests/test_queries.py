"""Every registered query against its SQL; those without SQL must run and have a stable schema."""

from __future__ import annotations

import pytest

from brineflow.plans import analysis, curation, pipeline, relational, sampling
from tests.compare import assert_same, database

MODULES = (analysis, curation, pipeline, relational, sampling)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"q_boosted_trees"}))
def test_runs_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry_without_the_subpackage_for_training_data(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
