"""Each query of the engine gives the rows of its SQL, and the driver's contract holds."""

import pytest
from oracle import assert_same

from concord.plans import catalog, files
from concord.plans.oracle import ORACLE_SQL

QUERIES = catalog.QUERIES | files.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_all_but_the_model_have_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"gbt_scores"}


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 29
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql()) <= set(e.queries())


def test_blocking_finds_true_links(spark, sf01_dir):
    row = QUERIES["candidate_recall"](spark, sf01_dir).first()
    assert row.n_links > 10 and row.candidate_recall >= 0.95
