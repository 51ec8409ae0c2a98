"""Every query with SQL gives the rows that DuckDB gives."""

import __spark_entry__ as entry
import oracle
import pytest

from convolytics import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    assert oracle.compare(con, queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name]) == ""


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_ordered_features_has_all_51(spark):
    assert len(queries.QUERIES["ordered_features_all"](spark, SMALL).columns) == 52


def test_logistic_predictions_are_probabilities(spark):
    p = queries.QUERIES["logistic_oof"](spark, SMALL).toPandas()
    assert p.response_id.is_unique and p.p.between(0, 1).all()
