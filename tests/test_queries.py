"""Every registered query on the smallest tables, against its check SQL."""

import pytest

import __spark_entry__ as entry
from tests import oracle

@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


# The smallest tables have too few records for a decision, or for two classes in every fold.
LARGER = {"baseline_checkpoints", "credibility_decisions", "expected_cost_decisions", "streak_decisions",
          "nested_predictions_cover"}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, folder, con, name):
    place = folder.replace("0.001", "0.01") if name in LARGER else folder
    df = entry.queries()[name](spark, place)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    good, note = oracle.compare(df, sql, con if place == folder else oracle.connect(place))
    assert good, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["project", "variant", "page_title", "country", "popularity", "trend"]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
