"""Every registered query of the library itself against its SQL; those without SQL must give rows."""

import pytest

from tests.oracle import DATA, same
from textloom.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        same(spark, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_answers_are_recovered_once_for_their_chunks(spark):
    """the scan for closed objects stands in the plan once, not in a filter and once more for each use (42 times before)."""
    from textloom.functions import answers

    plan = QUERIES["j5_apply_enrichment"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(answers._PIECE) == 1
