"""Every query that SQL can express, against that SQL, with a look at its plan."""

import pytest

import __spark_entry__ as entry_point
from colloquy.plans.oracles import ORACLES
from colloquy.plans.registry import QUERIES
from tests.oracle_check import compare, connect



@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert not set(ORACLES) - set(QUERIES)
    assert not set(entry_point.oracle_sql()) - set(entry_point.queries())
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


#: Read off the same cross-validation as ``cv_summary`` and ``holdout_eval``, which take a minute each.
SAME_FOLDS = {"model_selection", "model_comparison"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SAME_FOLDS))
def test_query_equals_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    assert compare(df, con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["char_similarity_top1", "threshold_sweep_char", "best_score_stats_char", "threshold_choice_char", "session_report"])
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_converged_folds_equal_sql(spark, con, sf):
    """``model_comparison`` fits until it converges, ``cv_summary`` in steps."""
    assert compare(QUERIES["model_comparison"](spark, sf), con, ORACLES["model_comparison"]) is None
