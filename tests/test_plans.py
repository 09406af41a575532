"""Plan checks: no Python UDF, no cartesian or nested-loop join in any query plan."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "PythonUDF", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas")
# model fits and file round trips run eagerly when built; their inputs are checked elsewhere
EAGER = ("fit_", "tune_", "var_price", "feature_set", "top_coef", "pipeline", *(f"op{n}_" for n in range(1, 14)))


def _lazy_queries():
    from pricewire.plans import q_files, q_io
    io_names = {name for module in (q_io, q_files) for name in vars(module) if name.startswith("q_")}
    return [n for n in entry.queries() if not n.startswith(EAGER) and f"q_{n}" not in io_names]


@pytest.mark.parametrize("name", _lazy_queries())
def test_plan_has_no_python_or_cross_join(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, (name, bad)
