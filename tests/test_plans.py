"""Plan guards: every registered query (model fits aside) plans without
nested-loop / cartesian joins and without row-at-a-time Python UDFs."""
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

SKIP = {"fit_gbt", "fit_rf", "fit_mlp", "fit_logreg", "fit_regression", "calibrate_sigmoid", "calibrate_isotonic",
        "batch_score", "permutation_importance", "permutation_importance_auprc", "attribution_compare",
        "scientific_report", "preprocess_raw"}
NAMES = sorted(n for n in entry.queries() if n not in SKIP)
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython")


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_joins_or_row_udfs(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in FORBIDDEN if k in plan], name
