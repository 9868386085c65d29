"""flatten_cases reads its tables once for all nine relations."""

from __future__ import annotations

import __spark_entry__ as entry


def test_flatten_cases_joins_its_tables_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", 0, 5.0, "x"), (2, "b", 0, 7.0, None)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string") \
        .write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 1, "F", 2.5, None, "1-URGENT"), (11, 1, "O", 3.0, None, None)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, "
                          "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(10, "R", 4.0), (10, "N", 6.0)], "l_orderkey long, l_returnflag string, l_quantity double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entry.queries()["flatten_cases"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "from_json" not in plan
    got = {r["relation"]: (r["n"], r["n_cases"], r["total"]) for r in out.collect()}
    assert got == {"cases": (2, 2, 12.0), "exposures": (2, 1, 5.5), "family_histories": (2, 2, None), "diagnoses": (2, 1, 21.0),
                   "treatments": (2, 1, 20.0), "pathology_details": (2, 1, 21.0), "follow_ups": (2, 1, 21.0),
                   "molecular_tests": (2, 1, 10.0), "other_clinical_attributes": (2, 1, 21.0)}
