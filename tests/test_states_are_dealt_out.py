"""States of the search are small as files and large as rows, so no superstep may send them whole to the driver and every task."""

from larkspur.operators import site_search as ss
from larkspur.plans import searches


def test_no_superstep_broadcasts_states(spark, tmp_path):
    companies, out = searches.outside(spark, "/root/testdata/sf0.001", second=True)
    ss.begun(companies).write.parquet(f"{tmp_path}/begun")
    states = spark.read.parquet(f"{tmp_path}/begun")
    plans = {name: ss.step(states, name, out)._jdf.queryExecution().executedPlan().toString() for name in ss.STEPS}
    assert [name for name, plan in plans.items() if "BroadcastHashJoin" in plan] == []


def test_rows_without_a_page_get_no_url(spark):
    pages = spark.createDataFrame([(0, "a"), (1, "b"), (-6, "c")], "page_id long, url string")
    rows = spark.createDataFrame([(5, None), (6, 1), (7, 9), (8, 0)], "uid long, p long")
    found = searches._with_url(rows, "p", pages, "u")
    assert found.columns == ["uid", "p", "u"] and {(r.uid, r.u) for r in found.collect()} == {(5, None), (6, "b"), (7, None), (8, "a")}
