"""What a task of the layout operators holds does not grow with the rows of a page or of the table."""

from pyspark.sql import functions as F

from folioflux.operators import layout as L
from folioflux.plans import table_queries as Q


def test_column_intervals_do_not_sort_rows_by_page(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("if(id % 2 = 0, 'A', null) as page", "cast(id as double) as x")
        columns = spark.createDataFrame([("A", "low", 0.0, 500.0), ("A", "high", 500.0, 1e9), ("B", "low", 0.0, 1e9)], "page string, name string, start double, end double")
        found = L.column_of(rows, columns, "page", "x")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {(r.name, r["count"]) for r in found.groupBy("name").count().collect()} == {("low", 250), ("high", 250)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grouped_features_are_dealt_by_their_number(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, Q.q_table_score(spark, sf).collect()))
    monkeypatch.setattr(L, "TASK_ROWS", 500)
    rows = spark.range(10_001).select((F.col("id") % 100).alias("g"))
    assert L.dealt(rows, "g").rdd.getNumPartitions() == 21 and L.dealt(rows.limit(0), "g").count() == 0
    assert sorted(map(tuple, Q.q_table_score(spark, sf).collect())) == want
