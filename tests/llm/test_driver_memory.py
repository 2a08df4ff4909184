"""Tables that grow with the corpus do not pass through the driver."""

from folioframe.llm.op10_simhash import links


def test_rows_of_the_covering_tables_are_not_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/fps")
    distinct = spark.read.parquet(f"{tmp_path}/fps")
    plan = links(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
