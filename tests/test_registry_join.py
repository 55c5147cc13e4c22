from ensolith.operators import evaluation as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_registry_goes_to_the_tasks(spark):
    targets = spark.range(10).selectExpr("if(id >= 0, 'A', 'B') AS key", "id")
    registry = spark.createDataFrame([("A", "x", "site", 1.0)], "alias string, variable string, level string, factor double")
    assert "BroadcastHashJoin" in plan(E.resolved(targets, registry)) and E.resolved(targets, registry).count() == 10
