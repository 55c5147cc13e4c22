from ensolith.operators import checks as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_golden_queries_keep_no_texts(spark):
    hits = spark.createDataFrame([("a", "One TWO"), ("a", "three"), ("a", None), ("b", "four"), ("other", "five")], "name string, text string")
    golden = spark.createDataFrame([("a", ["two", "THREE"], ["four"], []), ("a", ["two", "six"], [], []), ("b", [], ["four"], []), ("b", [], [], ["x", "four"]), ("c", [], ["x"], []), ("c", ["x"], [], []), ("a", [], [], ["x"])], "name string, must array<string>, must_not array<string>, any array<string>")
    got = K.golden_queries(hits, golden)
    assert sorted(map(tuple, got.collect())) == [("a", False), ("a", False), ("a", True), ("b", False), ("b", True), ("c", False), ("c", True)]
    # the words found are grouped, not the texts
    assert not [line for line in plan(got).splitlines() if "collect_list" in line and "lower(text" in line]
