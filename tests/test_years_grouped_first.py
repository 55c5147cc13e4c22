from pyspark.sql import functions as F

from ensolith.operators import reducers as R


def test_only_years_are_joined_to_the_span_of_the_record(spark):
    h = spark.sql("SELECT 1 AS case_id, explode(sequence(TIMESTAMP '2000-06-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY)) AS ts").withColumn("value", F.dayofyear("ts").cast("double"))
    out = R.by_year(h, ["case_id"], F.max_by("value", F.struct("ts")))
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    where = lambda word: next(k for k, line in enumerate(lines) if word in line)
    assert where("Join") < where("Aggregate")
    assert sorted(tuple(r) for r in out.select("case_id", "year", "annual").collect()) == [(1, 2001, 365.0), (1, 2002, 365.0)]
    assert R.peak_of_group_sum(h, ["case_id"], F.month("ts")).first()["n_years"] == 2
