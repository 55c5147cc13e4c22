from pyspark.sql import functions as F

from ensolith.operators import events as V


def test_totals_equal_but_for_the_order_of_summing_are_ties(spark):
    rows = [("u", "a", x) for x in (0.1, 0.2, 0.3)] + [("u", "b", x) for x in (0.3, 0.3)] + [("u", "c", None)]
    df = spark.createDataFrame(rows, "u string, c string, v double")
    # 0.1 + 0.2 + 0.3 is above 0.6 in some orders and 0.6 in others; b comes behind a in all of them
    for order in ("v", "-v"):
        got = V.cause_shares(df.orderBy(F.expr(order)).coalesce(1), ["u"], "c", "v")
        assert [tuple(r) for r in got.orderBy("c").select("c", "rank", "dominant").collect()] == [("a", 1, True), ("b", 2, False), ("c", 3, False)]
    swapped = df.withColumn("c", F.translate("c", "ab", "ba")).coalesce(1)
    assert V.cause_shares(swapped, ["u"], "c", "v").where("dominant").first()["c"] == "a"
