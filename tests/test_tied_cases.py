from ensolith.operators import screening as S


def test_cases_equal_to_nine_decimals_go_by_id(spark):
    scored = spark.createDataFrame([(3, "a", 0.5, True), (2, "a", 0.5 + 3e-11, True), (1, "a", 0.5 + 1e-7, True), (4, "a", None, False)], "case_id int, target string, cost double, satisfied boolean")
    ranked = S.rank_cases(scored)
    assert [r["case_id"] for r in ranked.orderBy("rank").collect()] == [2, 3, 1, 4]
    noise = spark.createDataFrame([(2, "a", 0.3, True), (1, "a", 0.1 + 0.2, True)], "case_id int, target string, cost double, satisfied boolean")
    assert tuple(S.best_cases(S.rank_cases(noise)).first()) == (1, 1)
