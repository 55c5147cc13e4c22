"""Readers and writers of case files, lists, graphs, stores and rankings."""

import pytest
from pyspark.sql import functions as F

from ensolith.sources import files as S


def test_case_files(spark, tmp_path):
    for case, year in ((1, 2001), (1, 2002), (7, 2001), (12, 2001)):
        spark.createDataFrame([(year * 10 + k, float(k), 1e30 if k == 2 else 1.0) for k in range(3)], "rec long, a double, b double").coalesce(1).write.parquet(f"{tmp_path}/run/case_{case}/{year}")
    cases = S.cases_in(spark, f"{tmp_path}/run", r"case_(\d+)/.*parquet$", 9)
    assert sorted({r["case_id"] for r in cases.collect()}) == [1, 7]
    h = S.case_history(spark, f"{tmp_path}/run", r"case_(\d+)/", ["a", "b"], "rec", 20011, 20022)
    got = sorted(tuple(r) for r in h.collect())
    assert [r[:2] for r in got] == [(1, 20011), (1, 20012), (1, 20020), (1, 20021), (7, 20011), (7, 20012), (12, 20011), (12, 20012)]
    assert all((r[3] is None) == (r[1] % 10 == 2) for r in got)
    with pytest.raises(ValueError):
        S.case_history(spark, f"{tmp_path}/run", r"case_(\d+)/", ["c"], "rec")


def test_parameter_lists(spark, tmp_path):
    for k, sep in enumerate((",", ";", "\t")):
        (tmp_path / f"{k}.txt").write_text("# a list\n" + "\n".join(sep.join(x) for x in (("name", "lower_bound", "upper_bound", "scale"), ("p", "0.1", "2", "log"), ("q", "-1", "1", ""))))
        rows = S.typed_parameters(S.sniffed(spark, f"{tmp_path}/{k}.txt")).orderBy("name").collect()
        assert [(r["name"], r["lower_bound"], r["is_log"] or False, r["mode"]) for r in rows] == [("p", 0.1, True, "absolute"), ("q", -1.0, False, "absolute")]
    for bad in ([("p", "1", "2", ""), ("p", "1", "2", "")], [("p", "2", "1", "")], [("p", "0", "1", "log")]):
        with pytest.raises(Exception, match="repeated|order|logarithm"):
            S.typed_parameters(spark.createDataFrame(bad, "name string, lower_bound string, upper_bound string, scale string")).collect()


def test_targets_and_stores(spark):
    t = spark.createDataFrame([("a", 1.0, None), ("b", None, None), ("c", 2.0, "soil_bgc"), ("d", 3.0, None)], "name string, observed double, track string")
    assert {r["name"]: r["reason"] for r in S.scorable_targets(t, ["a", "b", "c"]).collect()} == {"a": None, "b": "not_observed", "c": "other_track", "d": "not_named"}
    store = spark.createDataFrame([("x", "doc"), ("y", "note")], "id string, type string")
    more = spark.createDataFrame([("y", "doc"), ("z", "doc"), ("z", "a")], "id string, type string")
    assert [tuple(r) for r in S.new_entries(store, more, "id").collect()] == [("z", "a")]
    assert {tuple(r) for r in S.store_stats(store, "type").collect()} == {("doc", 1), ("note", 1)}


def test_graphs_rankings_and_problems(spark, tmp_path):
    n, e = spark.createDataFrame([("a", "t"), ("b", "t")], "node string, type string"), spark.createDataFrame([("a", "b", "r")], "src string, dst string, relation string")
    S.save_graph(n, e, f"{tmp_path}/g")
    assert [x.count() for x in S.load_graph(spark, f"{tmp_path}/g")] == [2, 1]
    ranked = spark.createDataFrame([(4, 0.5, 1, 1), (5, 0.7, 0, 2)], "case_id long, composite double, n_satisfied long, rank long")
    values = spark.createDataFrame([(4, "u", 0.1, 12345.678), (5, "u", 0.2, 1.0)], "case_id long, target string, relative_error double, sim double")
    S.write_table(S.ranking_layout(ranked, values, ["u"]), f"{tmp_path}/r", ["Rank"], "\t")
    back = spark.read.csv(f"{tmp_path}/r", sep="\t", header=True)
    assert back.columns == ["Rank", "Set_ID", "Composite", "N_satisfied", "RE_u", "Sim_u"] and back.where("Set_ID = 4").first()["Sim_u"] == "12345.7"
    S.write_problem(spark, ["p", "q"], [(0, 1), (2, 3)], f"{tmp_path}/p")
    assert [r["name"] for r in spark.read.csv(f"{tmp_path}/p", header=True).orderBy("place").collect()] == ["p", "q"]
    assert S.read_json(spark, f"{tmp_path}/g/nodes", "node string, type string").where(F.col("node").isNotNull()).count() == 2
