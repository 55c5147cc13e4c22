import shutil

import pytest
from pyspark.sql import functions as F

from ensolith.operators import designs as D
from ensolith.sources import text as T
from ensolith.streaming import windows as W


def test_each_morris_step_moves_one_parameter_by_delta(spark):
    names = ["a", "b", "c"]
    rows = D.morris_trajectories(spark, 20, names, 4, 3).orderBy("trajectory", "step").collect()
    assert len(rows) == D.design_size("morris", 20, 3)
    for before, now in zip(rows, rows[1:]):
        if now["step"] == 0:
            continue
        moved = [n for n in names if before[n] != now[n]]
        assert moved == [now["changed"]]
        assert abs(before[moved[0]] - now[moved[0]]) == pytest.approx(4 / 6)
        assert all(-1e-12 <= now[n] <= 1 + 1e-12 for n in names)
    assert {r["changed"] for r in rows} == {None, *names}


def test_splits_refuse_bad_arguments(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        D.hold_out_end(df, "id", 1.0)
    with pytest.raises(ValueError):
        D.hold_out(df, F.col("id"), 0.0)
    assert [r["id"] for r in D.hold_out_end(df, "id", 0.2, first=True).where("held_out").orderBy("id").collect()] == [0, 1]


def test_text_sources(spark, tmp_path):
    (tmp_path / "run.dat").write_text("# time, a\n0, 1.5\n1, x\n")
    got = T.delimited(spark, str(tmp_path / "run.dat"), "t int, a double").orderBy("t").collect()
    assert [tuple(r) for r in got] == [(0, 1.5), (1, None)]

    (tmp_path / "wiki" / "deep").mkdir(parents=True)
    (tmp_path / "wiki" / "one.md").write_text("text\n# Title one \nmore")
    (tmp_path / "wiki" / "deep" / "two.md").write_text("no heading")
    got = T.notes(spark, str(tmp_path / "wiki")).orderBy("title").collect()
    assert [(r["store"], r["title"]) for r in got] == [("notes", "Title one"), ("notes", "two")]

    (tmp_path / "p.csv").write_text("name,lower_bound,upper_bound\na,0,1\nb,x,2\n")
    assert [tuple(r) for r in T.parameter_list(spark, str(tmp_path / "p.csv")).collect()] == [("a", 0.0, 1.0)]
    (tmp_path / "bad.csv").write_text("name,lower_bound,upper_bound\na,1,1\n")
    with pytest.raises(Exception, match="not below"):
        T.parameter_list(spark, str(tmp_path / "bad.csv")).collect()

    (tmp_path / "deck.xml").write_text('<L><P name="k" value="2.5"/><P name="m" value="3"/></L>')
    got = T.deck(spark, str(tmp_path / "deck.xml"), "P", "_name string, _value double").orderBy("_name").collect()
    assert [tuple(r) for r in got] == [("k", 2.5), ("m", 3.0)]


def test_history_prunes_and_refuses(spark, tmp_path):
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "h"))
    got = T.history(spark, str(tmp_path / "h"), ["v"], "id", 3, 5).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(3, 6), (4, 8), (5, 10)]
    with pytest.raises(ValueError, match="w"):
        T.history(spark, str(tmp_path / "h"), ["w"], "id")


def test_ranking_is_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5), (1, 0.25)], "rank int, composite double")
    T.write_ranking(df, str(tmp_path / "r"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert [x for x in lines if x != "rank\tcomposite"] == ["1\t0.25", "2\t0.5"]


def _stream(spark, sf_dir, tmp_path, make):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in" / "events.parquet")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        return spark.table(q.name).collect()
    finally:
        q.stop()


@pytest.mark.parametrize("make", [lambda e: W.tumbling(e, "ts", "1 day", ["event_type"], "value"), lambda e: W.sessions(e, "ts", "6 hours", ["user_id"])], ids=["tumbling", "sessions"])
def test_a_stream_gives_what_a_batch_gives(spark, sf_dir, tmp_path, make):
    got = sorted(map(lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r), _stream(spark, sf_dir, tmp_path, make)))
    want = sorted(map(lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r), make(spark.read.parquet(f"{sf_dir}/events.parquet")).collect()))
    assert got == want and got
