"""Designs, chunks, bands and refusals that SQL does not cover."""

import statistics

import pytest
from pyspark.sql import functions as F

from ensolith.functions import columns as C
from ensolith.operators import acquisition as A
from ensolith.operators import designs as D
from ensolith.operators import evaluation as E
from ensolith.operators import ranks as K
from ensolith.operators import retrieval as R
from ensolith.operators import sensitivity as V


def test_latin_hypercube_hits_every_slice_once(spark):
    rows = V.latin_hypercube(spark, 64, ["a", "b"], 3).collect()
    for c in ("a", "b"):
        assert sorted(int(r[c] * 64) for r in rows) == list(range(64))


def test_morris_steps_move_one_parameter_by_delta(spark):
    rows = D.morris_trajectories(spark, 20, ["a", "b", "c"], 4, 5).orderBy("trajectory", "step").collect()
    assert len(rows) == 80
    for before, after in zip(rows, rows[1:]):
        if after["step"]:
            moved = [n for n in "abc" if before[n] != after[n]]
            assert moved == [after["changed"]] and abs(abs(before[moved[0]] - after[moved[0]]) - 2 / 3) < 1e-9
        assert all(0 <= after[n] <= 1 for n in "abc")


def test_chunks_cover_their_text(spark):
    text = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(i % 40 + 5)) for i in range(60))
    rows = R.chunks(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id long, text string"), "id", "text", 300, 60, 100).collect()
    assert {r["id"] for r in rows} == {1} and all(100 <= len(r["chunk"]) <= 300 for r in rows)
    whole = [c for c in R.split_recursively(text, 300, 60) if len(c) >= 100]
    assert [r["chunk"] for r in sorted(rows, key=lambda r: r["chunk_index"])] == whole
    assert set(text.split()) <= {w for c in R.split_recursively(text, 300, 60) for w in c.split()}  # overlaps may begin inside a word


def test_band_probability_is_that_of_the_normal_distribution(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (5.0, 2.0), (-3.0, 0.5)], "m double, s double")
    for r in rows.select("m", "s", A.band_probability(F.col("m"), F.col("s"), F.lit(-1.0), F.lit(4.0)).alias("p")).collect():
        n = statistics.NormalDist(r["m"], r["s"])
        assert r["p"] == pytest.approx(n.cdf(4) - n.cdf(-1), abs=1e-12)


def test_order_statistics_and_ranks(spark):
    rows = [(k % 3, float((k * 37) % 101), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, x double, k int").repartition(5)
    got = {r["g"]: (r["kth"], r["n"]) for r in K.kth_smallest(df, ["g"], "x", F.lit(10)).collect()}
    assert got == {g: (sorted(x for h, x, _ in rows if h == g)[9], 100) for g in range(3)}
    assert K.kth_smallest(df, ["g"], "x", F.col("n") + 1).where("kth is not null").count() == 0
    assert sorted(r["rank"] for r in K.numbered(df, [F.col("x").desc(), F.col("k").asc()]).collect()) == list(range(1, 301))
    place = {x: [i + 1 for i, y in enumerate(sorted(v for _, v, _ in rows)) if y == x] for _, x, _ in rows}
    assert all(r["r"] == statistics.mean(place[r["x"]]) for r in K.average_ranks(df, "x", "k", "r").collect())


def test_refusals(spark):
    x = spark.createDataFrame([(0, 5), (1, 6)], "row long, p int")
    y = spark.createDataFrame([(1, 0.5), (3, 0.7)], "case_id long, v double")
    with pytest.raises(Exception, match="no design row for case 3"):
        E.pooled(x, y).collect()
    assert E.pooled(x, y, baseline=3).count() == 1
    for bad in ([(1, 0.5), (1, 0.6)], [(1, 2.0)], [(1, None)], [(1, float("nan"))]):
        with pytest.raises(Exception, match="out of range or missing"):
            E.strict(spark.createDataFrame(bad, "case_id long, v double"), ["case_id"], {"v": (0.0, 1.0)}).collect()
    one = spark.createDataFrame([(0.0,)], "v double")
    for kind in ("log", "logit"):
        with pytest.raises(Exception, match="outside the domain"):
            one.select(C.transformed(F.col("v"), kind)).collect()
    with pytest.raises(ValueError):
        D.hold_out(one, F.col("v"), 1.0)
