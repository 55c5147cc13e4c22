"""What the driver keeps and does: few jobs for components, nothing left of a fit or of a stage."""

import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from ensolith.llm import components as C
from ensolith.llm import simhash, textops, toxicity


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    return calls


def test_stars_need_no_round_and_a_round_that_makes_them_is_the_last(spark, monkeypatch):
    cuts = counted(monkeypatch, C, "cut")
    got = C.components(spark.createDataFrame([(1, 2), (3, 1), (8, 7), (7, 7)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert len(cuts) == 1
    cuts.clear()
    got = C.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1)]
    assert len(cuts) == 2


def test_components_so_far_and_more_links_are_those_of_all_links(spark):
    first, more = [(1, 2), (4, 3), (9, 8)], [(2, 3), (9, 20), (30, 31)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    reach = simhash._joined(None, frame(first))
    want = sorted(map(tuple, C.components(frame(first + more)).collect()))
    assert sorted(map(tuple, simhash._joined(reach, frame(more)).collect())) == want
    assert simhash._joined(reach, frame([])) is reach


def test_the_bitmap_is_destroyed_once_used(spark, sf_dir, monkeypatch):
    made, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: (made.append(real(v)), made[-1])[1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < simhash.drop_near_duplicates(docs).count() < docs.count()
    assert made and not any(b._jbroadcast.isValid() for b in made)


def test_a_fit_and_each_stage_give_the_drivers_memory_back(spark, sf_dir, monkeypatch):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    given = counted(monkeypatch, textops, "give_back_memory")
    model = toxicity.fit(docs, labels)
    assert len(given) == 1
    assert model.ids == sorted(model.ids) and len(model.ids) == len(model.toxic) > 0
    given = counted(monkeypatch, P, "give_back_memory")
    for _, stage in P.STAGES:
        before = len(given)
        stage(spark, docs.where(F.lit(False)), sf_dir)
        assert len(given) == before + 1
    assert all(re.match("[a-z_]+$", f.__name__) and f.__doc__ for _, f in P.STAGES)
