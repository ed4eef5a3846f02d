"""Readers and writers as data sources, and runs as streams."""

import random

import pytest
from gridsift.operators import planning, runs
from gridsift.sources import profiles, tables
from gridsift.streaming import tiles
from pyspark.sql import functions as F


def opened(spark, tile=40):
    tables.register(spark)
    return spark.read.format(tables.CELLS).schema("r long, c long, o_totalprice double").options(path="/root/testdata/sf0.001/orders.parquet", key="o_orderkey", cols="10", tile=str(tile)).load()


def test_windows_of_cells(spark):
    plain = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.expr("o_orderkey div 10").alias("r"), (F.col("o_orderkey") % 10).alias("c"), F.col("o_totalprice").cast("double").alias("o_totalprice"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(opened(spark)) == rows(plain)
    assert opened(spark).rdd.getNumPartitions() == 4
    for where, parts in (("r >= 45 and r < 60 and c = 3", 1), ("r > 100 and c in (1, 2)", 2), ("r = 149 or c = 2", 4), ("r < 0", 0), ("o_totalprice > 1000 and r <= 79", 2), ("r >= 30 and 50 >= r and c > 20", 0)):
        got = opened(spark).filter(where)
        assert rows(got) == rows(plain.filter(where)), where
        assert got.rdd.getNumPartitions() == parts or parts == 0


def test_an_aborted_job_shows_nothing(spark, tmp_path):
    tables.register(spark)
    path, kind = str(tmp_path / "tiles"), "id long"
    save = lambda df, mode="append": df.write.format(tables.TILES).mode(mode).save(path)
    read = lambda: sorted(r["id"] for r in tables.read_tiles(spark, path, kind).collect())
    assert read() == []
    save(spark.range(0, 10, 1, 3))
    with pytest.raises(Exception, match="stop"):
        save(spark.range(10, 20, 1, 4).withColumn("id", F.when(F.col("id") < 19, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long"))))
    assert read() == list(range(10)) and not list((tmp_path / "tiles").glob("_aside*"))
    save(spark.range(20, 25))
    assert read() == [*range(10), *range(20, 25)]
    save(spark.range(3), "overwrite")
    assert read() == [0, 1, 2]
    save(spark.range(0), "overwrite")
    assert read() == []


def test_a_stopped_stream_of_tiles_goes_on(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    cells = spark.createDataFrame([(r, c, c + 0.5, 40 - r - 0.5, z := 100 + rng.uniform(0, 0.05), z) for r in range(40) for c in range(30)], "r long, c long, x double, y double, z double, dsm double").cache()
    args = (spark, cells, 40, 30, profiles.Aircraft(), profiles.Mission())
    want = sorted((r["place"], r["r"], r["c"]) for r in runs.screen(*args, str(tmp_path / "a"), 10).collect())
    whole, done = runs.sites_of, []

    def breaks(step, *more):
        done.extend(r["index"] for r in step.collect())
        if len(done) > 6:
            raise RuntimeError("a lost machine")
        return whole(step, *more)

    monkeypatch.setattr(runs, "sites_of", breaks)
    with pytest.raises(Exception, match="lost machine"):
        tiles.screen(*args, str(tmp_path / "b"), 10, per_step=5)
    monkeypatch.setattr(runs, "sites_of", lambda step, *more: (done.extend(r["index"] for r in step.collect()), whole(step, *more))[1])
    finished = sorted(done)
    done.clear()
    got = tiles.screen(*args, str(tmp_path / "b"), 10, per_step=5)
    assert sorted((r["place"], r["r"], r["c"]) for r in got.collect()) == want
    assert 0 < len(done) < 12 and len(finished) > 5  # what a finished batch had is not done again
    with pytest.raises(ValueError, match="settings"):
        tiles.screen(*args, str(tmp_path / "b"), 10, removed=cells.select("r", "c"))


def test_plans_as_a_table_function(spark):
    planning.register(spark)
    spark.createDataFrame([(1, 30, 20), (2, 7, 50)], "id long, h long, w long").createOrReplaceTempView("extents_of_test")
    got = spark.sql("select id, t.* from extents_of_test, lateral plan_tiles(h, w, 8) t")
    for i, h, w in ((1, 30, 20), (2, 7, 50)):
        assert sorted(tuple(r)[1:] for r in got.filter(F.col("id") == i).collect()) == sorted(map(tuple, planning.tiles(spark, h, w, 8).collect()))
