"""Resampling, distances of any length, sketches and quantiles, against plain versions."""

import math
import random

import numpy as np
import pytest
from gridsift.functions import geodesy as g
from gridsift.operators import distance, resample, sketches
from pyspark.sql import functions as F


@pytest.mark.parametrize(("tile", "band", "share"), [(4, 3, 0.02), (256, 32, 0.1), (5, 64, 0.003)])
def test_distance_equals_all_pairs(spark, tile, band, share):
    rng = random.Random(tile)
    cells = [(r, c) for r in range(-7, 25) for c in range(-3, 40) if rng.random() < 0.9]
    mask = [(r, c) for r in range(-30, 40) for c in range(-40, 60) if rng.random() < share]
    got = distance.to_mask(spark.createDataFrame(cells + cells[:5], "r long, c long"), spark.createDataFrame(mask, "r long, c long"), 2.0, tile, band).collect()
    m = np.array(mask)
    want = {(r, c): 2.0 * math.sqrt(((m - (r, c)) ** 2).sum(axis=1).min()) for r, c in cells}
    assert {(x["r"], x["c"]): x["distance"] for x in got} == pytest.approx(want) and len(got) == len(want)


def test_distance_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "r long, c long"), spark.createDataFrame([(0, 0), (3, 4)], "r long, c long")
    assert [x["distance"] for x in distance.to_mask(some, none).collect()] == [None, None]
    assert distance.to_mask(none, some).count() == 0


def test_lower_envelope():
    rng = np.random.default_rng(2)
    squares = np.where(rng.random((40, 60)) < 0.5, np.inf, rng.integers(0, 900, (40, 60))).astype(float)
    squares[3] = np.inf
    q = np.arange(60)
    want = (((q[:, None] - q[None, :]) ** 2)[None] + squares[:, None, :]).min(axis=2)
    assert np.array_equal(distance.lower_envelope(squares), want)


@pytest.mark.parametrize("north", [45.5, -33.0])
def test_resampling_finds_a_plane(spark, north):
    """A height that is linear in latitude and longitude comes back at each target centre, whatever the tiles."""
    grid = resample.DegreeGrid(30, 40, north, 18.4, 1.2e-5, 1.5e-5)
    height = lambda lat, lon: 100 + 2e4 * (lat - grid.north) + 1e4 * (lon - grid.west)
    cells = spark.createDataFrame([(r, c, None if (r, c) == (10, 10) else height(grid.north - (r + 0.5) * grid.lat_step, grid.west + (c + 0.5) * grid.lon_step)) for r in range(30) for c in range(40) if (r, c) != (20, 5)], "r int, c int, z double")
    target = resample.target_of(spark, grid)
    out = resample.to_utm_grid(cells, grid, target, tile=7).cache()
    assert out.count() == target.rows * target.cols == out.select("r", "c").distinct().count()
    known = out.filter("z is not null").collect()
    assert 0.7 < len(known) / (target.rows * target.cols) < 1
    foot, x = g.from_utm(str(target.zone), "true" if target.is_north else "false", "x", "y")
    back = out.withColumn("_f", F.expr(foot)).withColumn("_x", F.expr(x))
    lat, lon = g.from_utm_steps(str(target.zone), "_f", "_x")
    rows = back.select("z", F.expr(lat).alias("lat"), F.expr(lon).alias("lon")).collect()
    for r in rows:
        v, u = (grid.north - r["lat"]) / grid.lat_step - 0.5, (r["lon"] - grid.west) / grid.lon_step - 0.5
        around = {(math.floor(v) + i, math.floor(u) + j) for i in (0, 1) for j in (0, 1)}
        inside = all(0 <= a < 30 and 0 <= b < 40 for a, b in around) and not around & {(10, 10), (20, 5)}
        assert (r["z"] is not None) == inside
        if inside:
            assert r["z"] == pytest.approx(height(r["lat"], r["lon"]), abs=1e-6)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.973, 1.0])
def test_exact_quantile(spark, monkeypatch, q):
    monkeypatch.setattr(sketches, "FEW", 50)
    rng = random.Random(8)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [float(rng.randint(0, 5)) for _ in range(400)], [7.0] * 200 + [rng.random() for _ in range(900)], [3.0], [float(i) for i in range(60)]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        assert sketches.exact_quantile(rows, "v", q) == pytest.approx(float(np.quantile(values, q)), abs=1e-12)
    assert sketches.exact_quantile(spark.createDataFrame([], "v double"), "v", q) is None


def test_sketches_merge_within_their_errors(spark):
    rng = random.Random(9)
    rows = [(i % 7, rng.randint(0, 5000), rng.gauss(0, 1)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k int, item long, v double").repartition(6)
    stored = sketches.distinct_sketches(df, ["k"], "item")
    for by, exact in ((["k"], {k: len({i for j, i, _ in rows if j == k}) for k in range(7)}), ([], {None: len({i for _, i, _ in rows})})):
        for r in sketches.distinct_of(stored, by).collect():
            n = exact[r["k"] if by else None]
            assert abs(r["estimate"] - n) <= sketches.DISTINCT_ERROR * n
    values = sorted(v for _, _, v in rows)
    got = sketches.quantile_of(sketches.quantile_sketches(df, ["k"], "v"), 0.05).first()
    rank = sum(v <= got["estimate"] for v in values) / len(values)
    assert got["n"] == len(values) and abs(rank - 0.05) <= sketches.RANK_ERROR
