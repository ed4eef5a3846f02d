"""Closed forms and equalities of the terrain, mask and selection operators."""

import math
import random

import pytest
from gridsift.operators import classify, masks, planning, scoring, spatial, terrain
from gridsift.sources import profiles
from pyspark.sql import functions as F


def grid(spark, rows, cols, z, dsm=None):
    data = [(r, c, c + 0.5, rows - r - 0.5, z(r, c), (dsm or z)(r, c)) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(data, "r long, c long, x double, y double, z double, dsm double")


def test_offsets_and_rectangles():
    assert len(terrain.disk_offsets(3)) == 29 and len(terrain.disk_offsets(6)) == 113
    assert terrain.spans(terrain.disk_offsets(3)) == {-3: 0, -2: 2, -1: 2, 0: 3, 1: 2, 2: 2, 3: 0}
    assert set(terrain.rectangle_spans(6)) <= set(range(-6, 7))


def test_plane_slope_aspect_and_roughness(spark):
    rise = math.tan(math.radians(4))
    got = terrain.analyze(grid(spark, 12, 12, lambda r, c: 50 + rise * c), profiles.Aircraft()).filter("r = 6 and c = 6").first()
    assert got["slope"] == pytest.approx(4, abs=1e-6) and got["aspect"] == pytest.approx(270, abs=1e-6)
    assert got["roughness"] == pytest.approx(0, abs=1e-5) and got["valid_fraction"] == 1


@pytest.mark.parametrize("tile", [4, 256])
def test_windows_equal_the_plain_join(spark, tile):
    rng = random.Random(1)
    heights = {(r, c): None if rng.random() < 0.1 else rng.uniform(95, 105) for r in range(9) for c in range(9)}
    cells = grid(spark, 9, 9, lambda r, c: heights[r, c])
    fast = {(x["r"], x["c"]): x for x in terrain.plane_moments(cells, 2.0, tile=tile).collect()}
    assert len(fast) == 81
    slow = terrain.disk_join(cells.withColumn("zc", F.col("z") - 100), 2.0, ["zc"]).groupBy("r", "c").agg(F.count("zc").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("zc")).alias("sxz"), F.sum(F.col("y") * F.col("zc")).alias("syz"))
    for x in slow.filter("r between 0 and 8 and c between 0 and 8").collect():
        assert [fast[x["r"], x["c"]][k] for k in ("n", "sx", "sxz", "syz")] == pytest.approx([x[k] for k in ("n", "sx", "sxz", "syz")])


def test_tiles_leave_no_seams(spark):
    rng = random.Random(2)
    heights = {(r, c): None if rng.random() < 0.1 else rng.uniform(95, 105) for r in range(15) for c in range(15)}
    cells = grid(spark, 15, 15, lambda r, c: heights[r, c], lambda r, c: heights[r, c] and heights[r, c] + (r * c) % 7).filter("r * c != 20")
    order = lambda df: [tuple(x) for x in df.orderBy("r", "c").collect()]
    whole, cut = order(terrain.analyze(cells, profiles.Aircraft())), order(terrain.analyze(cells, profiles.Aircraft(), tile=5))
    assert len(whole) == cells.count()
    for x, y in zip(whole, cut, strict=True):
        assert [v is None for v in x] == [v is None for v in y]
        assert [v or 0 for v in x] == pytest.approx([v or 0 for v in y], abs=1e-7)
    tops = {(x[0], x[1]): x[10] for x in whole}
    h = {(x["r"], x["c"]): max(x["dsm"] - x["z"], 0.0) for x in cells.collect() if x["z"] is not None}
    span = terrain.rectangle_spans(3.0)
    for (r, c), top in tops.items():
        assert top == max((v for dr, w in span.items() for d in range(-w, w + 1) if (v := h.get((r + dr, c + d))) is not None), default=None)


def test_classes_and_reasons_agree(spark):
    cells = grid(spark, 14, 14, lambda r, c: None if r == 3 else 100.0 + (0.3 * c if c > 8 else 0), lambda r, c: 100.0 + (0.3 * c if c > 8 else 0) + (5 if (r, c) == (8, 3) else 0))
    got = classify.classify(terrain.analyze(cells, profiles.Aircraft()), profiles.Aircraft(), profiles.Mission()).collect()
    assert all((x["reason"] == 0) == (x["ground"] == 1) and (x["reason"] == 1) == (x["ground"] == 2) and (x["zc"] is None) == (x["ground"] == 255) for x in got)


def test_polygon_with_hole_and_lines(spark):
    square = lambda ring, low, high: [(0, ring, i, x, y) for i, (x, y) in enumerate([(low, low), (high, low), (high, high), (low, high)])]
    shape = spark.createDataFrame(square(0, 0.0, 100.0) + square(1, 40.0, 60.0), "fid long, ring long, i long, x double, y double")
    cells = spark.range(120 * 120).selectExpr("id div 120 as r", "id % 120 as c", "id % 120 + 0.5D as x", "120 - id div 120 - 0.5D as y", "0D as z", "0D as dsm")
    assert masks.polygon_cells(shape, cells).count() == 9600
    line = spark.createDataFrame([(0, 0, 0, 10.5, 50.5), (0, 0, 1, 90.5, 50.5)], "fid long, part long, i long, x double, y double")
    assert masks.line_cells(line, cells, F.lit(120.0), 0.0).count() == 81
    wide = masks.line_cells(line, cells, F.lit(120.0), 10.0)
    assert wide.filter("c = 50").count() == 11


def test_greedy_selections_equal_a_loop(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 200), rng.uniform(0, 200), rng.random(), rng.random() < 0.6) for i in range(150)]
    df = spark.createDataFrame(points, "id long, x double, y double, worse double, passes boolean")
    kept = []
    for p in sorted(points, key=lambda p: (p[3], p[0])):
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 >= 400 - 1e-9 for q in kept):
            kept.append(p)
    assert {r["id"] for r in spatial.suppress(df, 20.0, ["worse"]).collect()} == {p[0] for p in kept}


@pytest.mark.parametrize(("wide", "narrow", "tile"), [(4.0, 1.5, 8), (2.0, 5.0, 6), (6.0, 1.0, 256)])
def test_examining_cells_equals_a_loop(spark, wide, narrow, tile):
    """Chains of cells that hang on one another go across many tiles: quality falls along the rows. Ties are frequent."""
    rng = random.Random(int(wide))
    cells = [(r, c, part, round(1 - c / 60 + rng.choice([0, 0.01, 0.5]), 2), rng.random() < 0.6) for part in (3, 8) for r in range(30) for c in range(-10, 40) if rng.random() < 0.8]
    seen, blocks = [], []
    for r, c, part, _, ok in sorted(cells, key=lambda p: (-p[3], p[0], p[1])):
        if all(part != p or (r - y) ** 2 + (c - x) ** 2 > d * d + 1e-9 for y, x, p, d in blocks):
            seen.append((r, c, part))
            blocks.append((r, c, part, wide if ok else narrow))
    df = spark.createDataFrame(cells, "r long, c long, part long, quality double, passes boolean")
    got = spatial.examine_and_block(df, wide, narrow, within="part", tile=tile)
    assert sorted(tuple(x) for x in got.select("r", "c", "part").collect()) == sorted(seen)
    assert spatial.examine_and_block(df.limit(0), wide, narrow).count() == 0


def test_groups_of_cells(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (1, 2), (5, 5), (6, 4), (9, 9)], "r long, c long")
    assert sorted(r["count"] for r in spatial.cell_groups(cells).groupBy("root").count().collect()) == [1, 2, 3]


def test_tiles_cover_the_grid_once(spark):
    tiles = planning.tiles(spark, 151, 97, 40).collect()
    assert sum((t["r1"] - t["r0"]) * (t["c1"] - t["c0"]) for t in tiles) == 151 * 97


def test_profiles():
    assert profiles.check(profiles.Aircraft()) and profiles.compatible(profiles.Aircraft(), profiles.Mission())
    with pytest.raises(profiles.ProfileError, match="suitable"):
        profiles.check(profiles.Aircraft(unsuitable_angle_deg=2.0))
    with pytest.raises(profiles.ProfileError):
        profiles.resize(profiles.Aircraft(), diameter=1000.0)
    assert profiles.resize(profiles.Aircraft(), ring=8.0).cleared_ring_m == 8.0
    assert planning.signature({"a": 1, "b": 2}) == planning.signature({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        planning.require_same("x", {"a": 1})


def test_density_altitude(spark):
    row = spark.range(1).select(scoring.density_altitude_ft(F.lit(0.0), F.lit(29.92), F.lit(15.0)).alias("a"), scoring.density_altitude_ft(F.lit(1000.0), F.lit(29.92), F.lit(35.0)).alias("b"), scoring.density_altitude_ft(F.lit(0.0), F.lit(1013.0), F.lit(15.0)).alias("c")).first()
    assert abs(row["a"]) < 1 and 5500 < row["b"] < 6800 and row["c"] is None
