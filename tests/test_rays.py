"""Rays looked up in tiles against a plain loop, and ranks that are worked out once for their groups."""

import math
import random

import pytest
from gridsift.operators import approach
from gridsift.plans import sites
from gridsift.sources.profiles import Aircraft, Mission

AIRCRAFT, MISSION = Aircraft(), Mission()


@pytest.mark.parametrize("tile", [7, 256])
def test_rays_equal_a_loop(spark, tile):
    """Sites in corners, beside missing and unknown cells, and one without elevation; whole heights make equal angles frequent."""
    rng, rows, cols = random.Random(8), 40, 33
    cells = {(r, c): (rng.choice([None, 100.0, 101.0]), rng.choice([None, 102.0, 105.0])) for r in range(rows) for c in range(cols) if rng.random() < 0.8}
    at = [(0, 0, 100.0), (39, 32, 100.0), (20, 16, 98.0), (6, 7, 100.0), (7, 6, None)]
    df = spark.createDataFrame([(r, c, c + 0.5, rows - r - 0.5, e) for r, c, e in at], "r long, c long, x double, y double, elevation double")
    grid = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "r long, c long, z double, dsm double")
    got = {(r["r0"], r["c0"], r["ray"]): r for r in approach.ray_worst(df, grid, rows, AIRCRAFT, MISSION, tile=tile).collect()}
    assert len(got) == len(at) * 72
    for r, c, e in at:
        for ray in range(72):
            seen, turn = [], math.radians(ray * 5.0)
            for d in range(3, 31):
                z, dsm = cells.get((math.floor(rows - (rows - r - 0.5 + math.cos(turn) * d) + 1e-9), math.floor(c + 0.5 + math.sin(turn) * d + 1e-9)), (None, None))
                top = z if dsm is None else dsm
                if top is not None and e is not None:
                    seen.append((math.degrees(math.atan2(top - e - AIRCRAFT.clearance_height_m, d)), -d))
            row = got[r, c, ray]
            assert row["coverage"] == pytest.approx(len(seen) / 28)
            assert row["worst"] == (pytest.approx(max(seen)[0]) if seen else None) and row["distance"] == (-max(seen)[1] if seen else None)
    assert approach.ray_worst(df.limit(0), grid, rows, AIRCRAFT, MISSION, tile=tile).count() == 0
    assert {r["worst"] for r in approach.ray_worst(df, grid.limit(0), rows, AIRCRAFT, MISSION, tile=tile).collect()} == {None}


def test_ranks_of_groups_are_worked_out_once(spark, monkeypatch):
    """Groups read the ranks at several steps: from a table, not from all steps before it each time."""
    ranks = spark.range(5).selectExpr("id + 1 as rank", "concat('S-0', id + 1) as site_id", "id * 10D as x", "0D as y")
    monkeypatch.setattr(sites, "ranked", lambda s, d: ranks)
    got = sites.grouped(spark, "")
    assert "Range (" not in got._jdf.queryExecution().toString()
    assert {(r["rank"], r["root"], r["primary_id"]) for r in got.collect()} == {(i, 1, "S-01") for i in range(1, 6)}
