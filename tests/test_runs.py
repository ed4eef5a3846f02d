"""Runs that are stopped and taken up again, streams against their batch form, coordinate systems, and files that are read."""

import dataclasses
import datetime
import math
import random
import threading
import time

import pytest
from gridsift.functions import geodesy as g
from gridsift.operators import digests, masks, planning, runs, spatial, storage
from gridsift.sources import obstacles, profiles, sinks
from gridsift.streaming import live
from pyspark.sql import functions as F


def ground(spark, rows, cols):
    rng = random.Random(4)
    data = [(r, c, c + 0.5, rows - r - 0.5, z := 100 + 0.02 * c + rng.uniform(0, 0.05), z + (3 if (r * 7 + c * 3) % 101 == 0 else 0)) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(data, "r long, c long, x double, y double, z double, dsm double").cache()


def test_a_stopped_run_ends_like_one_that_was_not(spark, tmp_path):
    cells, small = ground(spark, 40, 30), profiles.Aircraft()
    go = lambda folder, **more: runs.screen(spark, cells, 40, 30, small, profiles.Mission(), str(tmp_path / folder), 10, **more)
    rows = lambda df: sorted((x["place"], x["r"], x["c"], x["quality"]) for x in df.collect())
    whole = rows(go("a", per_step=5))
    assert len(whole) > 3
    assert go("b", per_step=2, steps=2) is None
    done = runs.TiledRun(spark, str(tmp_path / "b"), runs.settings_of(cells, 40, 30, small, profiles.Mission(), 10), spark.range(12).toDF("index"))
    assert sorted(r["index"] for r in done.finished().collect()) == [1, 2, 3, 4]
    # a tile that was written but not listed is written again
    spark.read.parquet(str(tmp_path / "b" / "sites")).filter("index = 1").withColumn("index", F.lit(5)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index").parquet(str(tmp_path / "b" / "sites"))
    assert rows(go("b", per_step=3)) == whole
    for a in whole:  # sites of different tiles are apart as well
        assert all(a == b or math.hypot(a[1] - b[1], a[2] - b[2]) >= small.tdp_diameter_m - 1e-6 for b in whole)
    with pytest.raises(ValueError, match="settings"):
        runs.screen(spark, cells, 40, 30, dataclasses.replace(small, max_roughness_m=0.2), profiles.Mission(), str(tmp_path / "b"), 10)
    removed = cells.filter("c < 15").select("r", "c")
    assert all(x[2] >= 15 for x in rows(go("c", removed=removed)))


def test_a_run_with_other_inputs_is_not_taken_up(spark, tmp_path):
    cells, small = ground(spark, 20, 20), profiles.Aircraft()
    go = lambda cells=cells, **more: runs.screen(spark, cells, 20, 20, small, profiles.Mission(), str(tmp_path / "a"), 10, **more)
    all_cells, tower = cells.select("r", "c"), spark.createDataFrame([(1.0, 2.0)], "x double, agl_m double")
    assert go(steps=0) is None
    assert go(cells.repartition(7), steps=0) is None  # equal content in another order
    for other in ({"removed": all_cells}, {"inputs": {"obstacles": tower}}, {"cells": cells.withColumn("z", F.when(F.col("r") == 3, F.col("z") + 1e-9).otherwise(F.col("z")))}, {"cells": cells.unionByName(cells.limit(1))}):
        with pytest.raises(ValueError, match="settings"):
            go(**other, steps=0)


def test_a_run_without_sites_has_no_rows(spark, tmp_path):
    cells = ground(spark, 20, 20)
    out = runs.screen(spark, cells, 20, 20, profiles.Aircraft(), profiles.Mission(), str(tmp_path / "a"), 10, removed=cells.select("r", "c"))
    assert out.count() == 0 and {"place", "r", "c", "quality"} <= set(out.columns)
    assert runs.screen(spark, cells, 20, 20, profiles.Aircraft(), profiles.Mission(), str(tmp_path / "a"), 10, removed=cells.select("r", "c")).count() == 0


def test_progress_and_cancelling(spark, tmp_path):
    cells = ground(spark, 40, 30)
    go = lambda folder, **more: runs.screen(spark, cells, 40, 30, profiles.Aircraft(), profiles.Mission(), str(tmp_path / folder), 10, per_step=4, **more)
    told = []
    whole = go("a", progress=lambda done, all_: told.append((done, all_))).orderBy("place").collect()
    assert told == [(0, 12), (4, 12), (8, 12), (12, 12)]

    def stop(done, _):
        if done == 4:  # from now on the run's jobs are stopped, as by another thread
            threading.Thread(target=lambda: [(time.sleep(0.2), spark.sparkContext.cancelJobsWithTag("screening")) for _ in range(40)], daemon=True).start()

    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        go("b", progress=stop, tag="screening")
    assert "screening" not in spark.sparkContext.getJobTags()
    time.sleep(9)  # the other thread ends
    told.clear()
    assert go("b", progress=lambda done, all_: told.append(done)).orderBy("place").collect() == whole
    assert told[0] in (4, 8)


def test_tiles_by_arithmetic(spark):
    for rows, cols, px in ((151, 97, 40), (7, 3, 2), (40, 30, 100), (1000, 1, 7)):
        cells = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c")).withColumn("at", planning.tile_of(F.col("r"), F.col("c"), rows, cols, px))
        assert cells.join(planning.tiles(spark, rows, cols, px), F.expr("r >= r0 and r < r1 and c >= c0 and c < c1")).filter("at = index").count() == rows * cols


def test_digests(spark):
    rows = [(1, "a", 0.0), (2, None, 1.5), (2, None, 1.5), (3, "", None)]
    of = lambda rows, kind="i long, s string, d double": digests.text_of(spark.createDataFrame(rows, kind))
    assert of(rows) == of(rows[::-1]) == of([(1, "a", -0.0), *rows[1:]])
    assert len({of(x) for x in (rows, rows[:3], rows[1:], [*rows, rows[0]], [(1, "a", 1e-300), *rows[1:]], [*rows[:3], (3, None, None)], [])}) == 7
    assert of([("ab", "c")], "a string, b string") != of([("a", "bc")], "a string, b string")


def test_tiled_exact_metrics_leave_no_seams(spark):
    from gridsift.operators import terrain

    cells = ground(spark, 24, 24).filter("r * c != 35")
    centres = cells.select("r", "c", (F.col("r") * 2.0).alias("quality"))
    order = lambda df: [tuple(x) for x in df.orderBy("r", "c").collect()]
    whole, cut = order(terrain.exact_metrics(cells, centres, profiles.Aircraft())), order(terrain.exact_metrics(cells, centres, profiles.Aircraft(), tile=7))
    assert len(whole) == centres.count()
    for a, b in zip(whole, cut, strict=True):
        assert [v is None for v in a] == [v is None for v in b] and [v or 0 for v in a] == pytest.approx([v or 0 for v in b], abs=1e-9)


@pytest.mark.parametrize(("radius", "tile"), [(0.0, 256), (1.0, 4), (3.5, 5), (9.0, 256)])
def test_growing_a_mask_equals_all_pairs(spark, radius, tile):
    rng = random.Random(5)
    mask = {(rng.randint(-10, 30), rng.randint(-10, 30)) for _ in range(12)}
    want = {}
    for r, c in mask:
        k = int(radius)
        for dr in range(-k, k + 1):
            for dc in range(-k, k + 1):
                if dr * dr + dc * dc <= radius * radius + 1e-9:
                    want[r + dr, c + dc] = min(want.get((r + dr, c + dc), 1 << 30), dr * dr + dc * dc)
    got = masks.grow(spark.createDataFrame([*mask, next(iter(mask))], "r long, c long"), radius, tile).collect()
    assert {(x["r"], x["c"]): x["d2"] for x in got} == want and len(got) == len(want)


def test_many_centres_meet_points_in_bins(spark, monkeypatch):
    rng = random.Random(6)
    points = spark.createDataFrame([(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(80)] + [(99, 5000.0, 5000.0)], "id long, x double, y double")
    circles = spark.createDataFrame([(i, rng.uniform(0, 100), rng.uniform(0, 100), 3.0) for i in range(40)], "id long, x double, y double, radius double")
    rows = lambda: sorted((r["id"], r["centre"], round(r["distance"], 6)) for r in masks.nearest_centre(points, circles).collect())
    few = rows()
    monkeypatch.setattr(masks, "FEW_CENTRES", 5)
    assert rows() == few and len(few) == 81
    for most in (5, 1000):  # points without a position, and no centres: the same rows either way
        monkeypatch.setattr(masks, "FEW_CENTRES", most)
        odd = points.limit(3).unionByName(spark.createDataFrame([(500, None, 1.0)], "id long, x double, y double"))
        assert {r["id"]: r["centre"] for r in masks.nearest_centre(odd, circles).collect()}[500] is None
        assert [r["centre"] for r in masks.nearest_centre(odd, circles.limit(0)).collect()] == [None] * 4
    monkeypatch.setattr(masks, "FEW_CENTRES", 5)
    cells = points.select(F.col("id").alias("r"), F.lit(0).alias("c"), "x", "y")
    inside = {r["r"] for r in masks.circle_cells(cells, circles, bin_m=4.0).collect()}
    centres, all_points = circles.collect(), points.collect()
    assert inside == {p["id"] for p in all_points if any(math.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= 3 for q in centres)}


def test_boxes_meet_once(spark):
    rng = random.Random(7)
    boxes = [(i, x := rng.uniform(-20, 20), x + rng.uniform(0, 9), y := rng.uniform(-20, 20), y + rng.uniform(0, 9)) for i in range(40)]
    a = spark.createDataFrame(boxes, "i long, x0 double, x1 double, y0 double, y1 double")
    boxes += [(100, -1e6, 1e6, -1e6, 1e6), (101, 5.0, 5.0, 5.0, 5.0), (102, -3000.0, 4.0, 2.0, 2.0)]  # wide ones and a point touch few bins too
    a = spark.createDataFrame(boxes, "i long, x0 double, x1 double, y0 double, y1 double")
    got = [(r["i"], r["j"]) for r in spatial.boxes_meet(a, a.toDF("j", "u0", "u1", "v0", "v1"), 3.0).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p[0], q[0]) for p in boxes for q in boxes if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]}


def test_streams_equal_their_batch_form(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 250).parquet(str(tmp_path / "in"))
    stream = lambda: live.events_stream(spark, str(tmp_path / "in"), events.schema, 100)
    closed = events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=1)  # what the watermark has passed

    def streamed(name, df, mode="append"):
        out = []
        live.run(df, lambda part, _: out.extend(part.collect()), str(tmp_path / name), mode)
        return out

    got = streamed("sliding", live.sliding(stream()), "complete")
    assert {(r["start"], r["n"]) for r in got} >= {(r["start"], r["n"]) for r in live.sliding(events).collect()}
    got = streamed("sessions", live.sessions(stream()))  # append: sessions that no late event can change
    # not filtered in Spark, which would test single events before they make sessions
    assert {(r["user_id"], r["start"], r["n"]) for r in got} == {(r["user_id"], r["start"], r["n"]) for r in live.sessions(events).collect() if r["end"] < closed}
    got = streamed("once", live.deduplicated(stream().unionByName(stream())))
    assert sorted(r["event_id"] for r in got) == sorted(r["event_id"] for r in events.collect())


def test_late_events_are_left_out(spark, tmp_path):
    row = lambda i, hour: (i, f"2024-01-01 {hour:02d}:00:00", 1, "x", 1.0, "")
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    for rows in ([row(1, 0), row(2, 20)], [row(3, 21)], [row(4, 1)], [row(5, 23)], [row(6, 23)]):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    events = spark.read.parquet(str(tmp_path / "in"))
    out = []
    live.run(live.tumbling(live.events_stream(spark, str(tmp_path / "in"), events.schema, 1), "1 hour"), lambda part, _: out.extend(part.collect()), str(tmp_path / "state"))
    hours = {r["start"].hour for r in out}
    assert {0, 20} <= hours and 1 not in hours  # the event of 1 o'clock came after the watermark had passed it


def test_overview_of_a_stream_of_cells(spark, tmp_path):
    rows = [(r, c, float(r + c), float(c % 5), (r * c) % 4 if r % 3 else 255) for r in range(30) for c in range(20)]
    cells = spark.createDataFrame(rows, "r long, c long, zc double, slope double, ground int")
    cells.repartition(6).write.parquet(str(tmp_path / "in"))
    seen = []
    live.run(live.overview(spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 8), lambda df, _: seen.append(df.collect()), str(tmp_path / "state"), "complete")
    rounded = lambda rs: sorted((r["br"], r["bc"], r["cells"], r["valid"], r["passing"], round(r["slope_mean"], 9), r["elev_range"]) for r in rs)
    assert len(seen) > 1 and rounded(seen[-1]) == rounded(live.overview(cells, 8).collect())


def test_obstacle_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name; LAT ;Lon;height_ft\nmast;45.5;-75.5;100\npole;46;-76;\nbad;x;1;2\n")
    (tmp_path / "b.dat").write_text("heading\n01-000001 O US CA SOMEWHERE        45 25 25.00N 075 42 03.00W WIND TURBINE       1 00500 00900 R N A 2020123\n01-000002 O US CA SOMEWHERE        45 25 25.00N 075 42 03.00W MAST       1 00500 00900 R N D 2020123\n")
    (tmp_path / "c.geojson").write_text('{"type":"Feature","geometry":{"type":"Point","coordinates":[10,50]},"properties":{"height":"45"}}')
    got = {r["name"]: (r["lon"], r["lat"], round(r["height_m"], 2), r["assumed"], r["source"].rsplit("/", 1)[-1]) for r in obstacles.read_all(spark, [str(tmp_path / n) for n in ("a.csv", "b.dat", "c.geojson")]).collect()}
    assert got == {"mast": (-75.5, 45.5, 30.48, False, "a.csv"), "pole": (-76.0, 46.0, 30.0, True, "a.csv"), "WIND TURBINE 01-000001": (pytest.approx(-75.700833, abs=1e-6), pytest.approx(45.423611, abs=1e-6), 152.4, False, "b.dat"), "feature 0": (10.0, 50.0, 45.0, False, "c.geojson")}
    with pytest.raises(ValueError, match="shp"):
        obstacles.read(spark, str(tmp_path / "d.shp"))


def test_sinks(spark, tmp_path):
    cells = ground(spark, 12, 9)
    sinks.write_cells(cells, str(tmp_path / "cells"), 5)
    back = spark.read.parquet(str(tmp_path / "cells"))
    assert back.count() == 108 and back.filter("tile_r = 1 and tile_c = 0").agg(F.min("r"), F.max("c")).first()[:] == (5, 4)
    sinks.write_rejections(spark.createDataFrame([(3, 5), (2, 7)], "reason int, cells long"), str(tmp_path / "why"))
    assert [r["reason"] for r in spark.read.csv(str(tmp_path / "why"), header=True).collect()] == ["2", "3"]
    assert sinks.metadata({"b": float("nan"), "a": (1, {"x": 2})}) == '{\n "a": [\n  1,\n  {\n   "x": 2\n  }\n ],\n "b": null\n}'


def test_published_positions(spark):
    """A tower whose grid position is published, and a monument, by a series of sixth order in the third flattening."""
    rows = spark.createDataFrame([(43.642567, -79.387139, 630084, 4833439, "17T PJ"), (38.889484, -77.035278, 323480, 4306481, "18S UJ")], "lat double, lon double, e int, n int, square string")
    rows = rows.withColumn("zone", F.expr(g.zone("lat", "lon"))).withColumn("band", F.expr(g.band("lat")))
    east, north = g.to_utm("lat", "lon", "zone")
    for r in rows.withColumn("east", F.expr(east)).withColumn("north", F.expr(north)).withColumn("mgrs", F.expr(g.mgrs("zone", "band", "east", "north"))).collect():
        assert r["east"] == pytest.approx(r["e"], abs=3) and r["north"] == pytest.approx(r["n"], abs=3) and r["mgrs"].startswith(r["square"])


def test_scratch_deletes_what_was_opened_in_it(spark):
    kept = storage.Store(spark, "kept")
    one = kept.put("a", spark.range(3))
    with storage.scratch():
        inner = storage.Store(spark, "inner")
        inner.put("b", spark.range(4))
        assert storage.exists(spark, inner.root)
    assert not storage.exists(spark, inner.root) and one.count() == 3
    kept.close()
    assert not storage.exists(spark, kept.root)
