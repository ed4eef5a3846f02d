"""The entry module, some queries against DuckDB, and streams against their batch form."""

import math

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names_and_oracles():
    import __spark_entry__ as e

    known, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 100


@pytest.mark.parametrize("name", ["flagship_ground_class", "mask_polygon", "utm_inverse", "mgrs_encode", "site_groups", "events_session", "audit_findings", "bilinear_resample", "parse_position", "read_dof", "read_csv_obstacles", "read_geojson_obstacles", "content_digests"])
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = e.queries()[name](spark, DIR), con.sql(e.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple("" if v is None or isinstance(v, float) and math.isnan(v) else str(v) for v in row)
    assert sorted(key(r) for r in got.select(columns).collect()) == sorted(key(r) for r in con.sql(f"select {', '.join(columns)} from ({e.oracle_sql()[name]}) q").fetchall())


def test_stream_equals_batch(spark, tmp_path):
    from gridsift.streaming import live

    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.events_stream(spark, str(tmp_path / "in"), events.schema)
    seen = []
    live.run(live.tumbling(stream), lambda df, _: seen.append(df.collect()), str(tmp_path / "state"), mode="complete")
    batch = {(r["start"], r["event_type"]): r["n"] for r in live.tumbling(events).collect()}
    assert {(r["start"], r["event_type"]): r["n"] for r in seen[-1]} == batch


def test_what_cannot_be_imported_is_left_out():
    import __spark_entry__ as e

    assert e._optional("gridsift.no_such_part") is None and e._optional("json").__name__ == "json"


def test_grid_references(spark):
    """Encoded positions come back within a metre square, on all bands and zones; what is no reference has no kind."""
    from gridsift.functions import geodesy as g
    from gridsift.functions import text
    from pyspark.sql import functions as F

    places = [(lat + 0.37, lon + 0.21) for lat in range(-80, 84, 3) for lon in range(-180, 180, 11)]
    rows = spark.createDataFrame(places, "lat double, lon double").withColumn("zone", F.expr(g.zone("lat", "lon"))).withColumn("band", F.expr(g.band("lat")))
    east, north = g.to_utm("lat", "lon", "zone")
    rows = rows.withColumn("east", F.expr(east)).withColumn("north", F.expr(north)).withColumn("txt", F.expr(g.mgrs("zone", "band", "east", "north")))
    got = rows.select("*", text.parse_position(F.col("txt")).alias("p")).collect()
    assert len(got) == len(places)
    for r in got:
        assert r["p"]["kind"] == "MGRS", r
        metres = math.hypot((r["p"]["lat"] - r["lat"]) * 111320, (r["p"]["lon"] - r["lon"]) * 111320 * math.cos(math.radians(r["lat"])))
        assert metres < 1.2, r
    texts = ["18T VR 45906 30941", "18tvr4590630941", "18T VR 4590 3094", "18T VR 45 30", "18T VR", "61T VR 45906 30941", "18T AR 45906 30941", "18T VR 123", "18T VR 123456 123456", None, "45.4, -75.7"]
    kinds = [r["p"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, txt string").orderBy("i").select(text.parse_position(F.col("txt")).alias("p")).collect()]
    assert [k["kind"] for k in kinds] == ["MGRS"] * 5 + [None] * 5 + ["LATLON"]
    assert all(k["lat"] is None and k["lon"] is None for k in kinds if k["kind"] is None)
    assert all(k["lat"] == pytest.approx(45.4, abs=0.5) and k["lon"] == pytest.approx(-75.7, abs=0.7) for k in kinds[:5])


def test_tiles_reach_the_last_row(spark, monkeypatch):
    """The plan follows the grid's height; the SQL ends at row 15000, where its own plan of tiles does."""
    from gridsift.plans import search
    from pyspark.sql import functions as F

    tall = spark.range(0, 15130).select(F.col("id").alias("r"), F.lit(99).cast("long").alias("c"))
    monkeypatch.setattr(search, "cells", lambda s, d: tall)
    got = {r["index"]: r["cells"] for r in search.QUERIES["tile_coverage"](spark, DIR).collect()}
    assert sum(got.values()) == 15130 and got[375 * 3] == 40 and got[379 * 3] == 10
