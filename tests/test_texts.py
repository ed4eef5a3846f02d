"""Parsers and headers on texts as they are found, and audits of single data sets."""

import pytest
from gridsift.functions import crs, text
from gridsift.operators import audit
from gridsift.sources import obstacles, profiles
from pyspark.sql import functions as F

COLUMNS = "folder_key string, kind string, geometry string, path string, epsg int, unit string, cell_w double, cell_h double, bands int, x_min double, y_min double, x_max double, y_max double, nodata double, low double, high double, mean double, features long"


@pytest.mark.parametrize(("txt", "feet", "want"), [("100 ft", False, 30.48), ("30", False, 30.0), ("30 m", True, 30.0), ("12,5 m", False, 12.5), ("tall", False, None), ("", False, None), ("-5", False, None), ("0", False, None), ("45", True, 13.716), ("  7.25 feet", False, 2.2098), ("9'", False, 2.7432), (None, True, None)])
def test_heights(spark, txt, feet, want):
    got = spark.createDataFrame([(txt, feet)], "t string, f boolean").select(text.parse_height(F.col("t"), F.col("f"))).first()[0]
    assert got == (None if want is None else pytest.approx(want, abs=1e-4))


@pytest.mark.parametrize(
    ("txt", "lat", "lon", "kind"),
    [("44.9736, -76.2009", 44.9736, -76.2009, "LATLON"), ("44.9736 N 76.2009 W", 44.9736, -76.2009, "LATLON"), ("N44.9736 W76.2009", 44.9736, -76.2009, "LATLON"), ("76.2009 W, 44.9736 N", 44.9736, -76.2009, "LATLON"),
     ("44°58'25\"N 76°12'03\"W", 44 + 58 / 60 + 25 / 3600, -76 - 12 / 60 - 3 / 3600, "LATLON"), ("", None, None, None), ("words only", None, None, None), ("97, 10", None, None, None), ("-31.4; 20.8", -31.4, 20.8, "LATLON"), ("18T WQ 1234", None, None, None)],
)
def test_positions(spark, txt, lat, lon, kind):
    got = spark.createDataFrame([(txt,)], "t string").select(text.parse_position(F.col("t")).alias("p")).select("p.*").first()
    if kind is None:
        assert got["kind"] in (None, "MGRS")
    else:
        assert (got["lat"], got["lon"], got["kind"]) == (pytest.approx(lat, abs=1e-6), pytest.approx(lon, abs=1e-6), kind)


def test_geojson_of_all_kinds(spark):
    bare = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"MultiPolygon","coordinates":[[[[0,0],[0,4],[4,4],[0,0]],[[1,2],[1,3],[2,3],[1,2]]],[[[9,9],[9,10],[10,10],[9,9]]]]}]}'
    feature = '{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3],[4,4]]]},"properties":{"agl_ft":"10","height":"none"}}'
    polygons, lines, points = obstacles.exclusions(obstacles.from_geojson(spark.createDataFrame([(bare,), (feature,)], "json string")))
    assert sorted((r["ring"], r["i"], r["x"], r["y"]) for r in polygons.collect()) == [(0, 0, 0, 0), (0, 1, 0, 4), (0, 2, 4, 4), (1, 0, 1, 2), (1, 1, 1, 3), (1, 2, 2, 3), (2, 0, 9, 9), (2, 1, 9, 10), (2, 2, 10, 10)]
    assert sorted((r["part"], r["i"], r["x"]) for r in lines.collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3), (1, 2, 4)]
    assert [tuple(r) for r in points.collect()] == [(1, 2)]
    heights = obstacles.from_geojson(spark.createDataFrame([(feature,)], "json string")).select("height_m", "assumed").distinct().collect()
    assert [(round(r["height_m"], 4), r["assumed"]) for r in heights] == [(3.048, False)]


def test_compound_and_newer_well_known_text(spark):
    rows = [
        (1, 'COMPD_CS["both",PROJCS["NAD83 / UTM zone 18N",GEOGCS["NAD83",UNIT["degree",0.0174532925199433]],UNIT["metre",1]],VERT_CS["CGVD2013",VERT_DATUM["CGVD",2005],UNIT["metre",1],AUTHORITY["EPSG","6647"]]]', ("projected", "NAD83 / UTM zone 18N", None, "metre", "18N", "CGVD2013", False)),
        (2, 'PROJCRS["WGS 84 / Pseudo-Mercator",BASEGEOGCRS["WGS 84"],CONVERSION["x"],CS[Cartesian,2],LENGTHUNIT["metre",1],ID["EPSG",3857]]', ("projected", "WGS 84 / Pseudo-Mercator", 3857, "metre", None, None, True)),
        (3, "", (None, None, None, None, None, None, False)),
    ]
    got = spark.createDataFrame([r[:2] for r in rows], "id long, wkt string").select("id", crs.from_wkt(F.col("wkt")).alias("s")).select("id", "s.kind", "s.name", "s.epsg", "s.unit", "s.utm", "s.vertical", "s.web_mercator").orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [r[2] for r in rows]


def test_audit_of_a_sound_pair(spark):
    ground = ("ground", "raster", None, "ground/dtm.tif", 32618, "metre", 1.0, 1.0, 1, 0.0, 0.0, 1000.0, 1000.0, -9999.0, 50.0, 300.0, 120.0, None)
    surface = ("surface", "raster", None, "surface/top.tif", 32618, "metre", 1.0, 1.0, 1, 0.0, 0.0, 1000.0, 1000.0, -9999.0, 50.0, 320.0, 124.0, None)
    table = lambda *rows: spark.createDataFrame(list(rows), COLUMNS)
    assert audit.status(audit.findings(table(ground, surface))).first()["status"] == "READY"
    assert audit.status(audit.findings(table(surface))).first()["status"] == "NOT_READY"
    chosen = {r["folder_key"]: (r["found"], r["path"]) for r in audit.select_inputs(table(ground, surface, surface)).collect()}
    assert chosen == {"ground": (1, "ground/dtm.tif"), "surface": (2, None)}


def test_profiles_of_several_kinds(spark):
    from dataclasses import replace

    small = profiles.Aircraft()
    rows = profiles.as_table(spark, replace(small, name="a"), replace(small, name="odd", ring_obstacle_height_m=0.1, unsuitable_angle_deg=2.0))
    got = {r["name"]: r["problems"] for r in profiles.validate(rows, profiles.AIRCRAFT_RULES).collect()}
    assert got == {"a": [], "odd": ["ring obstacle limit must be at least the pad's", "unsuitable angle must be above the suitable one"]}


def test_known_columns(spark):
    rows = [("a", "45", "-75", "100"), ("b", "46", "-76", None)]
    for tall, height in (("AGLHGT", 100.0), ("Struct_HT", 100.0), ("hgt_ft", 30.48), ("Overall Height Above Ground", 100.0)):
        got = obstacles.from_table(spark.createDataFrame(rows, f"obst_type string, `Lat_DD` string, lng string, `{tall}` string")).orderBy("name").collect()
        assert [(r["name"], r["lat"], r["lon"], round(r["height_m"], 2), r["assumed"]) for r in got] == [("a", 45.0, -75.0, height, False), ("b", 46.0, -76.0, 30.0, True)]
