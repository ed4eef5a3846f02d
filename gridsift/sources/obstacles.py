"""Obstacle lists: fixed-layout text records, CSV and GeoJSON, all as rows name, lon, lat, height_m, assumed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.functions.text import FEET, field_in_feet, parse_height

DEFAULT_HEIGHT_M, LEVEL_M = 30.0, 3.0
# Column names that are looked for, in order, without case and white space.
HEIGHT_FIELDS = (
    "agl", "agl_m", "agl_ft", "aglhgt", "agl_hgt", "height_agl", "hgt_agl", "obst_agl", "overallheightaboveground", "overall_height", "struct_ht", "structht",
    "structure_height", "obstacle_height", "height", "height_m", "height_ft", "hgt", "ht", "hgt_m", "hgt_ft", "heightm", "heightft",
)
LAT_FIELDS = ("lat", "latitude", "y", "lat_dd", "latitude_dd")
LON_FIELDS = ("lon", "lng", "long", "longitude", "x", "lon_dd", "longitude_dd")
NAME_FIELDS = ("name", "obstacle_name", "type", "obst_type", "obstacle_type", "description", "desc", "id", "oas")


def column_of(names: list[str], known: tuple[str, ...]) -> str | None:
    """The column that has the first of the known names that there is, without case and white space; None if there is none."""
    plain = lambda name: "".join(name.lower().split())
    there = {plain(n): n for n in names}
    return next((there[k] for k in map(plain, known) if k in there), None)


def within(rows: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows in the closed box (west, south, east, north)."""
    return rows if box is None else rows.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def _height(value, default_m: float):
    """height_m and whether it is assumed."""
    return F.coalesce(value, F.lit(default_m)).alias("height_m"), value.isNull().alias("assumed")


def from_records(lines: DataFrame, default_m: float = DEFAULT_HEIGHT_M, box=None) -> DataFrame:
    """Obstacles of records line(line) of words: number, place, position, type, quantity, heights in feet above ground and sea level, remarks.

    The word that ends the latitude is the first number with N or S; a record has the degrees and minutes before it and
    a longitude of three words after it. The type goes up to three words of digits: quantity and heights. A D before a
    word of seven digits marks a dismantled obstacle, which goes.
    """
    place = lambda words, test: F.get(F.filter(F.transform(words, lambda w, i: F.when(test(w, i), i)), lambda i: i.isNotNull()), F.lit(0))
    word = lambda words, i: F.get(words, i)
    digits = lambda w, most: F.coalesce(w.rlike(f"^[0-9]{{1,{most}}}$"), F.lit(False))
    rows = lines.select("line", F.split(F.trim("line"), r"\s+").alias("w"))
    rows = rows.withColumn("at", place(F.col("w"), lambda w, i: w.rlike(r"^[0-9]{2}(?:\.[0-9]+)?[NS]$"))).filter(F.col("at") >= 2)
    rows = rows.withColumn("tail", F.slice("w", F.col("at") + 5, F.size("w"))).filter(word(F.col("w"), F.col("at") + 3).rlike(r"^[0-9]{2}(?:\.[0-9]+)?[EW]$"))
    tail = F.col("tail")
    rows = rows.withColumn("q", place(tail, lambda w, i: digits(w, 9) & digits(word(tail, i + 1), 5) & digits(word(tail, i + 2), 5))).filter("q is not null")
    gone = place(tail, lambda w, i: (w == "D") & digits(word(tail, i + 1), 7) & (i > F.col("q")))
    angle = lambda i, negative: (word(F.col("w"), i - 2).try_cast("double") + word(F.col("w"), i - 1).try_cast("double") / 60 + F.regexp_extract(word(F.col("w"), i), "^[0-9.]+", 0).try_cast("double") / 3600) * F.when(F.endswith(word(F.col("w"), i), F.lit(negative)), -1.0).otherwise(1.0)
    feet = word(tail, F.col("q") + 1).try_cast("double")
    name = F.concat_ws(" ", F.array_join(F.slice(tail, F.lit(1), F.col("q")), " "), word(F.col("w"), F.lit(0)))
    out = rows.filter(gone.isNull()).select(name.alias("name"), angle(F.col("at") + 3, "W").alias("lon"), angle(F.col("at"), "S").alias("lat"), *_height(F.when(feet > 0, feet * FEET), default_m))
    return within(out.filter("lat is not null and lon is not null"), box)


def from_table(table: DataFrame, feet: bool = False, default_m: float = DEFAULT_HEIGHT_M, box=None, height: str | None = None) -> DataFrame:
    """Obstacles of a table with columns for position and perhaps name and height; rows without a position go."""
    lat, lon = column_of(table.columns, LAT_FIELDS), column_of(table.columns, LON_FIELDS)
    if not lat or not lon:
        raise ValueError(f"no latitude and longitude among {table.columns}")
    name, tall = column_of(table.columns, NAME_FIELDS), column_of(table.columns, (height,) if height else HEIGHT_FIELDS)
    number = lambda c: F.trim(F.col(c).cast("string")).try_cast("double")
    value = parse_height(F.col(tall).cast("string"), field_in_feet(F.lit(tall), F.lit(feet))) if tall else F.lit(None).cast("double")
    out = table.select((F.col(name).cast("string") if name else F.lit("")).alias("name"), number(lon).alias("lon"), number(lat).alias("lat"), *_height(value, default_m))
    return within(out.filter("lat between -90 and 90 and lon between -180 and 180"), box)


_GEOMETRY = "type: string, coordinates: string, geometries: array<struct<type: string, coordinates: string>>"


def from_geojson(texts: DataFrame, default_m: float = DEFAULT_HEIGHT_M, feet: bool = False) -> DataFrame:
    """fid, kind, part, i, lon, lat, height_m, assumed: vertices of the features of GeoJSON documents json(json).

    A document is a collection of features, a feature or a bare geometry; geometries are points, lines and polygons,
    their multiples and collections of them. Heights are taken from the first of HEIGHT_FIELDS that a feature has,
    else from building:levels at 3 m each. fid counts features, and geometries of collections on from them.
    """
    feature = f"geometry: struct<{_GEOMETRY}>, properties: map<string, string>"
    document = F.from_json("json", f"struct<type: string, features: array<struct<{feature}>>, {feature}, {_GEOMETRY.removeprefix('type: string, ')}>")
    null = F.lit(None).cast("map<string,string>")
    bare = lambda d: F.struct(F.struct(d["type"], d["coordinates"], d["geometries"]).alias("geometry"), null.alias("properties"))
    alone = lambda d: F.struct(d["geometry"].alias("geometry"), d["properties"].alias("properties"))
    features = lambda d: F.when(d["features"].isNotNull(), d["features"]).when(d["geometry"].isNotNull(), F.array(alone(d))).otherwise(F.array(bare(d)))
    # a collection is as many features as it has geometries
    members = lambda g: F.when(g["geometries"].isNotNull(), g["geometries"]).otherwise(F.array(F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates"))))
    single = F.transform(features(F.col("d")), lambda f: F.transform(members(f["geometry"]), lambda g: F.struct(g.alias("geometry"), f["properties"].alias("properties"))))
    rows = texts.select(document.alias("d")).select(F.posexplode(F.flatten(single)).alias("fid", "f"))
    said = F.transform(F.array(*map(F.lit, HEIGHT_FIELDS)), lambda name: parse_height(F.col("f.properties")[name], field_in_feet(name, F.lit(feet))))
    tall = F.get(F.array_compact(said), F.lit(0))
    levels = F.col("f.properties")["building:levels"].try_cast("double") * LEVEL_M
    rows = rows.select("fid", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("text"), *_height(F.coalesce(tall, F.when(levels > 0, levels)), default_m))
    point, line, area, many = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parse = lambda schema: F.from_json("text", schema)
    parts = (
        F.when(F.col("kind") == "Point", F.array(F.array(parse(point))))
        .when(F.col("kind").isin("MultiPoint"), F.transform(parse(line), lambda p: F.array(p)))
        .when(F.col("kind") == "LineString", F.array(parse(line)))
        .when(F.col("kind").isin("MultiLineString", "Polygon"), parse(area))
        .when(F.col("kind") == "MultiPolygon", F.flatten(parse(many)))
    )
    vertices = rows.select("fid", "kind", "height_m", "assumed", F.posexplode(parts).alias("part", "p")).select("fid", "kind", "height_m", "assumed", "part", F.posexplode("p").alias("i", "v"))
    return vertices.select("fid", "kind", "part", "i", F.element_at("v", 1).alias("lon"), F.element_at("v", 2).alias("lat"), "height_m", "assumed")


def exclusions(vertices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """polygons(fid, ring, i, x, y), lines(fid, part, i, x, y) and points(x, y) of from_geojson's vertices, for masks; rings without their closing vertex."""
    at = lambda *kinds: vertices.filter(F.col("kind").isin(*kinds)).select("fid", "part", F.col("i").cast("long").alias("i"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    whole = Window.partitionBy("fid", "part")
    rings = at("Polygon", "MultiPolygon").withColumn("last", F.max("i").over(whole)).filter("i < last").drop("last").withColumnRenamed("part", "ring")
    return rings, at("LineString", "MultiLineString"), at("Point", "MultiPoint").select("x", "y")


def read(spark: SparkSession, path: str, feet: bool = False, default_m: float = DEFAULT_HEIGHT_M) -> DataFrame:
    """Obstacles of a file by its ending: .dat records, .csv or .txt tables, .json or .geojson points."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "dat":
        return from_records(spark.read.text(path).withColumnRenamed("value", "line"), default_m)
    if ending in ("csv", "txt"):
        head = spark.read.text(path).first()
        mark = max(",;\t|", key=(head[0] if head else "").count)
        return from_table(spark.read.csv(path, header=True, sep=mark), feet, default_m)
    if ending in ("json", "geojson"):
        rows = from_geojson(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"), default_m)
        return rows.groupBy("fid").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.first("height_m").alias("height_m"), F.first("assumed").alias("assumed")).select(F.concat(F.lit("feature "), "fid").alias("name"), "lon", "lat", "height_m", "assumed")
    raise ValueError(f"cannot read obstacles from a .{ending} file")


def read_all(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """The obstacles of several files with the file they come from."""
    return reduce(DataFrame.unionByName, (read(spark, p, **options).withColumn("source", F.lit(p)) for p in paths))
