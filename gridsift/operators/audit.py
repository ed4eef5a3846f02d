"""Audit of a folder of datasets: selection of inputs and rule findings over a table of dataset headers.

datasets: folder_key, kind (raster, vector), geometry, path, epsg, unit, cell_w, cell_h, bands, x_min, y_min, x_max,
y_max, nodata, low, high, mean, features. Levels: F fails, W warns, I informs, P passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (area, level, condition on a dataset, message).
RULES = (
    ("raster", "F", "kind = 'raster' and bands <> 1", "more than one band"),
    ("raster", "W", "kind = 'raster' and epsg is null", "unknown coordinate system"),
    ("raster", "W", "kind = 'raster' and epsg = 4326", "geographic coordinates"),
    ("raster", "F", "kind = 'raster' and folder_key = 'ground' and epsg = 3857", "web mercator ground"),
    ("raster", "W", "kind = 'raster' and folder_key = 'surface' and epsg = 3857", "web mercator surface"),
    ("raster", "F", "kind = 'raster' and folder_key = 'ground' and unit is not null and unit <> 'metre' and epsg <> 4326", "unit is not the metre"),
    ("raster", "F", "kind = 'raster' and abs(cell_w - cell_h) / cell_w > 0.01", "cells are not square"),
    ("raster", "W", "kind = 'raster' and epsg <> 4326 and cell_w > 2.5", "coarse cells"),
    ("raster", "I", "kind = 'raster' and epsg <> 4326 and cell_w > 1.0 and cell_w <= 2.5", "cells above 1 m"),
    ("raster", "W", "kind = 'raster' and nodata is null", "no value for missing data"),
    ("raster", "W", "kind = 'raster' and (low < -500 or high > 9000)", "heights out of the plausible range"),
    ("ground", "W", "folder_key = 'ground' and (lower(path) like '%dsm%' or lower(path) like '%surface%')", "named like a surface model"),
    ("surface", "W", "folder_key = 'surface' and (lower(path) like '%dtm%' or lower(path) like '%ground%')", "named like a ground model"),
    ("vectors", "W", "kind = 'vector' and features = 0", "no features"),
    ("vectors", "W", "kind = 'vector' and epsg is null", "unknown coordinate system"),
    ("vectors", "W", "kind = 'vector' and folder_key = 'aoi' and geometry <> 'polygon'", "not polygons"),
    ("vectors", "I", "kind = 'vector' and folder_key = 'exclusions' and geometry = 'point'", "points among exclusions"),
    ("misc", "W", "kind = 'vector' and folder_key in ('ground', 'surface')", "vector data in an elevation folder"),
    ("misc", "W", "kind = 'raster' and folder_key in ('aoi', 'exclusions', 'obstacles')", "raster in a vector folder"),
)
LEVELS = "FWIP"


def select_inputs(datasets: DataFrame) -> DataFrame:
    """folder_key, found, path: the dataset to use where a folder holds exactly one raster (or vector)."""
    per = datasets.groupBy("folder_key").agg(F.count(F.lit(1)).alias("found"), F.min("path").alias("path"))
    return per.select("folder_key", "found", F.when(F.col("found") == 1, F.col("path")).alias("path"))


def pair_findings(datasets: DataFrame) -> DataFrame:
    """Findings on the ground and surface rasters together."""
    side = lambda key, p: datasets.filter((F.col("folder_key") == key) & (F.col("kind") == "raster")).select(*(F.col(c).alias(f"{p}_{c}") for c in ("path", "epsg", "cell_w", "x_min", "y_min", "x_max", "y_max", "mean", "high")))
    pairs = F.broadcast(side("ground", "g")).crossJoin(side("surface", "s"))  # a few files each
    wide = F.least("g_x_max", "s_x_max") - F.greatest("g_x_min", "s_x_min")
    tall = F.least("g_y_max", "s_y_max") - F.greatest("g_y_min", "s_y_min")
    share = F.when((wide > 0) & (tall > 0), wide * tall).otherwise(F.lit(0.0)) / ((F.col("g_x_max") - F.col("g_x_min")) * (F.col("g_y_max") - F.col("g_y_min")))
    pairs = pairs.withColumn("share", share)
    rules = (("F", "g_path = s_path", "same file twice"), ("I", "not (g_epsg <=> s_epsg)", "coordinate systems differ"), ("I", "g_cell_w <> s_cell_w", "cell sizes differ"), ("F", "share = 0", "no overlap"), ("W", "share > 0 and share < 0.95", "partial overlap"), ("W", "s_mean < g_mean - 0.5", "surface below ground"), ("W", "abs(s_mean - g_mean) <= 0.01 and abs(s_high - g_high) <= 0.01", "surface equals ground"), ("P", "share >= 0.95 and s_mean >= g_mean - 0.5", "ground and surface fit"))
    return reduce(DataFrame.unionByName, (pairs.filter(c).select(F.lit("pair").alias("area"), F.lit(level).alias("level"), F.col("g_path").alias("path"), F.lit(text).alias("message")) for level, c, text in rules))


def findings(datasets: DataFrame) -> DataFrame:
    """area, level, path, message of all rules."""
    single = F.explode(F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(area).alias("area"), F.lit(level).alias("level"), F.lit(text).alias("message"))) for area, level, c, text in RULES))))
    own = datasets.select("path", single.alias("f")).select("f.area", "f.level", "path", "f.message")
    count = lambda key: datasets.filter((F.col("folder_key") == key) & (F.col("kind") == "raster")).agg(F.count(F.lit(1)).alias("n"))
    missing = [count(key).filter(c).select(F.lit(key).alias("area"), F.lit(level).alias("level"), F.lit(None).cast("string").alias("path"), F.lit(text).alias("message")) for key, c, level, text in (("ground", "n = 0", "F", "no ground model"), ("ground", "n > 1", "F", "several ground models"), ("surface", "n = 0", "W", "no surface model"), ("surface", "n > 1", "W", "several surface models"))]
    return reduce(DataFrame.unionByName, [own, pair_findings(datasets), *missing])


def status(found: DataFrame) -> DataFrame:
    """status: NOT_READY with any failure, READY_WITH_WARNINGS with any warning, else READY; and the counts by level."""
    per = found.agg(*(F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in LEVELS))
    return per.withColumn("status", F.when(F.col("n_f") > 0, F.lit("NOT_READY")).when(F.col("n_w") > 0, F.lit("READY_WITH_WARNINGS")).otherwise(F.lit("READY")))


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "folder_key string, kind string, geometry string, path string, epsg int, unit string, cell_w double, cell_h double, bands int, x_min double, y_min double, x_max double, y_max double, nodata double, low double, high double, mean double, features long")
