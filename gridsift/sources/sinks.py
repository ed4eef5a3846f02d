"""What a run writes: cell classes by tile, candidate tables, GeoJSON features, rejection tables and metadata."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions.text import FEET


def write_cells(cells: DataFrame, path: str, tile_px: int = 4096) -> None:
    """Cells as parquet, partitioned by tile, so that readers of a window open only its tiles."""
    tiled = cells.withColumn("tile_r", F.floor(F.col("r") / tile_px)).withColumn("tile_c", F.floor(F.col("c") / tile_px))
    tiled.repartition("tile_r", "tile_c").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def _decimal(name: str, digits: int) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", F.col(name).cast("double")), F.lit(""))


def candidate_view(ranked: DataFrame) -> DataFrame:
    """The ranked sites as text, with yes and no and fixed decimals, empty where unknown."""
    yes = lambda c: F.when(F.col(c), F.lit("Yes")).otherwise(F.lit("No")).alias(c)
    bearing = lambda c: F.coalesce(F.lpad(F.pmod(F.round(c), F.lit(360.0)).cast("int").cast("string"), 3, "0"), F.lit("")).alias(c)
    return ranked.select(
        F.col("rank").cast("string").alias("rank"), "site_id", "rating", _decimal("score", 1).alias("score"), "status", "confidence", _decimal("x", 1).alias("x"), _decimal("y", 1).alias("y"), _decimal("elevation", 2).alias("elevation_m"),
        _decimal("slope", 2).alias("slope_deg"), yes("upslope"), _decimal("roughness", 3).alias("roughness_m"), _decimal("ring_obstacle", 2).alias("ring_obstacle_m"), bearing("best_azimuth"), bearing("heading"), F.col("clear").cast("string").alias("clear_sectors"),
        F.col("assessed").cast("string").alias("assessed_sectors"), yes("opposing"), "limiting", "notes", F.coalesce(F.format_string("%.2f", F.round(F.col("elevation") / FEET, 2)), F.lit("")).alias("elevation_ft"),
    )


def write_candidates(ranked: DataFrame, path: str) -> None:
    """One CSV file with a header, best site first. The table is capped by the number of candidates."""
    candidate_view(ranked).orderBy(F.col("rank").cast("int")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def circle(x: Column, y: Column, radius: float, points: int = 72) -> Column:
    """A closed ring of [x, y] around a point, clockwise from north."""
    turn = lambda i: F.radians(i * (360.0 / points))
    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.array(F.round(x + radius * F.sin(turn(i % points)), 3) + 0.0, F.round(y + radius * F.cos(turn(i % points)), 3) + 0.0))


def wedge(x: Column, y: Column, azimuth: Column, half_width: float, radius: float, points: int = 16) -> Column:
    """A closed sector ring: the site, the arc around the azimuth, the site."""
    turn = lambda i: F.radians(azimuth - half_width + i * (2 * half_width / points))
    centre = F.array(F.array(F.round(x, 3), F.round(y, 3)))
    return F.concat(centre, F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.array(F.round(x + radius * F.sin(turn(i)), 3), F.round(y + radius * F.cos(turn(i)), 3))), centre)


def features(ranked: DataFrame, radius: float) -> DataFrame:
    """json: a GeoJSON feature with the pad's outline for every site. A score of negative zero is written as zero."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(circle(F.col("x"), F.col("y"), radius)).alias("coordinates"))
    return ranked.select("rank", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("rank", "site_id", "rating", (F.col("score") + 0.0).alias("score")).alias("properties"), geometry.alias("geometry"))).alias("json"))


def write_features(ranked: DataFrame, path: str, radius: float) -> None:
    """Newline-delimited GeoJSON features."""
    features(ranked, radius).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_rejections(summary: DataFrame, path: str) -> None:
    summary.orderBy("reason").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def metadata(values: dict) -> str:
    """JSON text of a run's metadata. Written and read back: what is not a number, which JSON has no word for, comes back as null."""
    return json.dumps(json.loads(json.dumps(values), parse_constant=lambda _: None), indent=1, sort_keys=True)


def console_lines(ranked: DataFrame, n: int = 15) -> DataFrame:
    """line: the best n sites as text."""
    best = ranked.orderBy("rank").limit(n)
    return best.select("rank", F.format_string("%s  %s  %.1f  %s", "site_id", "rating", "score", "limiting").alias("line"))
