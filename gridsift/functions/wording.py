"""Sentences about results: one line for a site, lines for why cells fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions import geodesy
from gridsift.operators.approach import bearing_text
from gridsift.sources.profiles import Aircraft

LEVEL_DEG, GENTLE_DEG, SMOOTH_M = 1.0, 3.0, 0.05


def site_summary(aircraft: Aircraft) -> Column:
    """What a ranked site is like, in one line: ground, surface, approaches, rating."""
    degrees = F.format_string("%.1f deg", F.round("slope", 1))
    ground = F.when(F.col("upslope"), F.concat(F.lit("Steep ground ("), degrees, F.lit("), for landing uphill only"))).otherwise(
        F.concat(F.when(F.col("slope") < LEVEL_DEG, F.lit("Level")).when(F.col("slope") < GENTLE_DEG, F.lit("Gently sloping")).otherwise(F.lit("Sloping")), F.lit(" ground ("), degrees, F.lit(")"))
    )
    surface = F.when(F.col("roughness") < SMOOTH_M, F.lit("smooth")).when(F.col("roughness") < aircraft.max_roughness_m / 2, F.lit("fairly smooth")).otherwise(F.format_string("uneven by %.2f m", F.round("roughness", 2)))
    best = F.when(F.col("best_azimuth").isNull(), F.lit("none usable")).otherwise(F.concat(F.lit("best from "), F.expr(geodesy.compass("best_azimuth", 8)), F.lit(" "), bearing_text(F.col("best_azimuth"))))
    return F.concat(ground, F.lit(", "), surface, F.lit("; "), F.col("clear").cast("string"), F.lit(" of "), F.col("assessed").cast("string"), F.lit(" approaches open, "), best, F.lit(". "), F.col("rating"), F.format_string(", score %.1f", "score"))


def rejection_lines(summary: DataFrame) -> DataFrame:
    """reason, line: share, number and meaning of each reason that a cell has."""
    return summary.filter("cells > 0").select("reason", F.concat(F.format_string("%6.2f", "percent"), F.lit("%  "), F.format_number("cells", 0), F.lit("  "), F.col("label")).alias("line"))
