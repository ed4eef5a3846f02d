"""Scores, ratings, ranks and site roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.sources.profiles import Aircraft, Doctrine, Mission

#: Best first; an unassessed site ranks above an unsuitable one.
RATINGS = ("Highly Suitable", "Suitable", "Marginal", "Unassessed", "Unsuitable")


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def rating_order(rating: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RATINGS)), rating) - 1


def components(sites: DataFrame, aircraft: Aircraft, mission: Mission, cell_m: float = 1.0, obstacle_evidence: bool = True) -> DataFrame:
    """sites with the five components (0 to 1), confidence and score (0 to 100, one decimal)."""
    upslope = 0.5 * _clamp(1.0 - F.col("slope") / aircraft.max_upslope_landing_deg)
    angle = F.when(F.col("best_angle").isNull(), F.lit(0.0)).when(F.col("best_angle") <= aircraft.suitable_angle_deg, F.lit(1.0)).otherwise(_clamp(1.0 - (F.col("best_angle") - aircraft.suitable_angle_deg) / (aircraft.unsuitable_angle_deg - aircraft.suitable_angle_deg)))
    breadth = _clamp((F.coalesce("clear", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(1)), F.lit(1))) / 0.25)
    approach = F.when(angle > 0, 0.8 * angle + 0.2 * breadth).otherwise(F.lit(0.0))
    approach = F.when(F.coalesce("opposing", F.lit(False)), F.least(F.lit(1.0), approach + 0.1)).otherwise(approach)
    worst = F.greatest(F.coalesce("tdp_obstacle", F.lit(0.0)) / max(aircraft.tdp_obstacle_height_m, 1e-6), F.coalesce("ring_obstacle", F.lit(0.0)) / max(aircraft.ring_obstacle_height_m, 1e-6))
    quality, confidence = (1.0, "HIGH") if cell_m <= 1.0 and obstacle_evidence else (0.65, "MEDIUM") if cell_m <= 2.5 and obstacle_evidence else (0.25, "SCREENING")
    out = (
        sites.withColumn("slope_part", F.when(F.col("upslope"), upslope).otherwise(_clamp(1.0 - F.col("slope") / aircraft.max_landing_slope_deg)))
        .withColumn("roughness_part", _clamp(1.0 - F.col("roughness") / aircraft.max_roughness_m))
        .withColumn("approach_part", approach)
        .withColumn("obstacle_part", _clamp(1.0 - worst) if obstacle_evidence else F.lit(0.0))
        .withColumn("quality_part", F.lit(quality))
        .withColumn("confidence", F.lit(confidence))
    )
    weighted = F.col("slope_part") * mission.slope_weight + F.col("roughness_part") * mission.roughness_weight + F.col("approach_part") * mission.approach_weight + F.col("obstacle_part") * mission.obstacle_weight + F.col("quality_part") * mission.data_quality_weight
    return out.withColumn("score", F.round(100.0 * weighted / mission.weight_total, 1))


def limiting_factor(obstacle_evidence: bool = True) -> Column:
    """Name of the smallest component, the first by name among equals; none where all are at least 0.9."""
    named = [("slope", "slope_part"), ("roughness", "roughness_part"), ("approach", "approach_part")] + ([("obstacle", "obstacle_part")] if obstacle_evidence else [])
    least = F.array_min(F.array(*(F.struct(F.col(c).alias("value"), F.lit(n).alias("name")) for n, c in named)))
    return F.when(least["value"] >= 0.9, F.lit("none")).otherwise(least["name"])


def rate(scored: DataFrame, aircraft: Aircraft, doctrine: Doctrine, obstacle_evidence: bool = True, density_altitude_ft: Column | None = None, mode: str = "OGE") -> DataFrame:
    """scored with gate (the hard rule that decides, else null), limiting, rating, status and notes."""
    ceiling = aircraft.hover_ceiling_oge_ft if mode.upper() == "OGE" else aircraft.hover_ceiling_ige_ft
    altitude = density_altitude_ft if density_altitude_ft is not None else F.lit(None).cast("double")
    has_sectors = F.coalesce(F.col("total") > 0, F.lit(False))
    too_high = F.coalesce(altitude > F.lit(ceiling).cast("double"), F.lit(False))
    gate = (
        F.when(too_high, F.lit("density altitude above the hover ceiling"))
        .when(has_sectors & (F.col("assessed") == 0), F.lit("approach not assessable"))
        .when(has_sectors & F.col("best_angle").isNull() & F.col("upslope"), F.lit("no approach in the uphill direction"))
        .when(has_sectors & F.col("best_angle").isNull(), F.lit("no usable approach"))
        .when(F.col("best_angle") > aircraft.unsuitable_angle_deg, F.lit("all approaches blocked"))
    )
    base = F.when(F.col("score") >= doctrine.highly_suitable_score, F.lit(0)).when(F.col("score") >= doctrine.suitable_score, F.lit(1)).when(F.col("score") >= doctrine.marginal_score, F.lit(2)).otherwise(F.lit(4))
    steep = F.coalesce(F.col("best_angle") > aircraft.suitable_angle_deg, F.lit(False))
    capped = F.greatest(base, F.when(steep, F.lit(2)).otherwise(F.lit(0)), F.when(F.col("upslope"), F.lit(1)).otherwise(F.lit(0)), F.lit(0 if obstacle_evidence else 2))
    place = F.when(F.col("gate").isNull(), capped).when(F.col("gate") == "approach not assessable", F.lit(3)).otherwise(F.lit(4))
    notes = F.array_compact(F.array(F.when(F.col("upslope"), F.lit("upslope landing only")), F.when(F.lit(not obstacle_evidence), F.lit("obstacles not assessed")), F.when(steep & F.col("gate").isNull(), F.lit("steep approach only")), F.when(F.lit(ceiling is None) & altitude.isNotNull(), F.lit("density altitude not gated"))))
    return (
        scored.withColumn("gate", gate)
        .withColumn("limiting", F.coalesce(F.col("gate"), limiting_factor(obstacle_evidence)))
        .withColumn("rating", F.element_at(F.array(*map(F.lit, RATINGS)), place + 1))
        .withColumn("status", F.lit("approved" if doctrine.approved else "planning"))
        .withColumn("notes", F.array_join(F.array_distinct(notes), "; "))
    )


def rank(rated: DataFrame, limit: int | None = None, distance: str | None = None) -> DataFrame:
    """The best limit sites with rank and site_id (S-01, wider where there are many).

    The window runs over candidate sites, which are capped before it; cells never reach it.
    """
    keys = [rating_order(F.col("rating")), F.desc("score"), F.desc("assessed"), F.desc("clear"), F.desc("quality"), F.coalesce(F.col(distance), F.lit(0.0)) if distance else F.lit(0.0), F.col("r"), F.col("c")]
    best = rated.orderBy(*keys).limit(limit) if limit else rated
    everything = Window.partitionBy()
    out = best.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).withColumn("_n", F.count(F.lit(1)).over(everything))
    width = F.greatest(F.lit(2), F.length(F.col("_n").cast("string")))
    return out.withColumn("site_id", F.concat(F.lit("S-"), F.lpad(F.col("rank").cast("string"), width, F.lit("0")))).drop("_n")


def rating_counts(spark: SparkSession, rated: DataFrame) -> DataFrame:
    """rating, sites: a row for every rating."""
    labels = spark.createDataFrame([(x,) for x in RATINGS], "rating string")
    return labels.join(rated.groupBy("rating").agg(F.count(F.lit(1)).alias("n")), "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("sites"))


def roles(ranked: DataFrame) -> DataFrame:
    """ranked(root, rank, site_id) with site_no by first appearance, role, primary_id and alternates."""
    site = Window.partitionBy("root")
    first = ranked.withColumn("first", F.min("rank").over(site)).withColumn("alternates", F.count(F.lit(1)).over(site) - 1).withColumn("primary_id", F.min_by("site_id", "rank").over(site))
    return first.withColumn("site_no", F.dense_rank().over(Window.orderBy("first"))).withColumn("role", F.when(F.col("rank") == F.col("first"), F.lit("PRIMARY")).otherwise(F.lit("ALTERNATE"))).drop("first")


def density_altitude_ft(elevation_m: Column, altimeter_inhg: Column, temperature_c: Column) -> Column:
    """Density altitude; null where the altimeter (25.0 to 32.5 inHg) or temperature (-70 to 60) is out of range."""
    pressure = elevation_m / 0.3048 + (29.92 - altimeter_inhg) * 1000.0
    isa = 15.0 - 1.98 * pressure / 1000.0
    return F.when(altimeter_inhg.between(25.0, 32.5) & temperature_c.between(-70.0, 60.0), pressure + 120.0 * (temperature_c - isa))
