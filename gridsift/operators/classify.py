"""Ground classes, the first failing test of each cell, and what the failures add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.sources.profiles import Aircraft, Mission

FAIL, PASS, UPSLOPE, NODATA = 0, 1, 2, 255
#: Reason codes in the order of the tests.
REASONS = {
    0: "passes for any heading",
    1: "passes upslope only",
    2: "too little elevation data",
    3: "slope",
    4: "roughness",
    5: "surface model coverage",
    6: "obstacle in the pad",
    7: "obstacle in the ring",
    8: "excluded area",
    9: "listed obstacle",
    255: "no elevation",
}


def _holds(condition: Column) -> Column:
    """Unknown counts as not holding."""
    return F.coalesce(condition, F.lit(False))


def classify(terrain: DataFrame, aircraft: Aircraft, mission: Mission, obstacle_evidence: bool = True) -> DataFrame:
    """terrain with reason (see REASONS) and ground (0 fails, 1 any heading, 2 upslope only, 255 no data)."""
    tests = [
        (_holds(F.col("slope").isNotNull() & F.col("roughness").isNotNull() & (F.col("valid_fraction") >= mission.minimum_valid_fraction)), 2),
        (_holds(F.col("slope") <= aircraft.max_upslope_landing_deg), 3),
        (_holds(F.col("roughness") <= aircraft.max_roughness_m), 4),
    ]
    if obstacle_evidence:
        tests += [
            (_holds((F.col("tdp_coverage") >= mission.minimum_valid_fraction) & (F.col("area_coverage") >= mission.minimum_ring_coverage_fraction)), 5),
            (_holds(F.col("tdp_obstacle") <= aircraft.tdp_obstacle_height_m), 6),
            (_holds(F.col("area_obstacle") <= aircraft.ring_obstacle_height_m), 7),
        ]
    reason = F.when(F.col("zc").isNull(), F.lit(255))
    for holds, code in tests:
        reason = reason.when(~holds, F.lit(code))
    reason = reason.when(_holds(F.col("slope") <= aircraft.max_landing_slope_deg), F.lit(0)).otherwise(F.lit(1))
    ground = F.when(F.col("reason") == 255, F.lit(NODATA)).when(F.col("reason") == 0, F.lit(PASS)).when(F.col("reason") == 1, F.lit(UPSLOPE)).otherwise(F.lit(FAIL))
    return terrain.withColumn("reason", reason).withColumn("ground", ground)


def remove(classes: DataFrame, mask: DataFrame, code: int) -> DataFrame:
    """classes where cells of mask(r, c) that still pass fail with the given reason."""
    hit = mask.select("r", "c").distinct().withColumn("_hit", F.lit(True))
    out = classes.join(hit, ["r", "c"], "left")
    gone = F.col("_hit").isNotNull() & F.col("ground").isin(PASS, UPSLOPE)
    return out.withColumn("reason", F.when(gone, F.lit(code)).otherwise(F.col("reason"))).withColumn("ground", F.when(gone, F.lit(FAIL)).otherwise(F.col("ground"))).drop("_hit")


def reason_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REASONS.items()), "reason int, label string")


def reason_counts(classes: DataFrame) -> DataFrame:
    """reason, label, cells: a row for every reason, those that no cell has included."""
    counts = classes.groupBy("reason").agg(F.count(F.lit(1)).alias("cells"))
    return F.broadcast(reason_labels(classes.sparkSession)).join(counts, "reason", "left").select("reason", "label", F.coalesce("cells", F.lit(0)).alias("cells"))


def rejection_summary(classes: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """reason_counts with percent of known cells, hectares, and main: whether it is the most frequent failure.

    Of equally frequent failures the earlier test is the main one. The window runs over a row per reason.
    """
    counts = reason_counts(classes).filter("reason < 255")
    everything = Window.partitionBy()
    failures = F.when(F.col("reason").between(2, 9) & (F.col("cells") > 0), F.struct("cells", -F.col("reason")))
    total = F.sum("cells").over(everything)
    return counts.select(
        "reason", "label", "cells", F.when(total > 0, F.round(100.0 * F.col("cells") / total, 4)).otherwise(F.lit(0.0)).alias("percent"), F.round(F.col("cells") * (cell_m * cell_m) / 10000.0, 4).alias("hectares"),
        F.coalesce(failures == F.max(failures).over(everything), F.lit(False)).alias("main"),
    )
