"""Coarse overview grids of a classified area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.operators.scoring import RATINGS, rating_order

# Limits of the overview cell and of its classes, and the classes' names below.
MIN_CELL_M, MAX_CELL_M, MIN_BLOCK = 20.0, 20000.0, 16
HIGH_PERCENT, MEDIUM_PERCENT, FLAT_SHARE = 25.0, 5.0, 0.5


def block_px(cell_m: float, overview_m: float) -> int:
    """Edge of a block in cells, at least MIN_BLOCK."""
    if not MIN_CELL_M <= overview_m <= MAX_CELL_M:
        raise ValueError(f"the overview cell must be within {MIN_CELL_M} and {MAX_CELL_M} m")
    return max(MIN_BLOCK, round(overview_m / cell_m))


def terrain_class(slope: Column, limit: float) -> Column:
    return F.when(slope.isNull(), F.lit("Unknown")).when(slope <= FLAT_SHARE * limit, F.lit("Flat")).when(slope <= limit, F.lit("Moderate")).otherwise(F.lit("Steep"))


def pass_class(percent: Column) -> Column:
    return F.when(percent >= HIGH_PERCENT, F.lit("High")).when(percent >= MEDIUM_PERCENT, F.lit("Medium")).when(percent > 0, F.lit("Low")).otherwise(F.lit("None"))


def blocks(classes: DataFrame, block: int, landing_limit: float, base_m: float = 100.0) -> DataFrame:
    """One row per block of block x block cells(r, c, zc, slope, roughness, ground): counts, means, ranges, shares, classes.

    Spark merges partial sums by itself; blocks without a known cell have no values.
    """
    known = F.col("ground") != 255
    per = classes.groupBy(F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(known).alias("valid"), F.avg(F.when(known, F.col("slope"))).alias("slope_mean"), F.max(F.when(known, F.col("slope"))).alias("slope_max"),
        F.avg(F.when(known, F.col("roughness"))).alias("rough_mean"), (F.min("zc") + base_m).alias("elev_min"), (F.max("zc") + base_m).alias("elev_max"), F.count_if(F.col("ground") == 1).alias("n_any"), F.count_if(F.col("ground") == 2).alias("n_up"),
    )
    share = lambda n, d: F.when(F.col(d) > 0, 100.0 * F.col(n) / F.col(d))
    out = per.withColumn("pct_cover", share("valid", "cells")).withColumn("pct_any", share("n_any", "valid")).withColumn("pct_upslope", share("n_up", "valid")).withColumn("pct_pass", F.col("pct_any") + F.col("pct_upslope"))
    return out.withColumn("elev_range", F.col("elev_max") - F.col("elev_min")).withColumn("terrain", F.when(F.col("valid") > 0, terrain_class(F.col("slope_mean"), landing_limit))).withColumn("passing", F.when(F.col("valid") > 0, pass_class(F.col("pct_pass"))))


def attach(found: DataFrame, sites: DataFrame, block: int) -> DataFrame:
    """blocks with the number of ranked sites inside and their best rating."""
    per = sites.groupBy(F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).agg(F.count(F.lit(1)).alias("sites"), F.min(rating_order(F.col("rating"))).alias("best"))
    names = F.array(*map(F.lit, RATINGS))
    return found.join(per, ["br", "bc"], "left").select(*found.columns, F.coalesce("sites", F.lit(0)).alias("sites"), F.when(F.col("sites") > 0, F.element_at(names, (F.coalesce("best", F.lit(0)) + 1).cast("int"))).alias("best_rating"))


def lattice(spark: SparkSession, rows: int, cols: int, block: int) -> DataFrame:
    """id, br, bc and the clipped rectangle of every block of a rows x cols grid, empty ones included, row by row."""
    n_r, n_c = -(-rows // block), -(-cols // block)
    out = spark.range(n_r * n_c).withColumn("br", F.floor(F.col("id") / n_c)).withColumn("bc", F.col("id") % n_c)
    edge = lambda i, most: F.least(F.lit(most).cast("long"), (F.col(i) + 1) * block)
    return out.select((F.col("id") + 1).alias("block_id"), "br", "bc", (F.col("br") * block).alias("r0"), edge("br", rows).alias("r1"), (F.col("bc") * block).alias("c0"), edge("bc", cols).alias("c1"))
