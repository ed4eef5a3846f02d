"""Candidate sites: quality of passing cells, the exact re-check, and selections that keep sites apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsift.operators import masks, spatial, terrain
from gridsift.operators.storage import Store
from gridsift.sources.profiles import Aircraft, Mission


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


# What each part of the quality weighs, and what an upslope-only cell loses.
W_SLOPE, W_ROUGHNESS, W_OBSTACLE, W_EDGE, UPSLOPE_LOSS = 0.35, 0.25, 0.15, 0.25, 0.5


def quality(classes: DataFrame, aircraft: Aircraft, cell_m: float = 1.0, obstacle_evidence: bool = True) -> DataFrame:
    """Passing cells with edge (0 to 1: distance to the nearest cell that fails, in pad radii) and quality.

    Only distances within the pad radius matter, so they come from a bounded neighbourhood; cells with no failing
    cell in reach have the full edge quality. Upslope-only cells rank below all others.
    """
    passing = classes.filter(F.col("ground").isin(1, 2))
    reach = max(aircraft.tdp_radius_m, cell_m)
    near = masks.grow(classes.filter(~F.col("ground").isin(1, 2)), reach / cell_m)
    out = passing.join(near, ["r", "c"], "left").withColumn("edge", _clamp(F.coalesce(F.sqrt("d2") * cell_m / reach, F.lit(1.0)))).drop("d2")
    obstacle = _clamp(1.0 - F.coalesce("area_obstacle", F.lit(aircraft.ring_obstacle_height_m)) / max(aircraft.ring_obstacle_height_m, 1e-6)) if obstacle_evidence else F.lit(0.0)
    parts = W_SLOPE * _clamp(1.0 - F.col("slope") / aircraft.max_upslope_landing_deg) + W_ROUGHNESS * _clamp(1.0 - F.col("roughness") / aircraft.max_roughness_m) + W_OBSTACLE * obstacle + W_EDGE * F.col("edge")
    return out.withColumn("quality", F.when(F.col("ground") == 2, parts - UPSLOPE_LOSS).otherwise(parts))


def passes_exact(aircraft: Aircraft, mission: Mission, obstacle_evidence: bool = True) -> Column:
    """The exact tests on the columns of terrain.exact_metrics."""
    ok = F.col("slope").isNotNull() & F.col("residual").isNotNull() & (F.col("valid_fraction") >= mission.minimum_valid_fraction) & (F.col("slope") <= aircraft.max_upslope_landing_deg) & (F.col("residual") <= aircraft.max_roughness_m)
    if obstacle_evidence:
        ok = ok & (F.col("tdp_coverage") >= mission.minimum_valid_fraction) & (F.col("tdp_obstacle") <= aircraft.tdp_obstacle_height_m) & (F.col("ring_obstacle").isNull() | (F.col("ring_obstacle") <= aircraft.ring_obstacle_height_m))
        if aircraft.cleared_ring_m > 0:
            ok = ok & (F.col("ring_coverage") >= mission.minimum_ring_coverage_fraction)
    return F.coalesce(ok, F.lit(False))


def checked(cells: DataFrame, classes: DataFrame, aircraft: Aircraft, mission: Mission, cell_m: float = 1.0) -> DataFrame:
    """Passing cells with their screening quality, exact metrics and passes."""
    own = quality(classes, aircraft, cell_m).select("r", "c", F.round("quality", 6).alias("quality"))
    return terrain.exact_metrics(cells, own, aircraft, cell_m).withColumn("passes", passes_exact(aircraft, mission))


def _attributes(rows: DataFrame, cells: DataFrame, aircraft: Aircraft) -> DataFrame:
    """The rounded attributes that later steps work with."""
    at = cells.select("r", "c", "x", "y", "z")
    return rows.join(at, ["r", "c"]).select(
        "r", "c", "x", "y", F.round("z", 2).alias("elevation"), F.round("slope", 2).alias("slope"), F.round("aspect", 1).alias("aspect"), F.round("residual", 3).alias("roughness"),
        F.round("tdp_obstacle", 2).alias("tdp_obstacle"), F.round("ring_obstacle", 2).alias("ring_obstacle"), F.round("ring_coverage", 3).alias("ring_coverage"),
        (F.col("slope") > aircraft.max_landing_slope_deg).alias("upslope"), F.round("quality", 4).alias("quality"),
    )


def best_per_tile(found: DataFrame, cells: DataFrame, aircraft: Aircraft, tile_px: int, k: int = 1) -> DataFrame:
    """The best k checked cells of each tile."""
    rows = spatial.per_tile_top(found.filter("passes"), tile_px, k, [F.desc("quality"), "r", "c"])
    return _attributes(rows, cells, aircraft)


def select_apart(found: DataFrame, cells: DataFrame, aircraft: Aircraft, mission: Mission, cell_m: float = 1.0, store: Store | None = None, within: str | None = None) -> DataFrame:
    """Greedy selection over the whole grid: best quality first, a site blocks the separation, a failed check a quarter of the pad radius.

    The budget of checks and the cap on sites cut the order in which cells are examined, which later cells do not
    change. With a column within, each of its values is a grid of its own (with the cap for a tile), and it is kept.
    """
    apart = aircraft.tdp_diameter_m * mission.minimum_candidate_separation_factor / cell_m - 1e-6
    failed = max(1.0, 0.25 * aircraft.tdp_radius_m / cell_m)
    rows = found.withColumn("id", F.col("r") * F.lit(1 << 31) + F.col("c")).withColumn("better", -F.col("quality"))
    seen = spatial.examine_and_block(found.select("r", "c", "quality", "passes", *([within] if within else [])), apart, failed, store=store, within=within)
    most = mission.max_candidates if within is None else mission.max_candidates_per_tile
    examined, budget = rows.join(seen, seen.columns, "left_semi"), max(50, 25 * most)
    if within is None:
        best = examined.orderBy("better", "id").limit(budget).filter("passes").orderBy("better", "id").limit(most)
        return _attributes(best, cells, aircraft)
    place = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy("better", "id")))
    best = place(place(examined).filter(F.col("place") <= budget).filter("passes")).filter(F.col("place") <= most)
    return _attributes(best, cells, aircraft).join(best.select("r", "c", within), ["r", "c"])
