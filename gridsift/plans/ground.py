"""Terrain and ground-class queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.operators import classify, terrain
from gridsift.plans.oracle import sql
from gridsift.sources.bindings import bind
from gridsift.sources.profiles import Aircraft, Mission

AIRCRAFT, MISSION = Aircraft(), Mission()


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, "cells")


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.analyze(cells(spark, sf_dir), AIRCRAFT)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(analyzed(spark, sf_dir), AIRCRAFT, MISSION)


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.solve_plane(terrain.plane_moments(cells(spark, sf_dir), 3.0))


def _rounded(*names: str, digits: int = 4) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def flagship_ground_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells, and what share of the known ground, fall into each class."""
    counts = classes(spark, sf_dir).groupBy("ground").agg(F.count(F.lit(1)).alias("cells"))
    known = counts.agg(F.sum(F.when(F.col("ground") != 255, F.col("cells"))).alias("known"))
    return counts.crossJoin(F.broadcast(known)).select("ground", "cells", F.round(100.0 * F.col("cells") / F.col("known"), 4).alias("percent_of_known"))


def exact_of_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    passing = classes(spark, sf_dir).filter(F.col("ground").isin(1, 2)).select("r", "c")
    return terrain.exact_metrics(cells(spark, sf_dir), passing, AIRCRAFT)


QUERIES = {
    "flagship_ground_class": flagship_ground_class,
    "cell_geometry": lambda s, d: cells(s, d).select("r", "c", (F.col("c") + 0.5).cast("double").alias("x_centre"), F.floor(F.col("x")).alias("col_of_x"), F.col("y").alias("y_centre")),
    "plausible_elevation": lambda s, d: terrain.plausible(cells(s, d).withColumn("z", F.when(F.col("k") % 97 == 0, F.lit(-9999.0)).otherwise(F.col("z"))), -1000.0, 9000.0).agg(F.count(F.lit(1)).alias("cells"), F.count("z").alias("kept"), F.round(F.min("z"), 4).alias("lowest")),
    "ndsm": lambda s, d: terrain.above_ground(cells(s, d)).select("r", "c", F.round("h", 4).alias("h")),
    "plane_fit": lambda s, d: _planes(s, d).select("r", "c", *_rounded("slope", "aspect")),
    "rms_roughness": lambda s, d: _planes(s, d).select("r", "c", *_rounded("rms")),
    "valid_fraction": lambda s, d: analyzed(s, d).select("r", "c", *_rounded("valid_fraction")),
    "screening_roughness": lambda s, d: analyzed(s, d).select("r", "c", *_rounded("roughness")),
    "rect_union_max": lambda s, d: analyzed(s, d).select("r", "c", *_rounded("tdp_obstacle", "area_obstacle")),
    "ring_coverage": lambda s, d: analyzed(s, d).select("r", "c", *_rounded("tdp_coverage", "area_coverage")),
    "disk_join_moments": lambda s, d: terrain.disk_join(cells(s, d), 3.0, ["z"]).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 4).alias("mean_z")),
    "ground_class": lambda s, d: classes(s, d).select("r", "c", F.col("ground").cast("int").alias("ground")),
    "reason_codes": lambda s, d: classes(s, d).select("r", "c", F.col("reason").cast("int").alias("reason")),
    "reason_counts": lambda s, d: classify.reason_counts(classes(s, d)),
    "rejection_summary": lambda s, d: classify.rejection_summary(classes(s, d)),
    "main_reason": lambda s, d: classify.rejection_summary(classes(s, d)).filter("main").select("reason", "cells", "percent"),
    "no_surface_model_class": lambda s, d: classify.classify(analyzed(s, d), AIRCRAFT, MISSION, obstacle_evidence=False).groupBy("ground").agg(F.count(F.lit(1)).alias("cells")),
    "exact_metrics": lambda s, d: exact_of_passing(s, d).select("r", "c", *_rounded("slope", "residual", "valid_fraction", "tdp_obstacle", "ring_obstacle", "ring_coverage")),
    "core_window": lambda s, d: (lambda w: cells(s, d).crossJoin(F.broadcast(w)).filter(F.col("r").between(F.col("r_min") - terrain.halo_px(AIRCRAFT), F.col("r_max") + terrain.halo_px(AIRCRAFT)) & F.col("c").between(F.col("c_min") - terrain.halo_px(AIRCRAFT), F.col("c_max") + terrain.halo_px(AIRCRAFT))))(cells(s, d).filter("dsm - z > 10").agg(F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))).groupBy("r").agg(F.min("c").alias("c_first"), F.max("c").alias("c_last"), F.count(F.lit(1)).alias("cells")),
}


def noise() -> list:
    """Deterministic integer noise of a procedural scene: bits of row and column mixed."""
    mixed = (F.col("id") * 73856093).bitwiseXOR(F.shiftright(F.col("id") * 19349663, 3)) % 1000003
    return [mixed.alias("mixed"), F.round(mixed / 1000003.0, 4).alias("noise")]


_LABELS = ", ".join(f"({k}, '{v}')" for k, v in classify.REASONS.items())
_COUNTS = f"select l.reason, label, coalesce(cells, 0) as cells from (values {_LABELS}) l(reason, label) left join (select reason, count(*) as cells from classes group by reason) c using (reason)"
_SUMMARY = f"""select *, coalesce(fails and cells = max(case when fails then cells end) over () and reason = min(case when fails and cells = most then reason end) over (), false) as main from (
  select *, max(case when fails then cells end) over () as most from (
    select reason, label, cells, case when sum(cells) over () > 0 then round(100.0 * cells / sum(cells) over (), 4) else 0 end as percent, round(cells / 10000.0, 4) as hectares, reason between 2 and 9 and cells > 0 as fails
    from ({_COUNTS}) a where reason < 255) b) c"""

ORACLES = {
    "flagship_ground_class": sql("select ground, count(*) as cells, round(100.0 * count(*) / (select count(*) from classes where ground <> 255), 4) as percent_of_known from classes group by ground", "classes"),
    "cell_geometry": sql("select r, c, cast(c + 0.5 as double) as x_centre, cast(floor(x) as bigint) as col_of_x, y as y_centre from cells", "cells"),
    "plausible_elevation": sql("select count(*) as cells, count(zz) as kept, round(min(zz), 4) as lowest from (select case when k % 97 = 0 then null else z end as zz from cells) t", "cells"),
    "ndsm": sql("select r, c, round(hgt, 4) as h from ground_cells", "ground_cells"),
    "plane_fit": sql("select r, c, round(slope, 4) as slope, round(aspect, 4) as aspect from planes", "planes"),
    "rms_roughness": sql("select r, c, round(rms, 4) as rms from planes", "planes"),
    "valid_fraction": sql("select r, c, round(valid_fraction, 4) as valid_fraction from terrain", "terrain"),
    "screening_roughness": sql("select r, c, round(roughness, 4) as roughness from terrain", "terrain"),
    "rect_union_max": sql("select r, c, round(tdp_obstacle, 4) as tdp_obstacle, round(area_obstacle, 4) as area_obstacle from terrain", "terrain"),
    "ring_coverage": sql("select r, c, round(tdp_coverage, 4) as tdp_coverage, round(area_coverage, 4) as area_coverage from terrain", "terrain"),
    "disk_join_moments": sql("select cast(q.r - dr as bigint) as r, cast(q.c - dc as bigint) as c, count(*) as n, round(avg(z), 4) as mean_z from cells q cross join disk3 where z is not null group by 1, 2", "cells", "disk3"),
    "ground_class": sql("select r, c, cast(ground as int) as ground from classes", "classes"),
    "reason_codes": sql("select r, c, cast(reason as int) as reason from classes", "classes"),
    "reason_counts": sql(_COUNTS, "classes"),
    "rejection_summary": sql(f"select reason, label, cells, percent, hectares, main from ({_SUMMARY}) s", "classes"),
    "main_reason": sql(f"select reason, cells, percent from ({_SUMMARY}) s where main", "classes"),
    "no_surface_model_class": sql("""select case when zc is null then 255 when not coalesce(slope is not null and roughness is not null and valid_fraction >= 0.95, false) or not coalesce(slope <= 10, false) or not coalesce(roughness <= 0.3, false) then 0 when slope <= 6 then 1 else 2 end as ground, count(*) as cells from terrain group by 1""", "terrain"),
    "exact_metrics": sql("select r, c, round(slope, 4) as slope, round(residual, 4) as residual, round(valid_fraction, 4) as valid_fraction, round(tdp_obstacle, 4) as tdp_obstacle, round(ring_obstacle, 4) as ring_obstacle, round(ring_coverage, 4) as ring_coverage from exact", "exact"),
    "core_window": sql("select r, min(c) as c_first, max(c) as c_last, count(*) as cells from cells cross join (select min(r) as r_min, max(r) as r_max, min(c) as c_min, max(c) as c_max from cells where dsm - z > 10) w where r between r_min - 14 and r_max + 14 and c between c_min - 14 and c_max + 14 group by r", "cells"),
}
