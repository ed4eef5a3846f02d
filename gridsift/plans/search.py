"""Geodesy, parsing, source, overview, planning and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.functions import geodesy as g
from gridsift.functions import text
from gridsift.operators import audit, overview, planning
from gridsift.plans import geodetic
from gridsift.plans.ground import cells, classes
from gridsift.plans.masks import height
from gridsift.plans.oracle import define, sql
from gridsift.plans.sites import rated
from gridsift.sources import obstacles, profiles
from gridsift.sources.bindings import bind

_ZONE = g.zone("lat", "lon")
_EAST, _NORTH = g.to_utm("lat", "lon", "zone")
_FOOT, _X = g.from_utm("zone", "lat >= 0", "east", "north")
_LAT2, _LON2 = g.from_utm_steps("zone", "foot", "x")
_MGRS = g.mgrs("zone", "band", "east", "north")
_LON_M, _LAT_M = g.metres_per_degree("lat")
_BEARING = "(((lon * 1.7) % 360 + 360) % 360)"


def utm(s, d):
    rows = bind(s, d, "positions").withColumn("zone", F.expr(_ZONE)).withColumn("band", F.expr(g.band("lat")))
    return rows.withColumn("east", F.expr(_EAST)).withColumn("north", F.expr(_NORTH))


def inverse(s, d):
    return utm(s, d).withColumn("foot", F.expr(_FOOT)).withColumn("x", F.expr(_X)).withColumn("lat2", F.expr(_LAT2)).withColumn("lon2", F.expr(_LON2))


def blocks(s, d):
    return overview.blocks(classes(s, d), overview.block_px(1.0, 20.0), 6.0)


def coverage(s, d):
    """Cells in each tile of 40 rows. The plan is as high as the grid, to whole tiles, so that r div 40 tells a cell's row of tiles."""
    rows = (cells(s, d).agg(F.max("r").alias("r")).first()["r"] or 0) // 40 * 40 + 40
    inside = F.expr("r div 40 = r0 div 40 and c >= c0 and c < c1")
    return cells(s, d).join(planning.tiles(s, rows, 100, 40), inside).groupBy("index").agg(F.count(F.lit(1)).alias("cells"))


QUERIES = {
    "utm_forward": lambda s, d: utm(s, d).select("id", "zone", "band", F.round("east", 3).alias("east"), F.round("north", 3).alias("north")),
    "utm_inverse": lambda s, d: inverse(s, d).select("id", F.round("lat2", 7).alias("lat2"), F.round("lon2", 7).alias("lon2")),
    "mgrs_encode": lambda s, d: utm(s, d).select("id", F.expr(_MGRS).alias("mgrs")),
    "mgrs_decode": lambda s, d: utm(s, d).select("id", text.mgrs_decode(F.expr(_MGRS)).alias("p")).select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon")),
    "utm_epsg": lambda s, d: bind(s, d, "positions").select("id", F.expr(g.epsg("lat", "lon", "id % 2 = 0")).alias("epsg")).select("id", "epsg", F.expr(g.utm_of_epsg("epsg")).alias("utm")),
    "metres_per_degree": lambda s, d: bind(s, d, "positions").select("id", F.round(F.expr(_LON_M), 3).alias("lon_m"), F.round(F.expr(_LAT_M), 3).alias("lat_m"), F.round(F.expr(f"sqrt(0.0001 * {_LON_M} * 0.0001 * {_LAT_M})"), 3).alias("cell_m")),
    "compass_points": lambda s, d: bind(s, d, "positions").select("id", F.expr(g.compass(_BEARING)).alias("compass16"), F.expr(g.compass(_BEARING, 8)).alias("compass8")),
    "length_text": lambda s, d: bind(s, d, "obstacles").select("owner", text.length_text(F.round("agl_m", 1), "METRIC").alias("metric")),
    "feet_columns": lambda s, d: bind(s, d, "obstacles").select("owner", F.round(F.col("agl_m") / 0.3048, 2).alias("agl_ft"), F.round(F.col("x") / 1852.0, 6).alias("x_nm")),
    "overview_blocks": lambda s, d: blocks(s, d).select("br", "bc", "valid", *(F.round(x, 4).alias(x) for x in ("pct_cover", "slope_mean", "slope_max", "rough_mean", "elev_min", "elev_range", "pct_pass"))),
    "overview_classes": lambda s, d: blocks(s, d).groupBy("terrain", "passing").agg(F.count(F.lit(1)).alias("blocks")),
    "overview_candidates": lambda s, d: overview.attach(blocks(s, d).select("br", "bc"), rated(s, d), 20).select("br", "bc", "sites", "best_rating"),
    "tile_coverage": lambda s, d: coverage(s, d),
    "runtime_estimate": lambda s, d: planning.runtime(cells(s, d).agg(F.count(F.lit(1)).alias("cells"))),
    "dsm_dtm_p05": lambda s, d: planning.surface_check(cells(s, d)).select("sampled", F.round("p05", 4).alias("p05"), F.round("below", 4).alias("below"), "suspicious"),
    "bilinear_resample": lambda s, d: planning.bilinear(bind(s, d, "points").select("id", (F.col("x") / 10.5).alias("x"), (F.col("y") / 70).alias("y")), cells(s, d), height(s, d)).select("id", F.round("z", 4).alias("z")),
}


define("blocks", ("classes",), """select *, 100.0 * valid / cells as pct_cover, case when valid > 0 then 100.0 * (n_any + n_up) / valid end as pct_pass, elev_max - elev_min as elev_range,
  case when valid > 0 then case when slope_mean is null then 'Unknown' when slope_mean <= 3 then 'Flat' when slope_mean <= 6 then 'Moderate' else 'Steep' end end as terrain,
  case when valid > 0 then case when 100.0 * (n_any + n_up) / valid >= 25 then 'High' when 100.0 * (n_any + n_up) / valid >= 5 then 'Medium' when n_any + n_up > 0 then 'Low' else 'None' end end as passing
  from (select r // 20 as br, c // 20 as bc, count(*) as cells, count(case when ground <> 255 then 1 end) as valid, avg(case when ground <> 255 then slope end) as slope_mean, max(case when ground <> 255 then slope end) as slope_max, avg(case when ground <> 255 then roughness end) as rough_mean,
    min(zc) + 100 as elev_min, max(zc) + 100 as elev_max, count(case when ground = 1 then 1 end) as n_any, count(case when ground = 2 then 1 end) as n_up from classes group by 1, 2) a""")
_TILES = "select i * {nc} + j + 1 as index, cast(round_even({rows} * i / cast({nr} as double), 0) as bigint) as r0, cast(round_even({rows} * (i + 1) / cast({nr} as double), 0) as bigint) as r1, cast(round_even({cols} * j / cast({nc} as double), 0) as bigint) as c0, cast(round_even({cols} * (j + 1) / cast({nc} as double), 0) as bigint) as c1 from range({nr}) a(i) cross join range({nc}) b(j)"
_T2 = _TILES.format(rows=15000, cols=100, nr=375, nc=3)
ORACLES = {
    "length_text": sql("select owner, printf('%.1f m', round(agl_m, 1)) as metric from obstacles", "obstacles"),
    "feet_columns": sql("select owner, round(agl_m / 0.3048, 2) as agl_ft, round(x / 1852.0, 6) as x_nm from obstacles", "obstacles"),
    "overview_blocks": sql("select br, bc, valid, round(pct_cover, 4) as pct_cover, round(slope_mean, 4) as slope_mean, round(slope_max, 4) as slope_max, round(rough_mean, 4) as rough_mean, round(elev_min, 4) as elev_min, round(elev_range, 4) as elev_range, round(pct_pass, 4) as pct_pass from blocks", "blocks"),
    "overview_classes": sql("select terrain, passing, count(*) as blocks from blocks group by terrain, passing", "blocks"),
    "overview_candidates": sql("select br, bc, coalesce(n, 0) as sites, case best when 0 then 'Highly Suitable' when 1 then 'Suitable' when 2 then 'Marginal' when 3 then 'Unassessed' when 4 then 'Unsuitable' end as best_rating from blocks left join (select r // 20 as br, c // 20 as bc, count(*) as n, min(place) as best from rated group by 1, 2) k using (br, bc)", "blocks", "rated"),
    "tile_coverage": sql(f"select index, count(*) as cells from cells join ({_T2}) t on r >= r0 and r < r1 and c >= c0 and c < c1 group by index", "cells"),
    "runtime_estimate": sql("select count(*) as cells, round(count(*) / 1e6 * 2, 3) as low_s, round(count(*) / 1e6 * 5, 3) as high_s from cells", "cells"),
    "dsm_dtm_p05": sql("select count(*) as sampled, round(quantile_cont(d, 0.05), 4) as p05, round(avg(case when d < -0.5 then 1.0 else 0 end), 4) as below, count(*) >= 100 and abs(quantile_cont(d, 0.05)) > 0.5 as suspicious from (select dsm - z as d from cells where r % 5 = 0 and c % 5 = 0 and dsm - z is not null) t", "cells"),
    "bilinear_resample": sql("select id, round(case when count(z) = 4 then sum(w * z) end, 4) as z from (select id, k.z, (case when i = 1 then v - floor(v) else 1 - (v - floor(v)) end) * (case when j = 1 then u - floor(u) else 1 - (u - floor(u)) end) as w from (select id, x/10.5 - 0.5 as u, (select max(r) + 1 from cells) - y/70 - 0.5 as v from points) p cross join range(2) a(i) cross join range(2) b(j) left join (select r, c, z from cells) k on k.r = floor(v) + i and k.c = floor(u) + j) q group by id", "points", "cells"),
}

ORACLES |= geodetic.ORACLES
