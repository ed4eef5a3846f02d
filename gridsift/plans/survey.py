"""Queries of inputs and runs: digests, resampled grids, distances of any length, sketches, footprints of all kinds, windows of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.operators import approach, digests, distance, masks, planning, resample, sketches
from gridsift.plans import geodetic  # noqa: F401  (defines what resampled grids are checked with)
from gridsift.plans.ground import AIRCRAFT, MISSION, cells
from gridsift.plans.masks import height, polygon
from gridsift.plans.oracle import copy_of, define, sql
from gridsift.plans.sites import chosen, swept
from gridsift.sources import tables
from gridsift.sources.bindings import bind

NORTH, WEST, LAT_STEP, LON_STEP = 45.5, -75.7, 1.2e-5, 1.5e-5
BUFFER_M, TILE_PX, WINDOW_PX, PER_TILE = 2.5, 30, 40, 20


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


DIGESTED = {"supplier": ("s_suppkey", "s_name", "s_nationkey"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus"), "nation": ("n_nationkey", "n_name", "n_regionkey")}


def content_digests(s, d):
    """The digest of each table, twice: in its own order, and of its rows dealt out anew."""
    out = None
    for name, columns in DIGESTED.items():
        own = _table(s, d, name)
        for order, df in ((0, own), (1, own.repartition(5, columns[1]))):
            row = digests.content(df, list(columns)).select(F.lit(name).alias("name"), F.lit(order).cast("long").alias("dealt"), "n", *(F.col(f"lane{i}").cast("string").alias(f"lane{i}") for i in range(4)))
            out = row if out is None else out.unionByName(row)
    return out


def resampled(s, d):
    grid = resample.DegreeGrid(height(s, d), 100, NORTH, WEST, LAT_STEP, LON_STEP)
    return resample.to_utm_grid(cells(s, d), grid, resample.target_of(s, grid))


def tile_checks(s, d):
    return planning.tile_surface(cells(s, d), height(s, d), 100, TILE_PX, 2, 50)


def distinct_counts(s, d):
    """Distinct orders by ship mode, and of all, from sketches by ship mode and return flag; exact counts beside them."""
    lines = _table(s, d, "lineitem")
    stored = sketches.distinct_sketches(lines, ["l_returnflag", "l_linestatus"], "l_orderkey")
    out = None
    for by in (["l_returnflag"], []):
        exact = lines.groupBy(*by).agg(F.countDistinct("l_orderkey").alias("exact"))
        both = exact.join(sketches.distinct_of(stored, by), by) if by else exact.crossJoin(sketches.distinct_of(stored, by))  # one row with one row
        row = both.select((F.col(by[0]) if by else F.lit("all")).alias("part"), "exact", (F.abs(F.col("estimate") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")).alias("within"))
        out = row if out is None else out.unionByName(row)
    return out


def price_quantiles(s, d):
    """By quantile of line prices: the exact one, and whether the rank of the one from merged sketches is as near as stated."""
    lines = _table(s, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    stored = sketches.quantile_sketches(lines, ["l_returnflag"], "v")
    out = None
    for q in (0.05, 0.5, 0.95):
        got = sketches.quantile_of(stored, q).first()
        rank = lines.agg(F.avg((F.col("v") <= got["estimate"]).cast("double")).alias("rank"))
        row = rank.select(F.lit(q).alias("q"), F.lit(got["n"]).alias("n"), F.round(F.lit(sketches.exact_quantile(lines, "v", q)), 4).alias("exact"), (F.abs(F.col("rank") - q) <= sketches.RANK_ERROR).alias("within"))
        out = row if out is None else out.unionByName(row)
    return out


def sectors_through_json(s, d):
    text = approach.nested(swept(s, d)).select("r0", "c0", approach.sectors_to_json(F.col("sectors")).alias("json"))
    back = text.select("r0", "c0", F.explode(approach.sectors_from_json(F.col("json"))).alias("x"))
    return back.select(F.col("r0").alias("r"), F.col("c0").alias("c"), "x.azimuth", F.round("x.worst", 3).alias("worst"), F.round("x.coverage", 3).alias("coverage"), "x.class")


def planned_extents(s, d):
    """Tiles of the extent of every polygon, planned by the table function."""
    planning.register(s)
    box = bind(s, d, "polygons").groupBy("fid").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return s.sql("select fid, t.* from {box}, lateral plan_tiles(cast(ceil(h * (1 + fid % 4)) as bigint), cast(ceil(w * (2 + fid % 3)) as bigint), 5) t", box=box)


def cell_windows(s, d):
    """Cells of a window, read from the table's file a tile at a time; r and c filters reach the reader."""
    tables.register(s)
    rows = s.read.format(tables.CELLS).schema("r long, c long, o_totalprice double").options(path=f"{d}/orders.parquet", key="o_orderkey", cols="100", tile=str(WINDOW_PX)).load()
    return rows.filter("r >= 7 and r < 95 and c between 13 and 58").select("r", "c", F.round("o_totalprice", 2).alias("price"))


def _h(s, d):
    return F.lit(height(s, d)).cast("double")


def feature_heights(s, d):
    return masks.footprint_heights(bind(s, d, "features"), cells(s, d), _h(s, d), BUFFER_M)


def feature_sectors(s, d):
    return approach.listed_angles(chosen(s, d), masks.footprint_samples(bind(s, d, "features"), cells(s, d), _h(s, d)), AIRCRAFT, MISSION)


QUERIES = {
    "content_digests": content_digests,
    "utm_resample": lambda s, d: resampled(s, d).select("r", "c", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("z", 4).alias("z")),
    "distance_unbounded": lambda s, d: distance.to_mask(cells(s, d), polygon(s, d)).select("r", "c", F.round("distance", 4).alias("distance")),
    "tile_surface_check": lambda s, d: tile_checks(s, d).select("index", "sampled", F.round("p05", 4).alias("p05"), F.round("below", 4).alias("below"), "flagged"),
    "run_surface_check": lambda s, d: planning.surface_of_run(tile_checks(s, d)).select("tiles", "flagged", F.round("median_p05", 4).alias("median_p05")),
    "distinct_sketches": distinct_counts,
    "quantile_sketches": price_quantiles,
    "sectors_json": sectors_through_json,
    "plan_tiles_of_extents": planned_extents,
    "cell_windows": cell_windows,
    "footprint_heights": lambda s, d: feature_heights(s, d).select("r", "c", F.round("agl_m", 6).alias("agl_m"), "owner"),
    "footprint_burn": lambda s, d: masks.burn_heights(cells(s, d), feature_heights(s, d)).select("r", "c", F.round("dsm", 4).alias("dsm")),
    "footprint_sectors": lambda s, d: feature_sectors(s, d).select(F.col("r0").alias("r"), F.col("c0").alias("c"), "azimuth", F.round("listed", 3).alias("listed"), "owner"),
}

_LANE = "cast(sum(cast('0x' || substr(h, {a}, 8) as bigint)) as varchar) as lane{i}"
_LANES = ", ".join(_LANE.format(a=8 * i + 1, i=i) for i in range(4))
_DIGESTS = " union all ".join(
    f"select '{name}' as name, dealt, count(*) as n, {_LANES} from (select md5({' || '.join(f'''coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')''' for c in columns)}) as h from {name}) t cross join (values (0::bigint), (1::bigint)) v(dealt) group by dealt"
    for name, columns in DIGESTED.items()
)
_LON_M = "(111412.84 * cos(p) - 93.5 * cos(3 * p) + 0.118 * cos(5 * p))"
_LAT_M = "(111132.954 - 559.822 * cos(2 * p) + 1.175 * cos(4 * p))"
define("degree_grid", ("grid_h",), f"select h, {NORTH}::double as north, {WEST}::double as west, {LAT_STEP}::double as dlat, {LON_STEP}::double as dlon from grid_h")
define(
    "border_zoned",
    ("degree_grid",),
    """select 0 as id, north - a * h * dlat as lat, west + b * 100 * dlon as lon, 18::bigint as zone, 'T' as band from degree_grid cross join
    (select unnest([0.0::double, 1.0, t, t]) as a, unnest([t, t, 0.0::double, 1.0]) as b from (select k / 20.0::double as t from range(21) u(k)) v) w""",
)
copy_of("projected", {"zoned": "border_zoned", "projected": "border_projected"})
define(
    "target_grid",
    ("border_projected", "degree_grid"),
    f"""select *, cast(ceil((top - n0) / cell - 1e-9) as bigint) as n_rows, cast(ceil((e1 - left_e) / cell - 1e-9) as bigint) as n_cols from (
      select *, floor(e0 / cell) * cell as left_e, ceil(n1 / cell) * cell as top from (select min(east) as e0, max(east) as e1, min(north) as n0, max(north) as n1 from border_projected) b
      cross join (select sqrt(dlat * {_LAT_M} * dlon * {_LON_M}) as cell from (select *, radians(north - h * dlat / 2) as p from degree_grid) g) c) d""",
)
define("target_cells", ("target_grid",), "select i * n_cols + j as id, i, j, left_e + (j + 0.5) * cell as east, top - (i + 0.5) * cell as north, 18 as zone, 1.0 as lat from (select *, unnest(range(n_cols)) as j from (select *, unnest(range(n_rows)) as i from target_grid) a) b")
copy_of("returned", {"projected": "target_cells", "returned": "target_returned"})
define(
    "resampled",
    ("target_cells", "target_returned", "degree_grid", "cells"),
    """select t.i as r, t.j as c, t.east as x, t.north as y, v.z from target_cells t left join (
      select id, case when count(z) = 4 then sum(z * (case when i = 1 then v - floor(v) else 1 - v + floor(v) end) * (case when j = 1 then u - floor(u) else 1 - u + floor(u) end)) end as z
      from (select id, (north - lat) / dlat - 0.5 as v, (lon - west) / dlon - 0.5 as u from target_returned cross join degree_grid) p cross join range(2) a(i) cross join range(2) b(j)
      join cells k on k.r = cast(floor(v) as bigint) + i and k.c = cast(floor(u) as bigint) + j group by id) v using (id)""",
)
define(
    "tile_p05",
    ("cells", "grid_h"),
    f"""select index, count(*) as sampled, quantile_cont(d, 0.05) as p05, avg(case when d < -0.5 then 1.0 else 0 end) as below from (
      select (i * n_c + j + 1) as index, dsm - z as d from cells join (
        select i, j, n_c, cast(round_even(h * i / cast(n_r as double), 0) as bigint) as r0, cast(round_even(h * (i + 1) / cast(n_r as double), 0) as bigint) as r1, cast(round_even(100 * j / cast(n_c as double), 0) as bigint) as c0, cast(round_even(100 * (j + 1) / cast(n_c as double), 0) as bigint) as c1
        from (select *, unnest(range(n_c)) as j from (select *, unnest(range(n_r)) as i from (select h, (h + {TILE_PX - 1}) // {TILE_PX} as n_r, (100 + {TILE_PX - 1}) // {TILE_PX} as n_c from grid_h) a) b) c) t
      on r >= r0 and r < r1 and c >= c0 and c < c1 where r % 2 = 0 and c % 2 = 0 and dsm - z is not null) e group by index having count(*) >= 50""",
)
define("outline_ends", ("features",), "select * from features where kind <> 'point' union all select fid, kind, part, i + 1, first_x, first_y, agl_m from (select *, first(x) over w as first_x, first(y) over w as first_y, i = max(i) over (partition by fid, part) as last from features where kind = 'area' window w as (partition by fid, part order by i)) t where last")
define(
    "outlines",
    ("outline_ends",),
    """select fid, agl_m, step, x + (x2 - x) * k / n as x, y + (y2 - y) * k / n as y from (select *, unnest(range(n)) as k from (
      select *, greatest(1, cast(ceil(sqrt((x2-x)*(x2-x) + (y2-y)*(y2-y)) / step) as bigint)) as n from (select *, lead(x) over w as x2, lead(y) over w as y2 from outline_ends window w as (partition by fid, part order by i)) a
      cross join (values (0.5::double), (5::double)) t(step) where x2 is not null) b) c
    union all select fid, agl_m, step, x, y from (select *, lead(x) over (partition by fid, part order by i) is null as last from outline_ends) d cross join (values (0.5::double), (5::double)) t(step) where last""",
)
define("over_cells", ("outlines", "features", "grid_h", "cells", "poly_fid"), f"""
    select k.r, k.c, t.agl_m, t.fid from cells k join (select distinct fid, agl_m, cast(floor(h - y) as bigint) as r, cast(floor(x) as bigint) as c from outlines cross join grid_h where step = 0.5) t on (k.r - t.r)*(k.r - t.r) + (k.c - t.c)*(k.c - t.c) <= {BUFFER_M * BUFFER_M}
    union all select k.r, k.c, agl_m, fid from cells k join features f on kind = 'point' and (k.x - f.x)*(k.x - f.x) + (k.y - f.y)*(k.y - f.y) <= {BUFFER_M * BUFFER_M}
    union all select r, c, agl_m, fid from poly_fid join (select distinct fid, agl_m from features where kind = 'area') a using (fid)""")
define("tallest_over", ("over_cells",), "select r, c, agl_m, fid as owner from (select *, row_number() over (partition by r, c order by agl_m desc, fid) as n from over_cells) t where n = 1")
define("feature_tops", ("outlines", "features", "grid_h", "cells"), "select fid as owner, p.x, p.y, z + agl_m as top_m from (select fid, agl_m, x, y from outlines where step = 5 union all select fid, agl_m, x, y from features where kind = 'point') p cross join grid_h join (select r, c, z from cells) k on k.r = cast(floor(h - p.y) as bigint) and k.c = cast(floor(p.x) as bigint) where z is not null")
copy_of("listed_sectors", {"tops": "feature_tops", "listed_sectors": "feature_listed"})
ORACLES = {
    "content_digests": _DIGESTS,
    "utm_resample": sql("select r, c, round(x, 3) as x, round(y, 3) as y, round(z, 4) as z from resampled", "resampled"),
    "distance_unbounded": sql("select r, c, round((select sqrt(min((k.r - p.r)*(k.r - p.r) + (k.c - p.c)*(k.c - p.c))) from poly p), 4) as distance from cells k", "cells", "poly"),
    "tile_surface_check": sql("select index, sampled, round(p05, 4) as p05, round(below, 4) as below, abs(p05) > 0.5 or below > 0.05 as flagged from tile_p05", "tile_p05"),
    "run_surface_check": sql("select count(*) as tiles, count(case when abs(p05) > 0.5 or below > 0.05 then 1 end) as flagged, round(median(p05), 4) as median_p05 from tile_p05", "tile_p05"),
    "distinct_sketches": "select l_returnflag as part, count(distinct l_orderkey) as exact, true as within from lineitem group by 1 union all select 'all', count(distinct l_orderkey), true from lineitem",
    "quantile_sketches": "select cast(q as double) as q, (select count(*) from lineitem) as n, round((select quantile_cont(cast(l_extendedprice as double), [0.05, 0.5, 0.95])[i] from lineitem), 4) as exact, true as within from (values (0.05, 1), (0.5, 2), (0.95, 3)) t(q, i)",
    "sectors_json": sql("select r, c, azimuth, round(worst, 3) as worst, round(coverage, 3) as coverage, class from sectors", "sectors"),
    "plan_tiles_of_extents": sql(
        """select fid, i * n_c + j + 1 as index, cast(round_even(h * i / cast(n_r as double), 0) as bigint) as r0, cast(round_even(h * (i + 1) / cast(n_r as double), 0) as bigint) as r1, cast(round_even(w * j / cast(n_c as double), 0) as bigint) as c0, cast(round_even(w * (j + 1) / cast(n_c as double), 0) as bigint) as c1
        from (select *, unnest(range(n_c)) as j from (select *, unnest(range(n_r)) as i from (select *, (h + 4) // 5 as n_r, (w + 4) // 5 as n_c from (select fid, cast(ceil((max(y) - min(y)) * (1 + fid % 4)) as bigint) as h, cast(ceil((max(x) - min(x)) * (2 + fid % 3)) as bigint) as w from polygons group by fid) a) b) c) d""",
        "polygons",
    ),
    "cell_windows": "select o_orderkey // 100 as r, o_orderkey % 100 as c, round(cast(o_totalprice as double), 2) as price from orders where o_orderkey // 100 between 7 and 94 and o_orderkey % 100 between 13 and 58",
    "footprint_heights": sql("select r, c, round(agl_m, 6) as agl_m, owner from tallest_over", "tallest_over"),
    "footprint_burn": sql("select k.r, k.c, round(case when z + agl_m is null then dsm else greatest(coalesce(dsm, z + agl_m), z + agl_m) end, 4) as dsm from cells k left join tallest_over o on o.r = k.r and o.c = k.c", "cells", "tallest_over"),
    "footprint_sectors": sql("select r, c, azimuth, round(listed, 3) as listed, owner from feature_listed", "feature_listed"),
}
