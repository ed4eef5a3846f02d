"""Mask, distance and removal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.operators import classify, masks, spatial
from gridsift.plans.ground import cells, classes
from gridsift.plans.oracle import define, sql
from gridsift.sources.bindings import bind


def height(s, d) -> int:
    """Rows of the grid."""
    return cells(s, d).agg(F.max("r").alias("r")).first()["r"] + 1


def _h(s, d):
    return F.lit(height(s, d)).cast("double")


def polygon(s, d):
    return masks.polygon_cells(bind(s, d, "polygons"), cells(s, d)).select("r", "c").distinct()


def line(s, d, width):
    return masks.line_cells(bind(s, d, "lines"), cells(s, d), _h(s, d), width)


def point(s, d):
    return masks.point_cells(bind(s, d, "obstacles"), cells(s, d), _h(s, d), 3.0)


def circle(s, d):
    return masks.circle_cells(cells(s, d), bind(s, d, "circles"))


def footprints(s, d):
    h = _h(s, d)
    own = masks.cell_of(bind(s, d, "obstacles"), h)
    return own.select("r", "c", "agl_m")


def removed(s, d):
    return classify.remove(classify.remove(classes(s, d), masks.grow(polygon(s, d), 3.0), 8), masks.grow(footprints(s, d), 6.0), 9)


def distance(s, d):
    return masks.nearest_distance(cells(s, d), polygon(s, d), 9.0)


def nearest_obstacle(s, d):
    own = bind(s, d, "points").select("id", (F.col("x") / 10).alias("x"), "y")
    other = bind(s, d, "obstacles").select("owner", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return spatial.nearest(own, other, "id", "owner", 30.0).select("id", "owner", F.round("distance", 4).alias("distance"))


QUERIES = {
    "mask_polygon": polygon,
    "mask_polygon_by_feature": lambda s, d: masks.polygon_cells(bind(s, d, "polygons"), cells(s, d)).groupBy("fid").agg(F.count(F.lit(1)).alias("cells"), F.min("r").alias("first_row"), F.max("c").alias("last_col")),
    "mask_line_thin": lambda s, d: line(s, d, 0.0),
    "mask_line_wide": lambda s, d: line(s, d, 10.0),
    "mask_point": point,
    "mask_circle": circle,
    "mask_union": lambda s, d: polygon(s, d).union(line(s, d, 0.0)).union(point(s, d)).distinct(),
    "mask_intersect": lambda s, d: polygon(s, d).intersect(circle(s, d)),
    "mask_subtract": lambda s, d: cells(s, d).select("r", "c").join(polygon(s, d), ["r", "c"], "left_anti").groupBy("r").agg(F.count(F.lit(1)).alias("cells")),
    "mask_xor": lambda s, d: polygon(s, d).union(point(s, d)).groupBy("r", "c").count().filter("count % 2 = 1").select("r", "c"),
    "mask_aoi_default": lambda s, d: cells(s, d).select("r", "c").join(circle(s, d).withColumn("inside", F.lit(True)), ["r", "c"], "left").select("r", "c", F.coalesce("inside", F.lit(False)).alias("inside")),
    "distance_to_mask": lambda s, d: distance(s, d).select("r", "c", F.round("distance", 4).alias("distance")),
    "exclusion_removal": lambda s, d: removed(s, d).groupBy("reason", "ground").agg(F.count(F.lit(1)).alias("cells")),
    "obstacle_burn": lambda s, d: masks.burn_heights(cells(s, d), footprints(s, d)).select("r", "c", F.round("dsm", 4).alias("dsm")),
    "obstacle_removal": lambda s, d: removed(s, d).filter("reason = 9").select("r", "c"),
    "obstacle_ground": lambda s, d: masks.cell_of(bind(s, d, "obstacles"), _h(s, d)).join(cells(s, d).filter("z is not null").select("r", "c", "z"), ["r", "c"]).select("owner", "r", "c", F.round(F.col("z") + F.col("agl_m"), 4).alias("top_m")),
    "obstacle_counts": lambda s, d: bind(s, d, "obstacles").agg(F.count(F.lit(1)).alias("n"), F.count_if("assumed").alias("assumed"), F.round(F.max("agl_m"), 4).alias("tallest_m"), F.max_by("owner", F.struct(F.col("agl_m"), -F.col("owner"))).alias("tallest")),
    "nearest_obstacle": nearest_obstacle,
    "nearest_centre": lambda s, d: masks.nearest_centre(bind(s, d, "points"), bind(s, d, "circles")).select("id", "centre", F.round("distance", 4).alias("distance"), F.round("bearing", 4).alias("bearing")),
    "feature_bounds": lambda s, d: bind(s, d, "polygons").groupBy("fid").agg(*(f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))), F.round(F.avg("x"), 4).alias("x_mean")),
    "bbox_overlap": lambda s, d: (lambda b: spatial.boxes_meet(b, b.select(F.col("fid").alias("other"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("y0").alias("v0"), F.col("y1").alias("v1")), 16.0).filter("fid < other").select("fid", "other"))(bind(s, d, "polygons").groupBy("fid").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))),
}

define("edges", ("polygons",), "select fid, x as x1, y as y1, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from polygons window w as (partition by fid, ring order by i)")
define("poly_fid", ("edges", "cells"), "select fid, r, c from cells join edges on least(y1, y2) <= cells.y and cells.y < greatest(y1, y2) and x1 + (cells.y - y1) * (x2 - x1) / (y2 - y1) <= cells.x group by fid, r, c having count(*) % 2 = 1")
define("poly", ("poly_fid",), "select distinct r, c from poly_fid")
define("grid_h", ("cells",), "select max(r) + 1 as h from cells")
define("segments", ("lines",), "select fid, part, i, x, y, lead(x) over w as x2, lead(y) over w as y2 from lines window w as (partition by fid, part order by i)")
define("dense", ("segments",), "select fid, part, s, n, k, x + (x2 - x) * k / n as x, y + (y2 - y) * k / n as y from (select *, unnest(range(n)) as k from (select *, greatest(1, cast(ceil(sqrt((x2-x)*(x2-x) + (y2-y)*(y2-y)) / s) as bigint)) as n from segments cross join (values (0.5::double), (5::double)) t(s) where x2 is not null) a) b union all select fid, part, s, 1, 0, x, y from segments cross join (values (0.5::double), (5::double)) t(s) where x2 is null")
define("touched", ("dense", "grid_h"), "select distinct cast(floor(h - y) as bigint) as r, cast(floor(x) as bigint) as c from dense cross join grid_h where s = 0.5")
define("line0", ("touched", "cells"), "select r, c from touched join cells using (r, c)")
define("line10", ("touched", "cells"), "select distinct c.r, c.c from cells c join touched t on (c.r - t.r)*(c.r - t.r) + (c.c - t.c)*(c.c - t.c) <= 25")
define("near_points", ("cells", "obstacles", "grid_h"), "select distinct c.r, c.c from cells c cross join grid_h join obstacles o on (c.x - o.x)*(c.x - o.x) + (c.y - o.y)*(c.y - o.y) <= 9 or (c.r = floor(h - o.y) and c.c = floor(o.x))")
define("in_circle", ("cells", "circles"), "select r, c from cells where exists (select 1 from circles o where (cells.x - o.x)*(cells.x - o.x) + (cells.y - o.y)*(cells.y - o.y) <= radius*radius)")
define("own_cells", ("obstacles", "grid_h"), "select owner, agl_m, cast(floor(h - y) as bigint) as r, cast(floor(x) as bigint) as c from obstacles cross join grid_h")
define("excluded", ("cells", "poly"), "select distinct c.r, c.c from cells c join poly p on (c.r - p.r)*(c.r - p.r) + (c.c - p.c)*(c.c - p.c) <= 9")
define("listed", ("cells", "own_cells"), "select distinct c.r, c.c from cells c join own_cells p on (c.r - p.r)*(c.r - p.r) + (c.c - p.c)*(c.c - p.c) <= 36")
define(
    "removed",
    ("classes", "excluded", "listed"),
    """select k.r, k.c, case when ground in (1, 2) and e.r is not null then 8 when ground in (1, 2) and l.r is not null then 9 else reason end as reason,
    case when ground in (1, 2) and (e.r is not null or l.r is not null) then 0 else ground end as ground from classes k left join excluded e using (r, c) left join listed l using (r, c)""",
)
ORACLES = {
    "mask_polygon": sql("select r, c from poly", "poly"),
    "mask_polygon_by_feature": sql("select fid, count(*) as cells, min(r) as first_row, max(c) as last_col from poly_fid group by fid", "poly_fid"),
    "mask_line_thin": sql("select r, c from line0", "line0"),
    "mask_line_wide": sql("select r, c from line10", "line10"),
    "mask_point": sql("select r, c from near_points", "near_points"),
    "mask_circle": sql("select r, c from in_circle", "in_circle"),
    "mask_union": sql("select r, c from poly union select r, c from line0 union select r, c from near_points", "poly", "line0", "near_points"),
    "mask_intersect": sql("select r, c from poly intersect select r, c from in_circle", "poly", "in_circle"),
    "mask_subtract": sql("select r, count(*) as cells from (select r, c from cells except select r, c from poly) t group by r", "cells", "poly"),
    "mask_xor": sql("select r, c from (select r, c from poly union all select r, c from near_points) t group by r, c having count(*) % 2 = 1", "poly", "near_points"),
    "mask_aoi_default": sql("select k.r, k.c, i.r is not null as inside from cells k left join in_circle i on i.r = k.r and i.c = k.c", "cells", "in_circle"),
    "distance_to_mask": sql("select k.r, k.c, round(min(sqrt((k.r - p.r)*(k.r - p.r) + (k.c - p.c)*(k.c - p.c))), 4) as distance from cells k left join poly p on (k.r - p.r)*(k.r - p.r) + (k.c - p.c)*(k.c - p.c) <= 81 group by k.r, k.c", "cells", "poly"),
    "exclusion_removal": sql("select reason, ground, count(*) as cells from removed group by reason, ground", "removed"),
    "obstacle_burn": sql("select k.r, k.c, round(case when z + agl is null then dsm else greatest(coalesce(dsm, z + agl), z + agl) end, 4) as dsm from cells k left join (select r, c, max(agl_m) as agl from own_cells group by r, c) o on o.r = k.r and o.c = k.c", "cells", "own_cells"),
    "obstacle_removal": sql("select r, c from removed where reason = 9", "removed"),
    "obstacle_ground": sql("select owner, r, c, round(z + agl_m, 4) as top_m from own_cells join cells using (r, c) where z is not null", "own_cells", "cells"),
    "obstacle_counts": sql("select count(*) as n, count(case when assumed then 1 end) as assumed, round(max(agl_m), 4) as tallest_m, (select owner from obstacles order by agl_m desc, owner limit 1) as tallest from obstacles", "obstacles"),
    "nearest_obstacle": sql("select id, owner, round(d, 4) as distance from (select id, owner, sqrt(d2) as d, row_number() over (partition by id order by sqrt(d2), owner) as n from (select p.id, o.owner, (p.x/10 - o.x)*(p.x/10 - o.x) + (p.y - o.y)*(p.y - o.y) as d2 from points p cross join obstacles o) a where d2 <= 900 + 1e-9) b where n = 1", "points", "obstacles"),
    "nearest_centre": sql("select id, centre, round(distance, 4) as distance, round(bearing, 4) as bearing from (select p.id, o.id as centre, sqrt((p.x-o.x)*(p.x-o.x) + (p.y-o.y)*(p.y-o.y)) as distance, (degrees(atan2(p.x-o.x, p.y-o.y)) + 360) % 360 as bearing, row_number() over (partition by p.id order by sqrt((p.x-o.x)*(p.x-o.x) + (p.y-o.y)*(p.y-o.y)), o.id) as n from points p cross join circles o) t where n = 1", "points", "circles"),
    "feature_bounds": sql("select fid, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, round(avg(x), 4) as x_mean from polygons group by fid", "polygons"),
    "bbox_overlap": sql("select a.fid, b.fid as other from (select fid, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from polygons group by fid) a join (select fid, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from polygons group by fid) b on a.fid < b.fid and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1", "polygons"),
}
