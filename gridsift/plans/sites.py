"""Candidate, approach, scoring and site queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.operators import approach, candidates, masks, scoring, spatial
from gridsift.plans.ground import AIRCRAFT, MISSION, cells, classes
from gridsift.plans.masks import height
from gridsift.operators.storage import Store
from gridsift.plans.oracle import copy_of, define, sql
from gridsift.sources.bindings import bind
from gridsift.sources.profiles import Doctrine

DOCTRINE = Doctrine()
TILE_PX = 10


def checked(s, d):
    return candidates.checked(cells(s, d), classes(s, d), AIRCRAFT, MISSION)


def chosen(s, d):
    """The best site of each tile, written out: several steps read it."""
    return Store(s, "chosen").put("sites", candidates.best_per_tile(checked(s, d), cells(s, d), AIRCRAFT, TILE_PX))


def rays(s, d, sites=None):
    return approach.ray_worst(sites if sites is not None else chosen(s, d), cells(s, d), height(s, d), AIRCRAFT, MISSION)


def listed(s, d, sites):
    top = masks.cell_of(bind(s, d, "obstacles"), F.lit(height(s, d)).cast("double")).join(cells(s, d).filter("z is not null").select("r", "c", "z"), ["r", "c"]).select("owner", "x", "y", (F.col("z") + F.col("agl_m")).alias("top_m"))
    return approach.listed_angles(sites, top, AIRCRAFT, MISSION)


def swept(s, d, with_listed=False, sites=None):
    sites = sites if sites is not None else chosen(s, d)
    return approach.sectors(rays(s, d, sites), AIRCRAFT, MISSION, listed(s, d, sites) if with_listed else None)


def summarized(s, d):
    sites = chosen(s, d)
    return approach.summarize(sites, swept(s, d, sites=sites), MISSION)


def scored(s, d):
    return scoring.components(summarized(s, d), AIRCRAFT, MISSION)


def rated(s, d):
    return scoring.rate(scored(s, d), AIRCRAFT, DOCTRINE)


def ranked(s, d):
    return scoring.rank(rated(s, d), MISSION.max_candidates)


def grouped(s, d):
    """The ranked sites, written out, as several steps read them, with groups and roles."""
    ranks = Store(s, "ranked").put("ranks", ranked(s, d).select("rank", "site_id", "x", "y").withColumn("rank", F.col("rank").cast("long")))
    return scoring.roles(spatial.groups(ranks, 15.0, key="rank"))


def spaced(s, d):
    return spatial.suppress(bind(s, d, "points").select("id", "x", "y", (-F.col("score")).alias("worse")), 30.0, ["worse"])


def _nms(s, d):
    return candidates.select_apart(checked(s, d), cells(s, d), AIRCRAFT, MISSION)


def screened(s, d):
    """The whole dataflow: selection over the grid, approaches, scores, ranks."""
    grid, store = cells(s, d), Store(s, "screening")
    sites = store.put("sites", _nms(s, d))
    found = store.put("sectors", approach.sectors(approach.ray_worst(sites, grid, height(s, d), AIRCRAFT, MISSION), AIRCRAFT, MISSION))
    out = scoring.rank(scoring.rate(scoring.components(approach.summarize(sites, found, MISSION), AIRCRAFT, MISSION), AIRCRAFT, DOCTRINE), MISSION.max_candidates)
    return out.select("rank", "site_id", "r", "c", "rating", "score", "limiting", "assessed", "clear", "best_azimuth", "best_angle", "heading")


def _round4(*names):
    return [F.round(n, 4).alias(n) for n in names]


QUERIES = {
    "quality_surface": lambda s, d: candidates.quality(classes(s, d), AIRCRAFT).select("r", "c", *_round4("edge", "quality")),
    "edge_distance": lambda s, d: candidates.quality(classes(s, d), AIRCRAFT).filter("edge < 1").groupBy(F.round("edge", 4).alias("edge")).agg(F.count(F.lit(1)).alias("cells")),
    "exact_pass": lambda s, d: checked(s, d).groupBy("passes").agg(F.count(F.lit(1)).alias("cells")),
    "topk_candidates": lambda s, d: checked(s, d).filter("passes").orderBy(F.desc("quality"), "r", "c").limit(25).select("r", "c", F.round("quality", 4).alias("quality")),
    "topk_per_tile": lambda s, d: chosen(s, d).select("r", "c", "elevation", "slope", "aspect", "roughness", "ring_obstacle", "upslope", "quality"),
    "candidate_selection": lambda s, d: _nms(s, d).select("r", "c", "elevation", "slope", "quality"),
    "component_sizes": lambda s, d: spatial.cell_groups(classes(s, d).filter(F.col("ground").isin(1, 2)).select("r", "c")).groupBy("root").agg(F.count(F.lit(1)).alias("cells")).select("cells", F.floor(F.col("root") / F.lit(1 << 31)).alias("r"), (F.col("root") % F.lit(1 << 31)).alias("c")),
    "ray_worst": lambda s, d: rays(s, d).select(F.col("r0").alias("r"), F.col("c0").alias("c"), "ray", F.round("worst", 3).alias("worst"), "distance", *_round4("coverage")),
    "sector_class": lambda s, d: swept(s, d).select(F.col("r0").alias("r"), F.col("c0").alias("c"), "azimuth", F.round("worst", 3).alias("worst"), F.round("coverage", 3).alias("coverage"), "class"),
    "sector_letters": lambda s, d: approach.class_letters(swept(s, d)).select(F.col("r0").alias("r"), F.col("c0").alias("c"), "letters"),
    "sector_listed_obstacle": lambda s, d: swept(s, d, True).select(F.col("r0").alias("r"), F.col("c0").alias("c"), "azimuth", F.round("worst", 3).alias("worst"), "class", F.coalesce("obstacle", F.lit(-1)).alias("obstacle")),
    "best_approach": lambda s, d: summarized(s, d).select("r", "c", "total", "assessed", "clear", "best_azimuth", "best_angle", "heading"),
    "opposing_corridors": lambda s, d: summarized(s, d).select("r", "c", "opposing"),
    "sector_ranges": lambda s, d: approach.ranges(swept(s, d), approach.CLEAR, MISSION).select(F.col("r0").alias("r"), F.col("c0").alias("c"), "first", "last", "sectors"),
    "wind_helper": lambda s, d: approach.wind_choice(swept(s, d), 247.0, 12.0).select(F.col("r0").alias("r"), F.col("c0").alias("c"), "azimuth", "off", "headwind", "crosswind"),
    "score_components": lambda s, d: scored(s, d).select("r", "c", *_round4("slope_part", "roughness_part", "approach_part", "obstacle_part"), "score"),
    "score_rating": lambda s, d: rated(s, d).select("r", "c", "rating", "gate", "notes"),
    "limiting_factor": lambda s, d: rated(s, d).groupBy("limiting").agg(F.count(F.lit(1)).alias("sites")),
    "rank_ids": lambda s, d: ranked(s, d).select("r", "c", F.col("rank").cast("long").alias("rank"), "site_id"),
    "rating_counts": lambda s, d: scoring.rating_counts(s, rated(s, d)),
    "rating_cube": lambda s, d: rated(s, d).cube("rating", "limiting").agg(F.count(F.lit(1)).alias("sites")),
    "rating_rollup": lambda s, d: rated(s, d).rollup("rating", "upslope").agg(F.count(F.lit(1)).alias("sites")),
    "rating_pivot": lambda s, d: rated(s, d).groupBy("limiting").pivot("rating", list(scoring.RATINGS)).agg(F.count(F.lit(1))).select("limiting", *(F.coalesce(x, F.lit(0)).alias(x.lower().replace(" ", "_")) for x in scoring.RATINGS)),
    "density_altitude": lambda s, d: cells(s, d).filter("z is not null").select("r", "c", F.round(scoring.density_altitude_ft(F.col("z"), F.lit(29.5) + F.col("c") / 40.0, F.col("r") % 70 - 5.0), 3).alias("density_altitude_ft")),
    "min_spacing": lambda s, d: spaced(s, d).select("id"),
    "seam_pairs": lambda s, d: spatial.close_pairs(bind(s, d, "points").select("id", "x", "y"), 12.0).select("id", "other", F.round("distance", 4).alias("distance")),
    "site_groups": lambda s, d: spatial.groups(bind(s, d, "points"), 14.0).select("id", "root"),
    "site_roles": lambda s, d: grouped(s, d).select(F.col("rank").cast("long").alias("rank"), "site_id", F.col("site_no").cast("long").alias("site_no"), "role", "primary_id", "alternates"),
    "spacing_summary": lambda s, d: grouped(s, d).agg(F.countDistinct("site_no").alias("sites"), F.countDistinct(F.when(F.col("rank") <= 10, F.col("site_no"))).alias("sites_top10"), F.count(F.lit(1)).alias("candidates")),
    "site_screening": screened,
}

define("fails", ("classes",), "select r, c from classes where ground not in (1, 2)")
define(
    "quality_cells",
    ("classes", "fails"),
    """select k.*, least(1.0, coalesce(sqrt(d2) / 3, 1.0)) as edge, 0.35 * least(1, greatest(0, 1 - slope / 10)) + 0.25 * least(1, greatest(0, 1 - roughness / 0.3)) + 0.15 * least(1, greatest(0, 1 - coalesce(area_obstacle, 1) / 1.0)) + 0.25 * least(1.0, coalesce(sqrt(d2) / 3, 1.0)) - case when ground = 2 then 0.5 else 0 end as quality
  from classes k left join (select p.r, p.c, min((p.r-q.r)*(p.r-q.r) + (p.c-q.c)*(p.c-q.c)) as d2 from classes p join fails q on q.r between p.r - 3 and p.r + 3 and q.c between p.c - 3 and p.c + 3 where p.ground in (1, 2) and (p.r-q.r)*(p.r-q.r) + (p.c-q.c)*(p.c-q.c) <= 9 group by p.r, p.c) e using (r, c) where ground in (1, 2)""",
)
define(
    "checked",
    ("exact", "quality_cells"),
    """select x.*, round(q.quality, 6) as quality, coalesce(x.slope is not null and x.residual is not null and x.valid_fraction >= 0.95 and x.slope <= 10 and x.residual <= 0.3 and x.tdp_coverage >= 0.95 and x.tdp_obstacle <= 0.3
    and (x.ring_obstacle is null or x.ring_obstacle <= 1) and x.ring_coverage >= 0.9, false) as passes from exact x join quality_cells q using (r, c)""",
)
_ATTRIBUTES = "r, c, x, y, round(z, 2) as elevation, round(slope, 2) as slope, round(aspect, 1) as aspect, round(residual, 3) as roughness, round(tdp_obstacle, 2) as tdp_obstacle, round(ring_obstacle, 2) as ring_obstacle, round(ring_coverage, 3) as ring_coverage, slope > 6 as upslope, round(quality, 4) as quality"
define("chosen", ("checked", "cells"), f"select {_ATTRIBUTES} from (select *, row_number() over (partition by r // 10, c // 10 order by quality desc, r, c) as place from checked where passes) a join (select r, c, x, y, z from cells) b using (r, c) where place = 1")
define(
    "rays",
    ("chosen", "cells"),
    """select r, c, ray, max(angle) as worst, min(case when angle = top then distance end) as distance, avg(case when angle is not null then 1.0 else 0 end) as coverage from (
    select *, max(angle) over (partition by r, c, ray) as top from (
      select s.r, s.c, s.ray, s.distance, degrees(atan2(coalesce(k.dsm, k.z) - s.level, s.distance)) as angle from (
        select r, c, elevation + 2 as level, ray, distance, cast(floor(x + sin(radians(ray * 5.0::double)) * distance + 1e-9) as bigint) as sc, cast(floor((select max(r) + 1 from cells) - (y + cos(radians(ray * 5.0::double)) * distance) + 1e-9) as bigint) as sr
        from chosen cross join range(72) a(ray) cross join (select cast(d as double) as distance from range(3, 31) t(d)) b) s left join cells k on k.r = s.sr and k.c = s.sc) t) u group by r, c, ray""",
)
define("sector_rays", ("rays",), "select r, c, cast(s * 10 as double) as azimuth, worst, coverage from rays join range(36) a(s) on abs((((ray * 5.0 - s * 10.0 + 180) % 360) + 360) % 360 - 180) <= 15 + 1e-9")
_KIND = "case when worst is null then 'INCOMPLETE' when worst > 7 then 'BLOCKED' when coverage < 0.8 then 'INCOMPLETE' when worst <= 3 then 'CLEAR' else 'MARGINAL' end"
define("sectors", ("sector_rays",), f"select *, {_KIND} as class from (select r, c, azimuth, max(worst) as worst, avg(coverage) as coverage from sector_rays group by r, c, azimuth) a")
define("tops", ("own_cells", "obstacles", "cells"), "select o.owner, b.x, b.y, z + o.agl_m as top_m from own_cells o join obstacles b using (owner) join (select r, c, z from cells) k using (r, c) where z is not null")
define(
    "listed_sectors",
    ("chosen", "tops"),
    """select r, c, azimuth, listed, owner from (select *, row_number() over (partition by r, c, azimuth order by listed desc, owner) as n from (
    select k.r, k.c, s * 10.0::double as azimuth, t.owner, degrees(atan2(t.top_m - (k.elevation + 2), greatest(sqrt((t.x-k.x)*(t.x-k.x) + (t.y-k.y)*(t.y-k.y)) - 10, 3))) as listed
    from chosen k join tops t on greatest(sqrt((t.x-k.x)*(t.x-k.x) + (t.y-k.y)*(t.y-k.y)) - 10, 3) <= 30 join range(36) a(s) on abs((((degrees(atan2(t.x-k.x, t.y-k.y)) - s * 10.0 + 180) % 360) + 360) % 360 - 180) <= 15 + 1e-9) b) c where n = 1""",
)
define("best", ("sectors", "chosen"), "select * from (select s.r, s.c, azimuth, worst, row_number() over (partition by s.r, s.c order by worst, azimuth) as n from sectors s join chosen k on k.r = s.r and k.c = s.c where class <> 'INCOMPLETE' and worst is not null and (not upslope or aspect is null or abs(((((azimuth + 180) % 360 - (aspect + 180) % 360 + 180) % 360) + 360) % 360 - 180) <= 30)) t where n = 1")
define(
    "summary",
    ("chosen", "sectors", "best"),
    """select k.*, total, assessed, clear, b.azimuth as best_azimuth, round(b.worst, 2) as best_angle, (b.azimuth + 180) % 360 as heading, coalesce(opposing, false) as opposing from chosen k
  left join (select r, c, count(*) as total, count(case when class <> 'INCOMPLETE' and worst is not null then 1 end) as assessed, count(case when class = 'CLEAR' then 1 end) as clear from sectors group by r, c) t using (r, c)
  left join best b using (r, c)
  left join (select distinct p.r, p.c, true as opposing from sectors p join sectors q on p.r = q.r and p.c = q.c and p.azimuth < q.azimuth and p.class = 'CLEAR' and q.class = 'CLEAR' and abs(abs((((p.azimuth - q.azimuth + 180) % 360) + 360) % 360 - 180) - 180) <= 10) o using (r, c)""",
)
define(
    "scored",
    ("summary",),
    """select *, round(100.0 * (slope_part * 25 + roughness_part * 20 + approach_part * 30 + obstacle_part * 15 + 1.0 * 10) / 100.0, 1) as score from (
    select *, case when upslope then 0.5 * least(1, greatest(0, 1 - slope / 10)) else least(1, greatest(0, 1 - slope / 6)) end as slope_part, least(1, greatest(0, 1 - roughness / 0.3)) as roughness_part,
      case when opposing then least(1.0, base + 0.1) else base end as approach_part, least(1, greatest(0, 1 - greatest(coalesce(tdp_obstacle, 0) / 0.3, coalesce(ring_obstacle, 0) / 1.0))) as obstacle_part
    from (select *, case when angle_part > 0 then 0.8 * angle_part + 0.2 * least(1, (coalesce(clear, 0) / cast(greatest(coalesce(total, 1), 1) as double)) / 0.25) else 0.0 end as base
      from (select *, case when best_angle is null then 0.0 when best_angle <= 3 then 1.0 else least(1, greatest(0, 1 - (best_angle - 3) / 4)) end as angle_part from summary) a) b) c""",
)
define(
    "rated",
    ("scored",),
    """select *, case place when 0 then 'Highly Suitable' when 1 then 'Suitable' when 2 then 'Marginal' when 3 then 'Unassessed' else 'Unsuitable' end as rating,
    coalesce(gate, case when least(slope_part, roughness_part, approach_part, obstacle_part) >= 0.9 then 'none' when approach_part <= least(slope_part, roughness_part, obstacle_part) then 'approach' when obstacle_part <= least(slope_part, roughness_part) then 'obstacle' when roughness_part <= slope_part then 'roughness' else 'slope' end) as limiting,
    concat_ws('; ', case when upslope then 'upslope landing only' end, case when steep and gate is null then 'steep approach only' end) as notes
  from (select *, case when gate = 'approach not assessable' then 3 when gate is not null then 4 else greatest(case when score >= 80 then 0 when score >= 60 then 1 when score >= 40 then 2 else 4 end, case when steep then 2 else 0 end, case when upslope then 1 else 0 end) end as place
    from (select *, coalesce(best_angle > 3, false) as steep, case when coalesce(total, 0) > 0 and assessed = 0 then 'approach not assessable' when coalesce(total, 0) > 0 and best_angle is null and upslope then 'no approach in the uphill direction'
        when coalesce(total, 0) > 0 and best_angle is null then 'no usable approach' when best_angle > 7 then 'all approaches blocked' end as gate from scored) a) b""",
)
define("ranked", ("rated",), "select *, 'S-' || lpad(cast(rank as varchar), cast(greatest(2, length(cast(count(*) over () as varchar))) as int), '0') as site_id from (select *, row_number() over (order by place, score desc, assessed desc, clear desc, quality desc, r, c) as rank from rated) a where rank <= 1000")
define("site_links", ("ranked",), "select a.rank as a, b.rank as b from ranked a join ranked b on a.rank <> b.rank and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 225 + 1e-9")
define("site_reach", ("ranked", "site_links"), "select rank as node, rank as seen from ranked union select s.node, l.b from site_reach s join site_links l on l.a = s.seen")
define("roles", ("ranked", "site_reach"), "select k.rank, site_id, dense_rank() over (order by root) as site_no, case when k.rank = root then 'PRIMARY' else 'ALTERNATE' end as role, first_value(site_id) over (partition by root order by k.rank) as primary_id, count(*) over (partition by root) - 1 as alternates from ranked k join (select node, min(seen) as root from site_reach group by node) g on g.node = k.rank")
define("point_links", ("points",), "select a.id as a, b.id as b from points a join points b on a.id <> b.id and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 196 + 1e-9")
define("point_reach", ("points", "point_links"), "select id as node, id as seen from points union select s.node, l.b from point_reach s join point_links l on l.a = s.seen")
define("ordered_points", ("points",), "select id, x, y, row_number() over (order by -score, id) as n from points")
define(
    "spaced",
    ("ordered_points",),
    """select 0::bigint as n, []::bigint[] as ids, []::double[] as xs, []::double[] as ys
  union all
  select s.n + 1, case when clash then ids else list_append(ids, p.id) end, case when clash then xs else list_append(xs, p.x) end, case when clash then ys else list_append(ys, p.y) end
  from (select s.*, p.id as pid, p.x as px, p.y as py, len(list_filter(range(len(xs)), lambda i: (xs[i+1]-p.x)*(xs[i+1]-p.x) + (ys[i+1]-p.y)*(ys[i+1]-p.y) < 900 - 1e-9)) > 0 as clash from spaced s join ordered_points p on p.n = s.n + 1) s join ordered_points p on p.n = s.n + 1""",
)
define("runs", ("sectors",), "select *, min(lo) over (partition by r, c) = 0 and max(hi) over (partition by r, c) = 35 and count(*) over (partition by r, c) > 1 as wraps from (select r, c, min(i) as lo, max(i) as hi, count(*) as n from (select *, i - row_number() over (partition by r, c order by i) as run from (select r, c, cast(round(azimuth / 10) as int) as i from sectors where class = 'CLEAR') a) b group by r, c, run) d")

define("cell_links", ("classes",), "select p.r * 2147483648 + p.c as a, q.r * 2147483648 + q.c as b from classes p join classes q on q.r between p.r - 1 and p.r + 1 and q.c between p.c - 1 and p.c + 1 and (q.r <> p.r or q.c <> p.c) where p.ground in (1, 2) and q.ground in (1, 2)")
define(
    "walked",
    ("checked",),
    """select 0::bigint as n, []::bigint[] as picked, []::bigint[] as rs, []::bigint[] as cs, []::double[] as reach
  union all
  select n, case when seen and passes then list_append(picked, n) else picked end, case when seen then list_append(rs, r) else rs end, case when seen then list_append(cs, c) else cs end, case when seen then list_append(reach, case when passes then (6 - 1e-6) * (6 - 1e-6) + 1e-9 else 1 + 1e-9 end) else reach end
  from (select p.n, w.picked, w.rs, w.cs, w.reach, p.r, p.c, p.passes, len(list_filter(range(len(w.rs)), lambda i: (w.rs[i+1]-p.r)*(w.rs[i+1]-p.r) + (w.cs[i+1]-p.c)*(w.cs[i+1]-p.c) <= w.reach[i+1])) = 0 as seen
    from walked w join (select r, c, passes, row_number() over (order by -quality, r, c) as n from checked) p on p.n = w.n + 1) s""",
)
define("selected", ("checked", "walked", "cells"), f"select {_ATTRIBUTES} from (select *, row_number() over (order by -quality, r, c) as n from checked) a join (select unnest(picked) as n from (select picked from walked order by n desc limit 1) w) k using (n) join (select r, c, x, y, z from cells) b using (r, c) order by n limit 1000")
# the chain from sites to ranks once more, for the selection over the whole grid
for _name in ("rays", "sector_rays", "sectors", "best", "summary", "scored", "rated", "ranked"):
    copy_of(_name, {"chosen": "selected"} | {k: f"{k}_all" for k in ("rays", "sector_rays", "sectors", "best", "summary", "scored", "rated", "ranked")})

ORACLES = {
    "candidate_selection": sql("select r, c, elevation, slope, quality from selected", "selected"),
    "component_sizes": sql(
        """select count(*) as cells, cast(root // 2147483648 as bigint) as r, cast(root % 2147483648 as bigint) as c from (
  with recursive found(node, root) using key (node) as (select r * 2147483648 + c, r * 2147483648 + c from classes where ground in (1, 2)
    union (select k.node, min(v.root) from recurring.found k join cell_links l on l.a = k.node join found v on v.node = l.b where v.root < k.root group by k.node)) select * from found) t group by root""",
        "classes", "cell_links",
    ),
    "site_screening": sql("select cast(rank as int) as rank, site_id, r, c, rating, score, limiting, assessed, clear, best_azimuth, best_angle, heading from ranked_all", "ranked_all"),
    "quality_surface": sql("select r, c, round(edge, 4) as edge, round(quality, 4) as quality from quality_cells", "quality_cells"),
    "edge_distance": sql("select round(edge, 4) as edge, count(*) as cells from quality_cells where edge < 1 group by 1", "quality_cells"),
    "exact_pass": sql("select passes, count(*) as cells from checked group by passes", "checked"),
    "topk_candidates": sql("select r, c, round(quality, 4) as quality from checked where passes order by checked.quality desc, r, c limit 25", "checked"),
    "topk_per_tile": sql("select r, c, elevation, slope, aspect, roughness, ring_obstacle, upslope, quality from chosen", "chosen"),
    "ray_worst": sql("select r, c, cast(ray as int) as ray, round(worst, 3) as worst, distance, round(coverage, 4) as coverage from rays", "rays"),
    "sector_class": sql("select r, c, azimuth, round(worst, 3) as worst, round(coverage, 3) as coverage, class from sectors", "sectors"),
    "sector_letters": sql("select r, c, string_agg(class[1:1], '' order by azimuth) as letters from sectors group by r, c", "sectors"),
    "sector_listed_obstacle": sql(f"select r, c, azimuth, round(worst, 3) as worst, {_KIND} as class, coalesce(obstacle, -1) as obstacle from (select s.r, s.c, s.azimuth, s.coverage, case when listed is not null and (s.worst is null or listed > s.worst) then listed else s.worst end as worst, case when listed is not null and (s.worst is null or listed > s.worst) or listed >= s.worst - 0.5 then owner end as obstacle from sectors s left join listed_sectors l using (r, c, azimuth)) t", "sectors", "listed_sectors"),
    "best_approach": sql("select r, c, total, assessed, clear, best_azimuth, best_angle, heading from summary", "summary"),
    "opposing_corridors": sql("select r, c, opposing from summary", "summary"),
    "sector_ranges": sql("select r, c, (lo * 10.0::double - 5 + 360) % 360 as first, (hi * 10.0::double + 5) % 360 as last, cast(n as bigint) as sectors from (select r, c, hi, case when wraps and lo = 0 then (select max(t.lo) from runs t where t.r = a.r and t.c = a.c) else lo end as lo, n + case when wraps and lo = 0 then (select t.n from runs t where t.r = a.r and t.c = a.c and t.hi = 35) else 0 end as n from runs a where not (wraps and hi = 35)) q", "runs"),
    "wind_helper": sql("select r, c, azimuth, off, round(12 * cos(radians(off)), 4) as headwind, round(12 * sin(radians(off)), 4) as crosswind from (select *, row_number() over (partition by r, c order by case when class = 'CLEAR' then 0 else 1 end, off, azimuth) as n from (select *, abs(((((azimuth + 180) % 360 - 247.0::double + 180) % 360) + 360) % 360 - 180) as off from sectors where class in ('CLEAR', 'MARGINAL')) a) b where n = 1", "sectors"),
    "score_components": sql("select r, c, round(slope_part, 4) as slope_part, round(roughness_part, 4) as roughness_part, round(approach_part, 4) as approach_part, round(obstacle_part, 4) as obstacle_part, score from scored", "scored"),
    "score_rating": sql("select r, c, rating, gate, notes from rated", "rated"),
    "limiting_factor": sql("select limiting, count(*) as sites from rated group by limiting", "rated"),
    "rank_ids": sql("select r, c, rank, site_id from ranked", "ranked"),
    "rating_counts": sql("select l.rating, count(k.rating) as sites from (values ('Highly Suitable'), ('Suitable'), ('Marginal'), ('Unassessed'), ('Unsuitable')) l(rating) left join rated k using (rating) group by l.rating", "rated"),
    "rating_cube": sql("select rating, limiting, count(*) as sites from rated group by cube (rating, limiting)", "rated"),
    "rating_rollup": sql("select rating, upslope, count(*) as sites from rated group by rollup (rating, upslope)", "rated"),
    "rating_pivot": sql("select limiting, count(case when rating = 'Highly Suitable' then 1 end) as highly_suitable, count(case when rating = 'Suitable' then 1 end) as suitable, count(case when rating = 'Marginal' then 1 end) as marginal, count(case when rating = 'Unassessed' then 1 end) as unassessed, count(case when rating = 'Unsuitable' then 1 end) as unsuitable from rated group by limiting", "rated"),
    "density_altitude": sql("select r, c, case when alt between 25 and 32.5 and oat between -70 and 60 then round(pa + 120 * (oat - (15 - 1.98 * pa / 1000)), 3) end as density_altitude_ft from (select *, z / 0.3048 + (29.92 - alt) * 1000 as pa from (select r, c, z, 29.5 + c / 40.0 as alt, r % 70 - 5.0 as oat from cells where z is not null) a) b", "cells"),
    "min_spacing": sql("select unnest(ids) as id from (select ids from spaced order by n desc limit 1) t", "spaced"),
    "seam_pairs": sql("select a.id, b.id as other, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 4) as distance from points a join points b on a.id < b.id and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < 144 - 1e-9", "points"),
    "site_groups": sql("select node as id, min(seen) as root from point_reach group by node", "point_reach"),
    "site_roles": sql("select rank, site_id, site_no, role, primary_id, alternates from roles", "roles"),
    "spacing_summary": sql("select count(distinct site_no) as sites, count(distinct case when rank <= 10 then site_no end) as sites_top10, count(*) as candidates from roles", "roles"),
}
