"""The whole run with exclusions and listed obstacles, coordinate systems of headers, and wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.functions import crs, wording
from gridsift.functions import geodesy as g
from gridsift.operators import approach, candidates, classify, scoring, spatial
from gridsift.operators.storage import Store
from gridsift.plans import geodetic  # noqa: F401  (defines what the extents are checked with)
from gridsift.plans.ground import _SUMMARY, AIRCRAFT, MISSION, cells, classes
from gridsift.plans.masks import height, removed
from gridsift.plans.oracle import copy_of, define, sql
from gridsift.plans.sites import _KIND, DOCTRINE, listed, ranked
from gridsift.sources import obstacles
from gridsift.sources.bindings import bind


def full_run(s, d):
    """Selection without excluded cells, sectors with listed obstacles, scores, ranks, groups and roles."""
    grid, store = cells(s, d), Store(s, "full-run")
    sites = store.put("sites", candidates.select_apart(candidates.checked(grid, removed(s, d), AIRCRAFT, MISSION), grid, AIRCRAFT, MISSION))
    rays = approach.ray_worst(sites, grid, height(s, d), AIRCRAFT, MISSION)
    sectors = store.put("sectors", approach.sectors(rays, AIRCRAFT, MISSION, listed(s, d, sites)))
    rated = scoring.rate(scoring.components(approach.summarize(sites, sectors, MISSION), AIRCRAFT, MISSION), AIRCRAFT, DOCTRINE)
    best = store.put("ranked", scoring.rank(rated, MISSION.max_candidates).withColumn("rank", F.col("rank").cast("long")))
    roles = scoring.roles(spatial.groups(best.select("rank", "site_id", "x", "y"), 15.0, key="rank"))
    return best.join(roles.select("rank", F.col("site_no").cast("long").alias("site_no"), "role"), "rank").select("rank", "site_id", "site_no", "role", "r", "c", "rating", "score", "limiting", "best_azimuth", "best_angle")




def boxes(s, d):
    return bind(s, d, "positions").select("id", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 0.75).alias("east"), (F.col("lat") + 0.5).alias("north"), F.expr(g.zone("lat", "lon")).alias("zone"))


QUERIES = {
    "full_run": full_run,
    "extent_in_utm": lambda s, d: crs.extents_in_utm(boxes(s, d)).select("id", *(F.round(x, 2).alias(x) for x in ("x_min", "y_min", "x_max", "y_max"))),
    "site_summary": lambda s, d: ranked(s, d).select(F.col("rank").cast("long").alias("rank"), wording.site_summary(AIRCRAFT).alias("text")),
    "rejection_lines": lambda s, d: wording.rejection_lines(classify.rejection_summary(classes(s, d))),
}

# the chain of the screening over classes without removed cells, and with listed obstacles in the sectors
define("classes_left", ("classes", "removed"), "select k.* exclude (reason, ground), m.reason, m.ground from classes k join removed m using (r, c)")
_NAMES = {"classes": "classes_left", "chosen": "selected_full", "sectors": "sectors_full"} | {k: f"{k}_full" for k in ("fails", "quality_cells", "checked", "walked", "selected", "rays", "sector_rays", "listed_sectors", "best", "summary", "scored", "rated", "ranked", "site_links", "site_reach", "roles")}
for _name in ("fails", "quality_cells", "checked", "walked", "selected", "rays", "sector_rays", "listed_sectors", "best", "summary", "scored", "rated", "ranked", "site_links", "site_reach", "roles"):
    copy_of(_name, _NAMES)
copy_of("sectors", _NAMES | {"sectors": "swept_full"})
define(
    "sectors_full",
    ("swept_full", "listed_sectors_full"),
    f"select r, c, azimuth, coverage, worst, {_KIND} as class from (select s.r, s.c, s.azimuth, s.coverage, case when listed is not null and (s.worst is null or listed > s.worst) then listed else s.worst end as worst from swept_full s left join listed_sectors_full l using (r, c, azimuth)) t",
)
define("box_edges", ("zoned",), "select id, lat + v * 0.5 as lat, lon + u * 0.75 as lon, zone, '' as band from zoned p cross join (select i / 8.0::double as t from range(9) a(i)) s cross join lateral (values (t, 0.0::double), (t, 1.0::double), (0.0::double, t), (1.0::double, t)) e(u, v)")
copy_of("projected", {"projected": "box_points", "zoned": "box_edges"})
ORACLES = {
    "full_run": sql("select rank, site_id, site_no, role, r, c, rating, score, limiting, best_azimuth, best_angle from ranked_full join (select rank, site_no, role from roles_full) k using (rank)", "ranked_full", "roles_full"),
    "extent_in_utm": sql("select id, round(min(east), 2) as x_min, round(min(y), 2) as y_min, round(max(east), 2) as x_max, round(max(y), 2) as y_max from (select id, east, north - case when lat < 0 then 10000000 else 0 end as y from box_points) b group by id", "box_points"),
    "site_summary": sql(
        """select rank, case when upslope then printf('Steep ground (%.1f deg), for landing uphill only', round(slope, 1)) else case when slope < 1 then 'Level' when slope < 3 then 'Gently sloping' else 'Sloping' end || printf(' ground (%.1f deg)', round(slope, 1)) end
      || ', ' || case when roughness < 0.05 then 'smooth' when roughness < 0.15 then 'fairly smooth' else printf('uneven by %.2f m', round(roughness, 2)) end || '; ' || clear || ' of ' || assessed || ' approaches open, '
      || case when best_azimuth is null then 'none usable' else 'best from ' || (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[1 + cast(floor(best_azimuth / 45 + 0.5) as int) % 8] || printf(' %03d', cast(best_azimuth as int) % 360) end || '. ' || rating || printf(', score %.1f', score) as text from ranked""",
        "ranked",
    ),
    "rejection_lines": sql(f"select reason, printf('%6.2f', percent) || '%  ' || format('{{:,}}', cells) || '  ' || label as line from ({_SUMMARY}) s where cells > 0", "classes"),
}
