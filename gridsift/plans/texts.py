"""Queries of parsers, headers, profiles and plans, over texts and rows that are written from the tables' values."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridsift.functions import crs, text
from gridsift.operators import audit, masks, overview, planning
from gridsift.plans import survey  # noqa: F401  (defines outlines)
from gridsift.plans.ground import noise
from gridsift.plans.masks import height
from gridsift.plans.oracle import define, sql
from gridsift.sources import obstacles, profiles
from gridsift.sources.bindings import SQL, TABLES, bind

# The same SQL in both engines writes the texts; what must come back is worked out from the numbers.
_DMS = "lpad(cast(cast(floor({v}) as int) as string), {n}, '0') || ' ' || lpad(cast(cast(floor({v} * 60) as int) % 60 as string), 2, '0') || ' ' || lpad(cast(cast(round({v} * 3600) as int) % 60 as string), 2, '0') || '.00'"
SQL["quarters"] = """select s_suppkey as id, cast(s_suppkey % 80 as double) + cast(1 + s_suppkey % 3 as double) / 4 as lat, cast((s_suppkey * 7) % 170 as double) + cast(1 + s_suppkey % 2 as double) / 2 as lon,
  s_suppkey % 2 = 0 as south, s_suppkey % 5 < 3 as west, (s_suppkey * 13) % 700 as feet, s_suppkey % 7 as kind from supplier"""
SQL["written_heights"] = """select id, feet_field, case form when 0 then n || ' ft' when 1 then n when 2 then n || ' m' when 3 then n || ',5 m' when 4 then 'tall' when 5 then '' when 6 then '-' || n when 7 then n || '''' when 8 then '  ' || n || '.25 feet' else null end as txt
from (select s_suppkey as id, s_suppkey % 3 = 0 as feet_field, cast(s_suppkey as string) as n, s_suppkey % 10 as form from supplier) a"""
SQL["written_positions"] = f"""select id, case kind when 0 then a || ', ' || o when 1 then b || ' ' || ns || ' ' || p || ' ' || ew when 2 then ns || b || ' ' || ew || p when 3 then p || ' ' || ew || ', ' || b || ' ' || ns
  when 4 then b || '°' || ns || ' ' || p || '°' || ew when 5 then '95' || b || ', ' || o else 'somewhere near ' || b end as txt
from (select id, kind, case when south then 'S' else 'N' end as ns, case when west then 'W' else 'E' end as ew, cast(cast(lat as decimal(6, 2)) as string) as b, cast(cast(lon as decimal(6, 2)) as string) as p,
  cast(cast(case when south then -lat else lat end as decimal(6, 2)) as string) as a, cast(cast(case when west then -lon else lon end as decimal(6, 2)) as string) as o from ({SQL["quarters"]}) q) r"""
SQL["written_records"] = f"""select case when kind = 5 then 'a heading of page ' || cast(id as string) else '01-' || lpad(cast(id as string), 6, '0') || ' O US CA SOMEWHERE ' || {_DMS.format(v="lat", n=2)} || case when south then 'S ' else 'N ' end || {_DMS.format(v="lon", n=3)} || case when west then 'W ' else 'E ' end
  || case when kind < 3 then 'TOWER' else 'WIND TURBINE' end || '      1 ' || lpad(cast(case when kind = 1 then 0 else feet end as string), 5, '0') || ' 00900 R N ' || case when kind = 4 then 'D' else 'A' end || ' 2020123' end as line from ({SQL["quarters"]}) q"""
SQL["written_table"] = f"""select 'mast ' || cast(id as string) as {{name}}, case when kind = 5 then 'unknown' else cast(cast(case when south then -lat else lat end as decimal(6, 2)) as string) end as {{lat}},
  cast(cast(case when west then -lon else lon end as decimal(6, 2)) as string) as {{lon}}, case when kind = 1 then '' when kind = 2 then cast(feet as string) || ' m' else cast(feet as string) end as {{tall}} from ({SQL["quarters"]}) q""".format(name="Obstacle_Name", lat="LAT_DD", lon="Longitude", tall="Struct_HT")
SQL["written_systems"] = """select id, case kind when 0 then 'PROJCS["WGS 84 / UTM zone ' || zone || side || '",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",0.0174532925199433]],UNIT["metre",1],AUTHORITY["EPSG","' || code || '"]]'
  when 1 then 'PROJCS["WGS_1984_UTM_Zone_' || zone || side || '",GEOGCS["GCS_WGS_1984",UNIT["Degree",0.0174532925199433]],UNIT["Meter",1.0]]' when 2 then 'GEOGCS["WGS 84",DATUM["WGS_1984"],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'
  when 3 then 'COMPD_CS["both",PROJCS["Grid ' || zone || '",UNIT["Foot_US",0.3048006]],VERT_CS["Level ' || side || '",VERT_DATUM["V",2005],UNIT["metre",1],AUTHORITY["EPSG","6647"]]]' else '' end as wkt
from (select n_nationkey as id, n_nationkey % 5 as kind, cast(1 + (n_nationkey * 7) % 15 as string) as zone, case when n_nationkey % 2 = 0 then 'N' else 'S' end as side, cast(case when n_nationkey % 2 = 0 then 32600 else 32700 end + 1 + (n_nationkey * 7) % 15 as string) as code from nation) a"""
SQL["datasets"] = """select case n_nationkey % 5 when 0 then 'ground' when 1 then 'surface' when 2 then 'aoi' when 3 then 'exclusions' else 'obstacles' end as folder_key, case when n_nationkey % 5 < 2 or n_nationkey % 11 = 0 then 'raster' else 'vector' end as kind,
  case when n_nationkey % 5 < 2 then null when n_nationkey % 3 = 0 then 'point' when n_nationkey % 3 = 1 then 'polygon' else 'line' end as geometry, lower(n_name) || case when n_nationkey % 4 = 0 then '_dsm' when n_nationkey % 4 = 1 then '_ground' else '' end || '.tif' as path,
  case n_nationkey % 4 when 0 then 32618 when 1 then 4326 when 2 then 3857 else null end as epsg, case when n_nationkey % 6 = 0 then 'foot' else 'metre' end as unit, cast(1 + n_nationkey % 4 as double) * 0.75 as cell_w, cast(1 + n_nationkey % 4 as double) * 0.75 + case when n_nationkey % 7 = 0 then 0.5 else 0 end as cell_h,
  case when n_nationkey % 10 = 5 then 3 else 1 end as bands, cast((n_nationkey * 37) % 500 as double) as x_min, cast(0 as double) as y_min, cast((n_nationkey * 37) % 500 + 800 as double) as x_max, cast(1000 as double) as y_max, case when n_nationkey % 3 = 0 then null else cast(-9999 as double) end as nodata,
  cast(50 - 600 * (n_nationkey % 8) / 7 as double) as low, cast(300 + n_nationkey as double) as high, cast(120 + n_nationkey % 3 as double) as mean, case when n_nationkey % 5 < 2 then null else n_nationkey % 4 end as features from nation"""
TABLES |= {n: ["supplier"] for n in ("quarters", "written_heights", "written_positions", "written_records", "written_table")} | {n: ["nation"] for n in ("written_systems", "datasets")}
for _name in TABLES:
    if _name in ("quarters", "written_heights", "written_positions", "written_records", "written_table", "written_systems", "datasets"):
        define(_name, (), SQL[_name])


def documents(s, d):
    """One GeoJSON collection with a feature for each nation: points, lines, and areas with a hole, with heights of several kinds."""
    own = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.col("n_nationkey").cast("string").alias("k"))
    corner = lambda a, b: F.concat(F.lit("["), (F.col("n_nationkey") + a).cast("string"), F.lit(","), (F.col("n_nationkey") * 2 + b).cast("string"), F.lit("]"))
    listed = lambda *points: F.concat(F.lit("["), F.concat_ws(",", *points), F.lit("]"))
    ring = lambda a: listed(corner(a, a), corner(9 - a, a), corner(9 - a, 9 - a), corner(a, a))
    kind = F.col("n_nationkey") % 3
    geometry = F.when(kind == 0, F.concat(F.lit('"Point","coordinates":'), corner(0, 0))).when(kind == 1, F.concat(F.lit('"LineString","coordinates":'), listed(corner(0, 0), corner(1, 3)))).otherwise(F.concat(F.lit('"Polygon","coordinates":'), listed(ring(0), ring(2))))
    property_ = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit('"height":"'), "k", F.lit(' m"'))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit('"agl_ft":'), "k")).when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit('"building:levels":"'), "k", F.lit('"'))).otherwise(F.lit('"name":"x"'))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":'), geometry, F.lit('},"properties":{'), property_, F.lit("}}"))
    rows = own.select("n_nationkey", feature.alias("f")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "f"))).alias("all"))  # nations: one file
    return rows.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("all", lambda x: x["f"]), ","), F.lit("]}")).alias("json"))


def vertices(s, d):
    return obstacles.from_geojson(documents(s, d))


def aircraft(s, d):
    """A variant of the default aircraft for each part."""
    base = profiles.as_table(s, replace(profiles.Aircraft(), name="variant"))
    parts = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    odd = lambda k: F.col("p_partkey") % 4 == k
    out = parts.crossJoin(F.broadcast(base)).withColumn("name", F.concat(F.lit("part "), F.col("p_partkey").cast("string")))  # one row
    out = out.withColumn("max_upslope_landing_deg", F.when(odd(0), F.col("size")).otherwise(F.col("max_upslope_landing_deg"))).withColumn("ring_obstacle_height_m", F.when(odd(1), F.col("size") / 50).otherwise(F.col("ring_obstacle_height_m")))
    return out.withColumn("approach_range_m", F.when(odd(2), F.col("size")).otherwise(F.col("approach_range_m"))).withColumn("tdp_diameter_m", F.when(odd(3), F.col("size") - 10).otherwise(F.col("tdp_diameter_m")))


def what_if(s, d):
    sizes = s.read.parquet(f"{d}/region.parquet").select((F.col("r_regionkey") * 60.0 + 2).alias("diameter"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey") * 70.0).alias("ring"))
    return profiles.what_if(aircraft(s, d).filter("p_partkey % 50 = 0"), sizes).select("name", "tdp_diameter_m", "cleared_ring_m")


def catalog(s, d):
    rows = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_partkey") % 13 > 0, F.col("p_size") * 400.0 - 400).alias("mtow_kg"), (F.col("p_size") * 1.0).alias("rotor_m"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 1.6).alias("diameter"))
    limits = s.createDataFrame([("light", 25.0), ("medium", 50.0), ("heavy", 80.0)], "weight_class string, class_diameter double")
    return profiles.from_catalog(rows, limits)


def systems(s, d):
    return bind(s, d, "written_systems").select("id", crs.from_wkt(F.col("wkt")).alias("s"))


def agreement(s, d):
    own = systems(s, d)
    pairs = own.join(own.select(F.col("id").alias("other"), F.col("s").alias("t")), F.expr("id < other"))  # the systems of a folder's files
    return pairs.select("id", "other", crs.same(F.col("s"), F.col("t")).alias("same"), crs.compatible(F.col("s"), F.col("t")).alias("compatible")).filter("compatible")


def planned(s, d):
    return planning.tiles(s, height(s, d), 97, 40)


def audited(s, d):
    return audit.findings(bind(s, d, "datasets"))


QUERIES = {
    "hash_noise": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id")).select("id", *noise()),
    "densify_line": lambda s, d: masks.densify(masks.closed(bind(s, d, "features").filter("kind != 'point'")), 5.0).select("fid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")),
    "parse_height": lambda s, d: bind(s, d, "written_heights").select("id", F.round(text.parse_height(F.col("txt"), F.col("feet_field")), 4).alias("height_m")),
    "parse_position": lambda s, d: bind(s, d, "written_positions").select("id", text.parse_position(F.col("txt")).alias("p")).select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), "p.kind"),
    "read_dof": lambda s, d: obstacles.from_records(bind(s, d, "written_records")).select("name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("height_m", 4).alias("height_m"), "assumed"),
    "read_csv_obstacles": lambda s, d: obstacles.from_table(bind(s, d, "written_table"), feet=True).select("name", "lon", "lat", F.round("height_m", 4).alias("height_m"), "assumed"),
    "read_geojson_obstacles": lambda s, d: vertices(s, d).select(F.col("fid").cast("long").alias("fid"), "kind", F.col("part").cast("long").alias("part"), F.col("i").cast("long").alias("i"), "lon", "lat", F.round("height_m", 4).alias("height_m"), "assumed"),
    "geojson_exclusions": lambda s, d: obstacles.exclusions(vertices(s, d))[0].select(F.col("fid").cast("long").alias("fid"), F.col("ring").cast("long").alias("ring"), "i", "x", "y"),
    "geojson_lines": lambda s, d: obstacles.exclusions(vertices(s, d))[1].select(F.col("fid").cast("long").alias("fid"), F.col("part").cast("long").alias("part"), "i", "x", "y"),
    "crs_from_wkt": lambda s, d: systems(s, d).select("id", "s.kind", "s.name", "s.epsg", "s.unit", "s.utm", "s.vertical", "s.web_mercator"),
    "crs_agreement": agreement,
    "overview_lattice": lambda s, d: overview.lattice(s, height(s, d), 97, 40),
    "plan_tiles": planned,
    "resume_antijoin": lambda s, d: planning.unfinished(planned(s, d), planned(s, d).filter("index % 3 = 0")),
    "input_selection": lambda s, d: audit.select_inputs(bind(s, d, "datasets")),
    "audit_findings": audited,
    "audit_status": lambda s, d: audit.status(audited(s, d)),
    "profile_validation": lambda s, d: profiles.validate(aircraft(s, d), profiles.AIRCRAFT_RULES).select("name", "valid", F.array_join("problems", "; ").alias("problems")),
    "profile_what_if": what_if,
    "catalog_weight_class": catalog,
}

_TILES = """select i * n_c + j + 1 as index, cast(round_even(h * i / cast(n_r as double), 0) as bigint) as r0, cast(round_even(h * (i + 1) / cast(n_r as double), 0) as bigint) as r1, cast(round_even(97 * j / cast(n_c as double), 0) as bigint) as c0, cast(round_even(97 * (j + 1) / cast(n_c as double), 0) as bigint) as c1
  from (select *, unnest(range(n_c)) as j from (select *, unnest(range(n_r)) as i from (select h, (h + 39) // 40 as n_r, 3 as n_c from grid_h) a) b) c"""
_SIGNED = "case when south then -lat else lat end as lat, case when west then -lon else lon end as lon"
define("nation_heights", (), "select n_nationkey as k, n_nationkey % 3 as kind, n_nationkey % 4 as said, case when n_nationkey > 0 then case n_nationkey % 4 when 0 then n_nationkey when 1 then n_nationkey * 0.3048 when 2 then n_nationkey * 3 end end as tall from nation")
define(
    "nation_vertices",
    ("nation_heights",),
    """select k as fid, case kind when 0 then 'Point' when 1 then 'LineString' else 'Polygon' end as kind, part, i, cast(k + a as double) as lon, cast(2 * k + b as double) as lat, cast(coalesce(tall, 30) as double) as height_m, tall is null as assumed from nation_heights join (values
    (0, 0, 0, 0, 0), (1, 0, 0, 0, 0), (1, 0, 1, 1, 3), (2, 0, 0, 0, 0), (2, 0, 1, 9, 0), (2, 0, 2, 9, 9), (2, 0, 3, 0, 0), (2, 1, 0, 2, 2), (2, 1, 1, 7, 2), (2, 1, 2, 7, 7), (2, 1, 3, 2, 2)) v(of, part, i, a, b) on of = nation_heights.kind""",
)
_RULES = (
    ("raster", "F", "more than one band", "kind = 'raster' and not bands = 1"),
    ("raster", "W", "unknown coordinate system", "kind = 'raster' and coalesce(epsg, 0) = 0"),
    ("raster", "W", "geographic coordinates", "kind = 'raster' and coalesce(epsg, 0) = 4326"),
    ("raster", "F", "web mercator ground", "kind || folder_key || epsg = 'rasterground3857'"),
    ("raster", "W", "web mercator surface", "kind || folder_key || epsg = 'rastersurface3857'"),
    ("raster", "F", "unit is not the metre", "kind || folder_key = 'rasterground' and epsg in (32618, 3857) and unit = 'foot'"),
    ("raster", "F", "cells are not square", "kind = 'raster' and abs(cell_h / cell_w - 1) > 0.01"),
    ("raster", "W", "coarse cells", "kind = 'raster' and epsg in (32618, 3857) and cell_w > 2.5"),
    ("raster", "I", "cells above 1 m", "kind = 'raster' and epsg in (32618, 3857) and cell_w between 1.0001 and 2.5"),
    ("raster", "W", "no value for missing data", "kind = 'raster' and nodata is not distinct from null"),
    ("raster", "W", "heights out of the plausible range", "kind = 'raster' and not (low >= -500 and high <= 9000)"),
    ("ground", "W", "named like a surface model", "folder_key = 'ground' and regexp_matches(path, 'dsm|surface')"),
    ("surface", "W", "named like a ground model", "folder_key = 'surface' and regexp_matches(path, 'dtm|ground')"),
    ("vectors", "W", "no features", "kind <> 'raster' and features = 0"),
    ("vectors", "W", "unknown coordinate system", "kind <> 'raster' and coalesce(epsg, 0) = 0"),
    ("vectors", "W", "not polygons", "kind <> 'raster' and folder_key = 'aoi' and geometry in ('point', 'line')"),
    ("vectors", "I", "points among exclusions", "kind <> 'raster' and folder_key || geometry = 'exclusionspoint'"),
    ("misc", "W", "vector data in an elevation folder", "kind <> 'raster' and folder_key in ('ground', 'surface')"),
    ("misc", "W", "raster in a vector folder", "kind = 'raster' and not folder_key in ('ground', 'surface')"),
)
_SINGLE = " union all ".join(f"select '{area}' as area, '{level}' as level, path, '{message}' as message from datasets where {condition}" for area, level, message, condition in _RULES)
_PAIRS = " union all ".join(
    f"select 'pair', '{level}', g.path, '{message}' from (select g.path, g.epsg as ge, s.epsg as se, g.cell_w as gw, s.cell_w as sw, g.mean as gm, s.mean as sm, g.high as gh, s.high as sh, s.path as sp, greatest(0, least(g.x_max, s.x_max) - greatest(g.x_min, s.x_min)) * greatest(0, least(g.y_max, s.y_max) - greatest(g.y_min, s.y_min)) / ((g.x_max - g.x_min) * (g.y_max - g.y_min)) as share from datasets g cross join datasets s where g.folder_key = 'ground' and g.kind = 'raster' and s.folder_key = 'surface' and s.kind = 'raster') g where {condition}"
    for level, condition, message in (("F", "path = sp", "same file twice"), ("I", "ge is distinct from se", "coordinate systems differ"), ("I", "gw <> sw", "cell sizes differ"), ("F", "share = 0", "no overlap"), ("W", "share > 0 and share < 0.95", "partial overlap"), ("W", "sm < gm - 0.5", "surface below ground"), ("W", "abs(sm - gm) <= 0.01 and abs(sh - gh) <= 0.01", "surface equals ground"), ("P", "share >= 0.95 and sm >= gm - 0.5", "ground and surface fit"))
)
_MISSING = " union all ".join(f"select '{key}', '{level}', null, '{message}' from (select count(*) as n from datasets where folder_key = '{key}' and kind = 'raster') t where {condition}" for key, condition, level, message in (("ground", "n = 0", "F", "no ground model"), ("ground", "n > 1", "F", "several ground models"), ("surface", "n = 0", "W", "no surface model"), ("surface", "n > 1", "W", "several surface models")))
define("found", ("datasets",), f"{_SINGLE} union all {_PAIRS} union all {_MISSING}")
ORACLES = {
    "audit_findings": sql("select area, level, path, message from found", "found"),
    "audit_status": sql("select n_f, n_w, n_i, n_p, case when n_f > 0 then 'NOT_READY' when n_w > 0 then 'READY_WITH_WARNINGS' else 'READY' end as status from (select count(case level when 'F' then 1 end) as n_f, count(case level when 'W' then 1 end) as n_w, count(case level when 'I' then 1 end) as n_i, count(case level when 'P' then 1 end) as n_p from found) c", "found"),
    "hash_noise": "select o_orderkey as id, xor(o_orderkey * 73856093, (o_orderkey * 19349663) >> 3) % 1000003 as mixed, round((xor(o_orderkey * 73856093, (o_orderkey * 19349663) >> 3) % 1000003) / 1000003.0, 4) as noise from orders",
    "densify_line": sql("select fid, round(x, 4) as x, round(y, 4) as y from outlines where step = 5", "outlines"),
    "parse_height": """select s_suppkey as id, round(case s_suppkey % 10 when 0 then nullif(s_suppkey, 0) * 0.3048 when 1 then s_suppkey * case when s_suppkey % 3 = 0 then 0.3048 else 1 end when 2 then s_suppkey when 3 then s_suppkey + 0.5 when 7 then s_suppkey * 0.3048 when 8 then (s_suppkey + 0.25) * 0.3048 end, 4)::double as height_m from supplier""",
    "parse_position": sql(f"select id, case when kind < 5 then round(lat, 6) end as lat, case when kind < 5 then round(lon, 6) end as lon, case when kind < 5 then 'LATLON' end as kind from (select id, kind, {_SIGNED} from quarters) q", "quarters"),
    "read_dof": sql(f"select case when kind < 3 then 'TOWER' else 'WIND TURBINE' end || ' 01-' || lpad(cast(id as varchar), 6, '0') as name, round(lon, 6) as lon, round(lat, 6) as lat, round(case when kind = 1 or feet = 0 then 30 else feet * 0.3048 end, 4)::double as height_m, kind = 1 or feet = 0 as assumed from (select id, kind, feet, {_SIGNED} from quarters) q where kind not in (4, 5)", "quarters"),
    "read_csv_obstacles": sql(f"select 'mast ' || cast(id as varchar) as name, lon, lat, round(case when kind = 1 or feet = 0 then 30 when kind = 2 then feet else feet * 0.3048 end, 4)::double as height_m, kind = 1 or feet = 0 as assumed from (select id, kind, feet, {_SIGNED} from quarters) q where kind <> 5", "quarters"),
    "read_geojson_obstacles": sql("select cast(fid as bigint) as fid, kind, cast(part as bigint) as part, cast(i as bigint) as i, lon, lat, round(height_m, 4) as height_m, assumed from nation_vertices", "nation_vertices"),
    "geojson_exclusions": sql("select cast(fid as bigint) as fid, cast(part as bigint) as ring, cast(i as bigint) as i, lon as x, lat as y from nation_vertices where kind = 'Polygon' and i < 3", "nation_vertices"),
    "geojson_lines": sql("select cast(fid as bigint) as fid, cast(part as bigint) as part, cast(i as bigint) as i, lon as x, lat as y from nation_vertices where kind = 'LineString'", "nation_vertices"),
    "crs_from_wkt": """select n_nationkey as id, case kind when 2 then 'geographic' when 4 then null else 'projected' end as kind, case kind when 0 then 'WGS 84 / UTM zone ' || z || side when 1 then 'WGS 1984 UTM Zone ' || z || side when 2 then 'WGS 84' when 3 then 'Grid ' || z end as name,
      cast(case kind when 0 then case when side = 'N' then 32600 else 32700 end + z when 2 then 4326 end as int) as epsg, case kind when 0 then 'metre' when 1 then 'meter' when 2 then 'degree' when 3 then 'foot_us' end as unit, case when kind < 2 then z || side end as utm, case when kind = 3 then 'Level ' || side end as vertical, false as web_mercator
      from (select n_nationkey, n_nationkey % 5 as kind, 1 + (n_nationkey * 7) % 15 as z, case when n_nationkey % 2 = 0 then 'N' else 'S' end as side from nation) a""",
    "crs_agreement": """select a.id, b.id as other, a.kind = b.kind and (a.kind = 2 or a.z = b.z and (a.kind = 3 or a.side = b.side)) as same, true as compatible from (select n_nationkey as id, n_nationkey % 5 as kind, (n_nationkey * 7) % 15 as z, n_nationkey % 2 as side from nation) a
      join (select n_nationkey as id, n_nationkey % 5 as kind, (n_nationkey * 7) % 15 as z, n_nationkey % 2 as side from nation) b on a.id < b.id and (a.kind < 2 and b.kind < 2 and a.z = b.z and a.side = b.side or a.kind = 2 and b.kind = 2 or a.kind = 3 and b.kind = 3 and a.z = b.z)""",
    "overview_lattice": sql("select br * 3 + bc + 1 as block_id, br, bc, br * 40 as r0, least(h, (br + 1) * 40) as r1, bc * 40 as c0, least(97, (bc + 1) * 40) as c1 from (select h, unnest(range((h + 39) // 40)) as br from grid_h) a cross join range(3) b(bc)", "grid_h"),
    "plan_tiles": sql(_TILES, "grid_h"),
    "resume_antijoin": sql(f"select * from ({_TILES}) t where index % 3 <> 0", "grid_h"),
    "input_selection": sql("select folder_key, count(*) as found, case when count(*) = 1 then min(path) end as path from datasets group by folder_key", "datasets"),
    "profile_validation": """select 'part ' || cast(p_partkey as varchar) as name, problems = '' as valid, problems from (select p_partkey, case p_partkey % 4
      when 0 then case when p_size < 6 then 'upslope limit must be at least the landing slope' when p_size >= 45 then 'upslope limit must be below 45' else '' end
      when 1 then case when p_size / 50.0::double < 0.3 then 'ring obstacle limit must be at least the pad''s' else '' end
      when 2 then case when p_size <= 6 then 'approach range must pass the cleared area' else '' end
      else concat_ws('; ', case when p_size <= 10 then 'touchdown diameter must be positive' end) end as problems from part) a""",
    "profile_what_if": """select 'part ' || cast(p_partkey as varchar) as name, r_regionkey * 60 + 2.0::double as tdp_diameter_m, case when r_regionkey % 2 = 0 then r_regionkey * 70.0::double else 3.0 end as cleared_ring_m from part cross join region
      where p_partkey % 50 = 0 and r_regionkey * 60 + 2 between 5 and 200 and (r_regionkey % 2 = 1 or r_regionkey * 70 <= 200)""",
    "catalog_weight_class": """select name, weight_class, coalesce(diameter, case weight_class when 'light' then 25.0 when 'medium' then 50 when 'heavy' then 80 end)::double as tdp_diameter_m, coalesce(diameter, case weight_class when 'light' then 25.0 when 'medium' then 50 when 'heavy' then 80 end) >= 1.5 * p_size as footprint_ok
      from (select cast(p_partkey as varchar) as name, p_size, case when p_partkey % 13 > 0 and p_size > 1 then case when p_size * 400 - 400 <= 4500 then 'light' when p_size * 400 - 400 <= 14000 then 'medium' else 'heavy' end end as weight_class, case when p_partkey % 3 = 0 then p_size * 1.6::double end as diameter from part) a""",
}
