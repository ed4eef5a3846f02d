"""Queries behind the written results."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsift.plans.oracle import sql
from gridsift.plans.sites import ranked
from gridsift.sources import sinks
from gridsift.sources.bindings import bind

QUERIES = {
    "candidate_csv_view": lambda s, d: sinks.candidate_view(ranked(s, d)).select("rank", "site_id", "rating", "score", "elevation_m", "slope_deg", "upslope", "roughness_m", "best_azimuth", "heading", "clear_sectors", "opposing", "limiting"),
    "geojson_features": lambda s, d: sinks.features(bind(s, d, "points").select(F.col("id").alias("rank"), F.col("id").alias("site_id"), F.lit("x").alias("rating"), "score", "x", "y"), 5.0).select("rank", F.length("json").alias("chars"), F.get_json_object("json", "$.geometry.type").alias("kind")),
    "console_summary": lambda s, d: sinks.console_lines(ranked(s, d)).select(F.col("rank").cast("long").alias("rank"), "line"),
    "circle_ring": lambda s, d: bind(s, d, "circles").select("id", F.posexplode(sinks.circle(F.col("x"), F.col("y"), 12.0)).alias("i", "p")).select("id", F.col("i").cast("long").alias("i"), F.element_at("p", 1).alias("px"), F.element_at("p", 2).alias("py")),
    "sector_ring": lambda s, d: bind(s, d, "circles").select("id", F.posexplode(sinks.wedge(F.col("x"), F.col("y"), F.lit(30.0), 15.0, 12.0)).alias("i", "p")).select("id", F.col("i").cast("long").alias("i"), F.element_at("p", 1).alias("px"), F.element_at("p", 2).alias("py")),
}
ORACLES = {
    # two numbers of each of the 73 corners, with their brackets and commas, and the rest of the feature
    "geojson_features": sql(
        """select id as rank, cast(sum(length(px) + length(py) + 3) + 72 + length('{"type":"Feature","properties":{"rank":') + length(cast(id as varchar)) + length(',"site_id":') + length(cast(id as varchar))
      + length(',"rating":"x","score":') + length(any_value(case when score = floor(score) then cast(cast(score as bigint) as varchar) || '.0' else cast(score as varchar) end)) + length('},"geometry":{"type":"Polygon","coordinates":[[') + length(']]}}') as int) as chars, 'Polygon' as kind
    from (select id, any_value(score) over (partition by id) as score, cast(round(x + 5 * sin(radians((i % 72) * 5.0::double)), 3) + 0.0::double as varchar) as px, cast(round(y + 5 * cos(radians((i % 72) * 5.0::double)), 3) + 0.0::double as varchar) as py from points cross join range(73) t(i)) p group by id""",
        "points",
    ),
    "candidate_csv_view": sql("select cast(rank as varchar) as rank, site_id, rating, printf('%.1f', score) as score, printf('%.2f', elevation) as elevation_m, printf('%.2f', slope) as slope_deg, case when upslope then 'Yes' else 'No' end as upslope, printf('%.3f', roughness) as roughness_m, coalesce(lpad(cast(cast(best_azimuth % 360 as int) as varchar), 3, '0'), '') as best_azimuth, coalesce(lpad(cast(cast(heading % 360 as int) as varchar), 3, '0'), '') as heading, cast(clear as varchar) as clear_sectors, case when opposing then 'Yes' else 'No' end as opposing, limiting from ranked", "ranked"),
    "console_summary": sql("select rank, site_id || '  ' || rating || '  ' || printf('%.1f', score) || '  ' || limiting as line from ranked where rank <= 15", "ranked"),
    "circle_ring": sql("select id, i, round(x + 12.0 * sin(radians((i % 72) * 5.0::double)), 3) + 0.0::double as px, round(y + 12.0 * cos(radians((i % 72) * 5.0::double)), 3) + 0.0::double as py from circles cross join range(73) t(i)", "circles"),
    "sector_ring": sql("select id, i, case when i in (0, 18) then round(x, 3) else round(x + 12.0 * sin(radians(15 + (i - 1) * 1.875::double)), 3) end as px, case when i in (0, 18) then round(y, 3) else round(y + 12.0 * cos(radians(15 + (i - 1) * 1.875::double)), 3) end as py from circles cross join range(19) t(i)", "circles"),
}
