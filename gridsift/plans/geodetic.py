"""DuckDB SQL for the geodesy and parsing queries, written apart from the expressions that Spark runs.

Grid references are spelled from lists of letters; texts
have the results that a reader would write down.
"""

from __future__ import annotations

from gridsift.plans.oracle import define, sql

# WGS 84 and the series for a transverse Mercator, step by step.
define("ellipsoid", (), "select a, e2, e2 / (1 - e2) as ep2, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) as e1 from (select 6378137.0::double as a, (1 / 298.257223563::double) * (2 - 1 / 298.257223563::double) as e2) w")
define(
    "zoned",
    ("positions",),
    """select id, lat, lon, cast(case when lat between 72 and 84 and lon >= 0 and lon < 42 then [31, 33, 35, 37][case when lon < 9 then 1 when lon < 21 then 2 when lon < 33 then 3 else 4 end]
      when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32 else 1 + cast(floor((lon + 180) / 6) as int) % 60 end as bigint) as zone,
    case when lat between -80 and 84 then ['C','D','E','F','G','H','J','K','L','M','N','P','Q','R','S','T','U','V','W','X'][1 + least(19, cast(floor((lat + 80) / 8) as int))] else '' end as band from positions""",
)
define(
    "projected",
    ("zoned", "ellipsoid"),
    """select id, lat, lon, zone, band,
      500000 + 0.9996 * nu * (p + (1 - t + c) * p**3 / 6 + (5 - 18*t + t*t + 72*c - 58*ep2) * p**5 / 120) as east,
      0.9996 * (arc + nu * tan(phi) * (p**2 / 2 + (5 - t + 9*c + 4*c*c) * p**4 / 24 + (61 - 58*t + t*t + 600*c - 330*ep2) * p**6 / 720)) + case when lat < 0 then 10000000 else 0 end as north
    from (select *, a / sqrt(1 - e2 * sin(phi)**2) as nu, tan(phi)**2 as t, ep2 * cos(phi)**2 as c, radians(lon - (6 * zone - 183)) * cos(phi) as p,
        a * ((1 - e2/4 - 3*e2**2/64 - 5*e2**3/256) * phi - (3*e2/8 + 3*e2**2/32 + 45*e2**3/1024) * sin(2*phi) + (15*e2**2/256 + 45*e2**3/1024) * sin(4*phi) - (35*e2**3/3072) * sin(6*phi)) as arc
      from (select *, radians(lat) as phi from zoned cross join ellipsoid) z) s""",
)
define(
    "spelled",
    ("projected",),
    """select *, case when band = '' or east < 100000 or east >= 900000 then '' else printf('%02d', zone) || band || ' '
      || (['STUVWXYZ', 'ABCDEFGH', 'JKLMNPQR'][1 + zone % 3])[cast(floor(east / 100000) as int)] || (case when zone % 2 = 1 then 'ABCDEFGHJKLMNPQRSTUV' else 'FGHJKLMNPQRSTUVABCDE' end)[1 + cast(floor(north / 100000) as int) % 20]
      || printf(' %05d %05d', cast(floor(east) as int) % 100000, cast(floor(north) as int) % 100000) end as mgrs from projected""",
)


def _back(source: str, east: str, north: str) -> str:
    """Positions of the rows of source by the inverse series."""
    return f"""select id, degrees(f - nu * tan(f) / rho * (d**2 / 2 - (5 + 3*t + 10*c - 4*c*c - 9*ep2) * d**4 / 24 + (61 + 90*t + 298*c + 45*t*t - 252*ep2 - 3*c*c) * d**6 / 720)) as lat,
      6 * zone - 183 + degrees((d - (1 + 2*t + c) * d**3 / 6 + (5 - 2*c + 28*t - 3*c*c + 8*ep2 + 24*t*t) * d**5 / 120) / cos(f)) as lon
    from (select *, ({east} - 500000) / 0.9996 / nu as d from (select *, tan(f)**2 as t, ep2 * cos(f)**2 as c, a / sqrt(1 - e2 * sin(f)**2) as nu, a * (1 - e2) / (1 - e2 * sin(f)**2)**1.5 as rho
      from (select *, mu + (3*e1/2 - 27*e1**3/32) * sin(2*mu) + (21*e1**2/16 - 55*e1**4/32) * sin(4*mu) + 151*e1**3/96 * sin(6*mu) + 1097*e1**4/512 * sin(8*mu) as f
        from (select *, ({north} - case when lat < 0 then 10000000 else 0 end) / 0.9996 / (a * (1 - e2/4 - 3*e2**2/64 - 5*e2**3/256)) as mu from (select * from {source}) g cross join ellipsoid) m) n) o) q"""


define("returned", ("projected", "ellipsoid"), _back("projected", "east", "north"))
define("square_centres", ("spelled", "ellipsoid"), _back("spelled where mgrs <> ''", "floor(east) + 0.5", "floor(north) + 0.5"))
_POINTS = "['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW']"

ORACLES = {
    "utm_forward": sql("select id, zone, band, round(east, 3) as east, round(north, 3) as north from projected", "projected"),
    "utm_inverse": sql("select id, round(lat, 7) as lat2, round(lon, 7) as lon2 from returned", "returned"),
    "mgrs_encode": sql("select id, mgrs from spelled", "spelled"),
    "mgrs_decode": sql("select p.id, round(s.lat, 6) as lat, round(s.lon, 6) as lon from positions p left join square_centres s using (id)", "positions", "square_centres"),
    "utm_epsg": sql(
        """select id, epsg, case when epsg is not null then (epsg % 100) || case when epsg between 32700 and 32799 then 'S' else 'N' end end as utm from (
      select id, cast(case when lat between -80 and 84 then case when lat < 0 then 32700 when id % 2 = 0 and zone < 24 then 26900 else 32600 end + zone end as bigint) as epsg
      from (select id, lat, 1 + cast(floor((lon + 180) / 6) as int) % 60 as zone from positions) z) e""",
        "positions",
    ),
    "metres_per_degree": sql(
        """select id, round(x, 3) as lon_m, round(y, 3) as lat_m, round(sqrt(x * y) / 10000, 3) as cell_m from (
      select id, 111412.84 * cos(radians(lat)) - 93.5 * cos(radians(3 * lat)) + 0.118 * cos(radians(5 * lat)) as x, 111132.954 - 559.822 * cos(radians(2 * lat)) + 1.175 * cos(radians(4 * lat)) as y from positions) m""",
        "positions",
    ),
    "compass_points": sql(f"select id, {_POINTS}[1 + cast(floor(b / 22.5 + 0.5) as int) % 16] as compass16, {_POINTS}[1 + 2 * (cast(floor(b / 45 + 0.5) as int) % 8)] as compass8 from (select id, ((lon * 1.7) % 360 + 360) % 360 as b from positions) t", "positions"),
}
