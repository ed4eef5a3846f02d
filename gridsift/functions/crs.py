"""Coordinate systems as far as headers tell: well-known text, whether two agree, and extents in UTM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions import geodesy as g

# Keywords of well-known text, version 1 and 2.
PROJECTED, GEOGRAPHIC = ("PROJCS", "PROJCRS", "PROJECTEDCRS"), ("GEOGCS", "GEOGCRS", "GEOGRAPHICCRS", "GEODCRS")
VERTICAL = ("VERT_CS", "VERTCRS", "VERTICALCRS")
WEB_MERCATOR = (3857, 900913, 102100, 102113)
EDGE_STEPS = 8


def from_wkt(text: Column) -> Column:
    """struct<kind, name, epsg, unit, utm, vertical, web_mercator> of a well-known text; unknown parts are null.

    Of a compound system the horizontal part counts, and vertical is the name of the other. utm is a zone with N or S.
    """
    after = lambda words: F.regexp_extract(text, rf'(?is)\b(?:{"|".join(words)})\s*\[\s*("[^"]*".*)', 1)
    own = F.when(after(PROJECTED) != "", after(PROJECTED)).otherwise(after(GEOGRAPHIC))
    kind = F.when(after(PROJECTED) != "", F.lit("projected")).when(after(GEOGRAPHIC) != "", F.lit("geographic"))
    quoted = lambda x: F.split(x, '"').getItem(1)
    name = F.when(own != "", F.replace(quoted(own), F.lit("_"), F.lit(" ")))
    vertical = F.when(after(VERTICAL) != "", quoted(after(VERTICAL)))
    # the vertical part may stand behind the horizontal one; its codes are not those of the system
    horizontal = F.when(vertical.isNotNull(), F.regexp_replace(own, rf'(?is)\b(?:{"|".join(VERTICAL)})\s*\[.*', "")).otherwise(own)
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(horizontal, F.lit(pattern)), F.lit(-1))
    epsg = last(r'(?i)\b(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?([0-9]+)').cast("int")
    unit = F.when(kind == "geographic", F.lit("degree")).otherwise(F.lower(last(r'(?i)\b(?:LENGTHUNIT|UNIT)\s*\[\s*"([^"]+)"')))
    zone = F.regexp_extract_all(name, F.lit(r"(?i)UTM zone ([0-9]{1,2} ?[NS])"))
    fields = F.struct(kind.alias("kind"), name.alias("name"), epsg.alias("epsg"), unit.alias("unit"), F.upper(F.replace(F.try_element_at(zone, F.lit(1)), F.lit(" "))).alias("zone"), vertical.alias("vertical"))
    whole = lambda v: F.struct(v["kind"].alias("kind"), v["name"].alias("name"), v["epsg"].alias("epsg"), v["unit"].alias("unit"), F.coalesce(utm_of(v["epsg"]), v["zone"]).alias("utm"), v["vertical"].alias("vertical"), F.coalesce(v["epsg"].isin(*WEB_MERCATOR), F.lit(False)).alias("web_mercator"))
    return F.transform(F.array(fields), whole)[0]


def utm_of(epsg: Column) -> Column:
    """Zone with hemisphere of an EPSG code of UTM on WGS 84 or NAD 83, else null."""
    zone = epsg % 100
    side = F.when(epsg.between(32601, 32660) | epsg.between(26901, 26923), F.lit("N")).when(epsg.between(32701, 32760), F.lit("S"))
    return F.concat(zone.cast("string"), side)


def same(a: Column, b: Column) -> Column:
    """Whether two systems (see from_wkt) are one: by their codes, else by their names."""
    codes = a["epsg"].isNotNull() & b["epsg"].isNotNull()
    names = a["name"].isNotNull() & b["name"].isNotNull() & (a["name"] != "") & (F.lower(a["name"]) == F.lower(b["name"]))
    return F.coalesce(F.when(codes, a["epsg"] == b["epsg"]).otherwise(names), F.lit(False))


def compatible(a: Column, b: Column) -> Column:
    """Whether extents in both can be compared as they are: the same system, or the same UTM zone on whatever datum."""
    return same(a, b) | F.coalesce((a["kind"] == "projected") & (b["kind"] == "projected") & (a["utm"] == b["utm"]), F.lit(False))


def extents_in_utm(boxes: DataFrame) -> DataFrame:
    """id, x_min, y_min, x_max, y_max of boxes(id, west, south, east, north, zone) in UTM: of points along their edges.

    Boxes that are no geographic ones are left out. Northings of a northern zone go below 0 south of the equator.
    """
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(EDGE_STEPS)), lambda i: i / EDGE_STEPS))
    own = boxes.filter("west between -180 and 180 and south between -90 and 90").withColumn("t", t)
    across, up = F.col("west") + F.col("t") * (F.col("east") - F.col("west")), F.col("south") + F.col("t") * (F.col("north") - F.col("south"))
    points = F.explode(F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((across, F.col("south")), (across, F.col("north")), (F.col("west"), up), (F.col("east"), up)))))
    rows = own.withColumn("p", points).select("id", "zone", "p.lon", "p.lat")
    x, y = g.to_utm("lat", "lon", "zone")
    rows = rows.select("id", F.expr(x).alias("x"), (F.expr(y) - F.when(F.col("lat") < 0, 10000000).otherwise(0)).alias("y"))
    return rows.groupBy("id").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))
