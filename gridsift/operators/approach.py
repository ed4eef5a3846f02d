"""Approach analysis: rays over the surface, swept sectors, listed obstacles, and what they say of a site.

candidates are rows with r, c, x, y, elevation, aspect, upslope. Bearings are degrees from north, clockwise, from
the site towards the sector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsift.operators.spatial import near_join
from gridsift.operators.tiles import TILE
from gridsift.sources.profiles import Aircraft, Mission

CLEAR, MARGINAL, BLOCKED, INCOMPLETE = "CLEAR", "MARGINAL", "BLOCKED", "INCOMPLETE"
OBSTACLE_BUFFER_M = 10.0
#: Added to coordinates before they are floored to cells, so that samples on a border fall to the same side everywhere.
BORDER = 1e-9


def difference(a: Column, b: Column) -> Column:
    """Smaller angle between two bearings."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def ray_worst(candidates: DataFrame, cells: DataFrame, height: int, aircraft: Aircraft, mission: Mission, cell_m: float = 1.0, tile: int = TILE) -> DataFrame:
    """r0, c0, ray, worst (steepest angle), distance (of the first sample that has it), coverage: one row per candidate and ray.

    Every ray is sampled at steps of a cell; samples off the grid or without a surface count against the coverage. Candidates go to the
    tile that they lie in, cells to the tiles whose rays reach them, and rays are looked up there: no sample is a row.
    """
    step = max(cell_m, 0.5)
    first = max(aircraft.tdp_radius_m, step)
    n = math.ceil((aircraft.approach_range_m + 0.5 * step - first) / step - 1e-9)
    rays = round(360.0 / mission.ray_step_deg)
    distance = first + step * np.arange(n)
    turns = [math.radians(ray * float(mission.ray_step_deg)) for ray in range(rays)]
    east, north = (np.array([[f(a)] for a in turns]) * distance for f in (math.sin, math.cos))
    reach = math.ceil((first + (n - 1) * step) / cell_m) + 1
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    surface = cells.select("r", "c", F.coalesce("dsm", "z").alias("top")).filter("top is not null").withColumn("tr", spread("r")).withColumn("tc", spread("c"))
    own = candidates.select(F.col("r").alias("r0"), F.col("c").alias("c0"), "x", "y", (F.col("elevation") + aircraft.clearance_height_m).alias("level"))
    own = own.withColumn("tr", F.floor((F.lit(height) - F.col("y") / cell_m) / tile)).withColumn("tc", F.floor(F.col("x") / cell_m / tile))
    size = tile + 2 * reach

    def look(tr: int, tc: int, top: np.ndarray, sites: pa.Table) -> pa.Table:
        x, y, level = (sites[k].to_numpy()[:, None, None] for k in ("x", "y", "level"))
        c = np.floor((x + east) / cell_m + BORDER).astype(np.int64) - (tc * tile - reach)
        r = np.floor(height - (y + north) / cell_m + BORDER).astype(np.int64) - (tr * tile - reach)
        with np.errstate(all="ignore"):
            angle = np.degrees(np.arctan2(top[r, c] - level, distance))
        known = ~np.isnan(angle)
        best = np.argmax(np.where(known, angle, -np.inf), axis=2)  # the first of equal ones
        some = known.any(axis=2)
        worst = np.where(some, np.take_along_axis(angle, best[:, :, None], 2)[:, :, 0], np.nan).ravel()
        at = np.where(some, distance[best], np.nan).ravel()
        per_ray = {k: np.repeat(sites[k].to_numpy(), rays) for k in ("r0", "c0")} | {"ray": np.tile(np.arange(rays, dtype=np.int32), len(sites))}
        return pa.table(per_ray | {"worst": pa.array(worst, from_pandas=True), "distance": pa.array(at, from_pandas=True), "coverage": known.mean(axis=2).ravel()})

    kind = "r0 long, c0 long, ray int, worst double, distance double, coverage double"
    empty = pa.schema([("r0", pa.int64()), ("c0", pa.int64()), ("ray", pa.int32()), ("worst", pa.float64()), ("distance", pa.float64()), ("coverage", pa.float64())]).empty_table()

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, sites: pa.Table) -> pa.Table:
        if not len(sites):
            return empty
        tr, tc = (k.as_py() for k in key)
        top = np.full((size, size), np.nan)
        top[rows["r"].to_numpy() - (tr * tile - reach), rows["c"].to_numpy() - (tc * tile - reach)] = rows["top"].to_numpy()
        return pa.concat_tables(look(tr, tc, top, sites.slice(i, 256)) for i in range(0, len(sites), 256))  # bounds the samples at hand

    return surface.groupBy("tr", "tc").cogroup(own.groupBy("tr", "tc")).applyInArrow(run, kind)


def listed_angles(candidates: DataFrame, samples: DataFrame, aircraft: Aircraft, mission: Mission, buffer_m: float = OBSTACLE_BUFFER_M) -> DataFrame:
    """r0, c0, azimuth, listed, owner: the steepest of samples(owner, x, y, top_m) in each sector that has one in range."""
    first = max(aircraft.tdp_radius_m, 1.0)
    own = candidates.select(F.col("r").alias("r0"), F.col("c").alias("c0"), "x", "y", (F.col("elevation") + aircraft.clearance_height_m).alias("level"))
    pairs = near_join(own, samples.select("owner", F.col("x").alias("x2"), F.col("y").alias("y2"), "top_m"), aircraft.approach_range_m + buffer_m)
    pairs = pairs.withColumn("effective", F.greatest(F.sqrt("d2") - buffer_m, F.lit(first))).filter(F.col("effective") <= aircraft.approach_range_m)
    pairs = pairs.withColumn("bearing", F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))) + 360.0, F.lit(360.0))).withColumn("angle", F.degrees(F.atan2(F.col("top_m") - F.col("level"), F.col("effective"))))
    steps = round(360.0 / mission.azimuth_step_deg)
    width = int(math.floor(aircraft.corridor_half_width_deg / mission.azimuth_step_deg)) + 1
    nearest = F.floor(F.col("bearing") / mission.azimuth_step_deg + 0.5)
    sectors = pairs.withColumn("i", F.explode(F.transform(F.sequence(F.lit(-width), F.lit(width)), lambda k: F.pmod(nearest + k, F.lit(steps))))).withColumn("azimuth", F.col("i") * float(mission.azimuth_step_deg))
    member = sectors.filter(difference(F.col("bearing"), F.col("azimuth")) <= aircraft.corridor_half_width_deg + 1e-9)
    return member.groupBy("r0", "c0", "azimuth").agg(F.max(F.struct("angle", (-F.col("owner")).alias("back"))).alias("b")).select("r0", "c0", "azimuth", F.col("b.angle").alias("listed"), (-F.col("b.back")).alias("owner"))


def sectors(rays: DataFrame, aircraft: Aircraft, mission: Mission, listed: DataFrame | None = None) -> DataFrame:
    """r0, c0, azimuth, worst, coverage, class, obstacle: one row per candidate and sector.

    Rays are summed up once and then dealt to the sectors that they lie in. obstacle is the listed obstacle that
    is steeper than all rays, or within half a degree of the steepest. A sector without any surface and without a
    listed obstacle has no angle and is incomplete; a blocked one stays blocked whatever its coverage.
    """
    n_rays, n_sectors = round(360.0 / mission.ray_step_deg), round(360.0 / mission.azimuth_step_deg)
    half = aircraft.corridor_half_width_deg + 1e-9
    apart = lambda a, b: abs((a - b + 180.0) % 360.0 - 180.0)
    member = [(ray, float(s * mission.azimuth_step_deg)) for ray in range(n_rays) for s in range(n_sectors) if apart(ray * mission.ray_step_deg, s * mission.azimuth_step_deg) <= half]
    table = F.broadcast(rays.sparkSession.createDataFrame(member, "ray int, azimuth double"))
    out = rays.join(table, "ray").groupBy("r0", "c0", "azimuth").agg(F.max("worst").alias("worst"), F.avg("coverage").alias("coverage"))
    if listed is None:
        out = out.withColumn("listed", F.lit(None).cast("double")).withColumn("owner", F.lit(None).cast("long"))
    else:
        out = out.join(listed, ["r0", "c0", "azimuth"], "left")
    steeper = F.col("listed").isNotNull() & (F.col("worst").isNull() | (F.col("listed") > F.col("worst")))
    out = out.withColumn("obstacle", F.when(steeper | (F.col("listed") >= F.col("worst") - 0.5), F.col("owner"))).withColumn("worst", F.when(steeper, F.col("listed")).otherwise(F.col("worst")))
    kind = (
        F.when(F.col("worst").isNull(), F.lit(INCOMPLETE))
        .when(F.col("worst") > aircraft.unsuitable_angle_deg, F.lit(BLOCKED))
        .when(F.col("coverage") < mission.minimum_approach_coverage_fraction, F.lit(INCOMPLETE))
        .when(F.col("worst") <= aircraft.suitable_angle_deg, F.lit(CLEAR))
        .otherwise(F.lit(MARGINAL))
    )
    return out.select("r0", "c0", "azimuth", "worst", "coverage", kind.alias("class"), "obstacle")


def summarize(candidates: DataFrame, found: DataFrame, mission: Mission) -> DataFrame:
    """candidates with assessed, clear, total sectors, best_azimuth, best_angle (rounded), heading and opposing."""
    own = candidates.select(F.col("r").alias("r0"), F.col("c").alias("c0"), "upslope", "aspect")
    rows = found.join(own, ["r0", "c0"])
    assessed = (F.col("class") != INCOMPLETE) & F.col("worst").isNotNull()
    uphill = F.pmod(F.col("aspect") + 180.0, F.lit(360.0))
    heading = F.pmod(F.col("azimuth") + 180.0, F.lit(360.0))
    usable = assessed & (~F.col("upslope") | F.col("aspect").isNull() | (difference(heading, uphill) <= mission.upslope_alignment_tolerance_deg))
    clear = F.sort_array(F.collect_list(F.when(F.col("class") == CLEAR, F.col("azimuth"))))
    per = rows.groupBy("r0", "c0").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(assessed).alias("assessed"), F.count_if(F.col("class") == CLEAR).alias("clear"),
        F.min(F.when(usable, F.struct("worst", "azimuth"))).alias("best"), clear.alias("open"),
    )
    opposing = F.exists("open", lambda a: F.exists(F.col("open"), lambda b: (a < b) & (F.abs(difference(a, b) - 180.0) <= 10.0)))
    per = per.select(F.col("r0").alias("r"), F.col("c0").alias("c"), "total", "assessed", "clear", F.col("best.azimuth").alias("best_azimuth"), F.round("best.worst", 2).alias("best_angle"), F.pmod(F.col("best.azimuth") + 180.0, F.lit(360.0)).alias("heading"), F.coalesce(opposing, F.lit(False)).alias("opposing"))
    return candidates.join(per, ["r", "c"], "left")


def class_letters(found: DataFrame) -> DataFrame:
    """r0, c0, letters: the initials of the sector classes from north on."""
    ordered = F.array_sort(F.collect_list(F.struct("azimuth", F.substring("class", 1, 1).alias("letter"))))
    return found.groupBy("r0", "c0").agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("letters"))


#: A sector within a candidate, as text and in memory.
SECTOR = "azimuth double, worst double, coverage double, class string, obstacle long"


def nested(found: DataFrame) -> DataFrame:
    """r0, c0, sectors: the sectors of each candidate from north on, as one array of structures."""
    whole = F.struct(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SECTOR.split(", ")))
    return found.groupBy("r0", "c0").agg(F.array_sort(F.collect_list(whole)).alias("sectors"))


def sectors_to_json(sectors: Column) -> Column:
    """A candidate's sectors as JSON text: what is not a finite number is null, and is written."""
    finite = lambda v: F.when(F.abs(v) < F.lit(float("inf")), v)
    clean = F.transform(sectors, lambda x: x.withField("worst", finite(x["worst"])).withField("coverage", finite(x["coverage"])))
    return F.to_json(clean, {"ignoreNullFields": "false"})


def sectors_from_json(text: Column) -> Column:
    """The sectors of JSON text. Fields that it lacks have their defaults: no coverage, class INCOMPLETE, no obstacle; fields of other names go. Null for text that is no such list."""
    read = F.from_json(text, f"array<struct<{SECTOR.replace(' ', ': ').replace(',:', ',')}>>")
    return F.transform(read, lambda x: x.withField("coverage", F.coalesce(x["coverage"], F.lit(0.0))).withField("class", F.coalesce(x["class"], F.lit(INCOMPLETE))))


def bearing_text(degrees: Column) -> Column:
    """Three digits, 000 to 359."""
    return F.lpad(F.pmod(F.round(degrees), F.lit(360.0)).cast("int").cast("string"), 3, "0")


def ranges(found: DataFrame, kind: str, mission: Mission) -> DataFrame:
    """r0, c0, first, last, sectors: runs of neighbouring sectors of a class; one run may pass through north."""
    step, total = float(mission.azimuth_step_deg), round(360.0 / mission.azimuth_step_deg)
    site = Window.partitionBy("r0", "c0").orderBy("azimuth")
    whole = Window.partitionBy("r0", "c0")
    rows = found.filter(F.col("class") == kind).withColumn("i", F.round(F.col("azimuth") / step).cast("int"))
    rows = rows.withColumn("run", F.col("i") - F.row_number().over(site)).withColumn("all", F.count(F.lit(1)).over(whole))
    runs = rows.groupBy("r0", "c0", "run", "all").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count(F.lit(1)).alias("n"))
    wraps = (F.min("lo").over(whole) == 0) & (F.max("hi").over(whole) == total - 1) & (F.count(F.lit(1)).over(whole) > 1)
    runs = runs.withColumn("wraps", wraps).withColumn("tail", F.max(F.when(F.col("hi") == total - 1, F.struct("lo", "n"))).over(whole))
    merged = runs.filter(~(F.col("wraps") & (F.col("hi") == total - 1))).withColumn("joins", F.col("wraps") & (F.col("lo") == 0))
    lo, n = F.when(F.col("joins"), F.col("tail.lo")).otherwise(F.col("lo")), F.col("n") + F.when(F.col("joins"), F.col("tail.n")).otherwise(F.lit(0))
    return merged.select("r0", "c0", F.pmod(lo * step - step / 2, F.lit(360.0)).alias("first"), F.pmod(F.col("hi") * step + step / 2, F.lit(360.0)).alias("last"), n.alias("sectors"))


def wind_choice(found: DataFrame, wind_deg: float, speed: float) -> DataFrame:
    """r0, c0, azimuth, off, headwind, crosswind: the clear sector, else the marginal one, nearest to the wind."""
    usable = found.filter(F.col("class").isin(CLEAR, MARGINAL)).withColumn("off", difference(F.pmod(F.col("azimuth") + 180.0, F.lit(360.0)), F.lit(float(wind_deg))))
    best = usable.groupBy("r0", "c0").agg(F.min(F.struct((F.col("class") != CLEAR).alias("second"), "off", "azimuth")).alias("b"))
    return best.select("r0", "c0", "b.azimuth", "b.off", F.round(speed * F.cos(F.radians("b.off")), 4).alias("headwind"), F.round(speed * F.sin(F.radians("b.off")), 4).alias("crosswind"))
