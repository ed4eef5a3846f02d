"""Masks over grid cells from polygons, lines, points and circles, distances to them, and what they remove.

Geometry is kept as vertex rows. Every mask is a set of cells (r, c); a cell's centre is (c + 0.5, height - r - 0.5)
times the cell size. Features meet cells through rows, bins or offsets, never through all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsift.operators import spatial, tiles
from gridsift.operators.storage import Store

#: Search centres that are broadcast; more are met in bins.
FEW_CENTRES = 1000


def edges(polygons: DataFrame) -> DataFrame:
    """fid, x1, y1, x2, y2 of the rings of polygons(fid, ring, i, x, y), each ring closed."""
    ring = Window.partitionBy("fid", "ring").orderBy("i")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    return polygons.select("fid", F.col("x").alias("x1"), F.col("y").alias("y1"), following("x").alias("x2"), following("y").alias("y2"))


def polygon_cells(polygons: DataFrame, cells: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """fid, r, c: cells whose centre is inside a polygon by the even-odd rule, so that inner rings are holes.

    Each edge becomes its crossings with the rows of cells that it spans, half open upwards; crossings of a row
    are paired in order and give the cells from the first (inclusive) to the second (exclusive). cells(r, c, y)
    says which rows exist, where they are and how wide they are.
    """
    rows = cells.groupBy("r").agg(F.max("y").alias("y"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))
    own = edges(polygons).filter("y1 != y2").withColumn("low", F.least("y1", "y2")).withColumn("high", F.greatest("y1", "y2"))
    top = rows.agg((F.max("y") / cell_m + F.max_by("r", "y")).alias("top"))
    # rows whose centre may be crossed: from the geometry, then exactly
    spanned = own.crossJoin(F.broadcast(top)).withColumn("r", F.explode(F.sequence(F.floor(F.col("top") - F.col("high") / cell_m), F.ceil(F.col("top") - F.col("low") / cell_m))))
    crossed = spanned.join(rows, "r").filter("low <= y and y < high")
    crossed = crossed.select("fid", "r", "c_min", "c_max", (F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("xc"))
    row = Window.partitionBy("fid", "r").orderBy("xc")
    pairs = crossed.withColumn("turn", F.row_number().over(row)).withColumn("xe", F.lead("xc").over(row)).filter("turn % 2 = 1")
    first = F.greatest(F.ceil(F.col("xc") / cell_m - 0.5), F.col("c_min"))
    last = F.least(F.ceil(F.col("xe") / cell_m - 0.5) - 1, F.col("c_max"))
    return pairs.withColumn("first", first).withColumn("last", last).filter("first <= last").select("fid", "r", F.explode(F.sequence("first", "last")).alias("c"))


def densify(lines: DataFrame, step: float) -> DataFrame:
    """fid, part, x, y: points along the parts of lines(fid, part, i, x, y), at most step apart, vertices included."""
    part = Window.partitionBy("fid", "part").orderBy("i")
    ahead = lines.withColumn("x2", F.lead("x").over(part)).withColumn("y2", F.lead("y").over(part))
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) / step))
    inner = ahead.filter("x2 is not null").withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    points = inner.select("fid", "part", (F.col("x") + (F.col("x2") - F.col("x")) * F.col("k") / F.col("n")).alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * F.col("k") / F.col("n")).alias("y"))
    return points.unionByName(ahead.filter("x2 is null").select("fid", "part", "x", "y"))


def cell_of(points: DataFrame, height: Column, cell_m: float = 1.0) -> DataFrame:
    """points(x, y) with r and c of the cell they lie in, by flooring."""
    return points.withColumn("r", F.floor(height - F.col("y") / cell_m)).withColumn("c", F.floor(F.col("x") / cell_m))


def grow(mask: DataFrame, radius_px: float, tile: int = tiles.TILE) -> DataFrame:
    """r, c, d2: cells within the radius of mask(r, c), with the squared distance in cells to the nearest one.

    Worked out in tiles: the distance within each row by two running scans, then the least over the rows in reach. A mask
    cell goes to the tiles that its disk touches; no disk is listed cell by cell.
    """
    reach = int(math.floor(radius_px + 1e-9))
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    moved = mask.select("r", "c").distinct().withColumn("tr", spread("r")).withColumn("tc", spread("c"))
    size, far = tile + 2 * reach, 1 << 30

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        r0, c0 = (k.as_py() * tile - reach for k in key)
        there = np.zeros((size, size), bool)
        there[rows["r"].to_numpy() - r0, rows["c"].to_numpy() - c0] = True
        column = np.arange(size)
        left = np.maximum.accumulate(np.where(there, column, -far), axis=1)
        right = np.minimum.accumulate(np.where(there, column, far)[:, ::-1], axis=1)[:, ::-1]
        along = np.minimum(np.minimum(column - left, right - column), far >> 15).astype(np.int64) ** 2
        least = np.min([along[reach + dr : reach + dr + tile] + dr * dr for dr in range(-reach, reach + 1)], axis=0)[:, reach : reach + tile]
        r, c = np.nonzero(least <= radius_px * radius_px + 1e-9)
        return pa.table({"r": r + (r0 + reach), "c": c + (c0 + reach), "d2": least[r, c]})

    return moved.groupBy("tr", "tc").applyInArrow(run, "r long, c long, d2 long")


def line_cells(lines: DataFrame, cells: DataFrame, height: Column, width: float, cell_m: float = 1.0) -> DataFrame:
    """Cells within half the width of a cell that a line touches, where it is sampled every half cell."""
    touched = cell_of(densify(lines, cell_m / 2), height, cell_m).select("r", "c").distinct()
    return grow(touched, width / 2 / cell_m).join(cells.select("r", "c"), ["r", "c"], "left_semi").select("r", "c")


def point_cells(points: DataFrame, cells: DataFrame, height: Column, radius: float, cell_m: float = 1.0) -> DataFrame:
    """Cells whose centre is within the radius of a point, and the point's own cell."""
    k = int(math.ceil(radius / cell_m)) + 1
    around = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in range(-k, k + 1) for dc in range(-k, k + 1))))
    near = cell_of(points.select("x", "y"), height, cell_m).withColumn("o", around).select("x", "y", (F.col("o.dr") == 0).alias("same_r"), (F.col("o.dc") == 0).alias("same_c"), (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    dx, dy = (F.col("c") + 0.5) * cell_m - F.col("x"), (height - F.col("r") - 0.5) * cell_m - F.col("y")
    return near.filter((F.col("same_r") & F.col("same_c")) | (dx * dx + dy * dy <= radius * radius)).select("r", "c").distinct().join(cells.select("r", "c"), ["r", "c"], "left_semi")


def circle_cells(cells: DataFrame, circles: DataFrame, bin_m: float = 64.0) -> DataFrame:
    """Cells(r, c, x, y) in any of the search circles(x, y, radius), which meet them in square bins."""
    touched = lambda v: F.explode(F.sequence(F.floor((F.col(v) - F.col("radius")) / bin_m), F.floor((F.col(v) + F.col("radius")) / bin_m)))
    near = circles.withColumn("bx", touched("x")).withColumn("by", touched("y")).select("bx", "by", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius")
    own = cells.select("r", "c", "x", "y", F.floor(F.col("x") / bin_m).alias("bx"), F.floor(F.col("y") / bin_m).alias("by"))
    inside = (own["bx"] == near["bx"]) & (own["by"] == near["by"]) & (F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2)) <= F.col("radius") * F.col("radius"))
    return own.join(near, inside, "left_semi").select("r", "c")


def nearest_distance(cells: DataFrame, mask: DataFrame, reach_px: float, cell_m: float = 1.0) -> DataFrame:
    """r, c, distance: from each cell's centre to the nearest cell of the mask, null where it is out of reach."""
    return cells.select("r", "c").join(grow(mask, reach_px), ["r", "c"], "left").select("r", "c", (F.sqrt("d2") * cell_m).alias("distance"))


def closed(features: DataFrame) -> DataFrame:
    """features(fid, kind, part, i, x, y, ...) whose area rings end where they begin."""
    first = F.min_by(F.struct("x", "y"), "i")
    keys = [c for c in features.columns if c not in ("i", "x", "y")]
    ends = features.filter("kind = 'area'").groupBy(*keys).agg(first.alias("p"), (F.max("i") + 1).alias("i")).select(*keys, "i", "p.x", "p.y")
    return features.unionByName(ends)


def tallest_within(touched: DataFrame, radius_px: float, tile: int = tiles.TILE) -> DataFrame:
    """r, c, agl_m, fid: of touched(r, c, agl_m, fid), the tallest within the radius of each cell, ties to the smaller fid. No disk is listed cell by cell."""
    reach = int(math.floor(radius_px + 1e-9))
    span = {dr: int(math.floor(math.sqrt(radius_px * radius_px - dr * dr + 1e-9))) for dr in range(-reach, reach + 1)}
    top = touched.groupBy("r", "c").agg(F.max(F.struct("agl_m", (-F.col("fid")).alias("back"))).alias("t")).select("r", "c", "t.agl_m", (-F.col("t.back")).alias("fid"))
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    moved = top.withColumn("tr", spread("r")).withColumn("tc", spread("c"))
    size = tile + 2 * reach

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        r0, c0 = (k.as_py() * tile - reach for k in key)
        agl, fid = rows["agl_m"].to_numpy(), rows["fid"].to_numpy()
        order = np.lexsort((-fid, agl))
        place = np.empty(len(order))
        place[order] = np.arange(len(order))
        grid = np.full((size, size), np.nan)
        grid[rows["r"].to_numpy() - r0, rows["c"].to_numpy() - c0] = place
        best = tiles.largest(grid, span)[reach : reach + tile, reach : reach + tile]
        r, c = np.nonzero(~np.isnan(best))
        owner = order[best[r, c].astype(np.int64)]
        return pa.table({"r": r + (r0 + reach), "c": c + (c0 + reach), "agl_m": agl[owner], "fid": fid[owner]})

    return moved.groupBy("tr", "tc").applyInArrow(run, "r long, c long, agl_m double, fid long")


def footprint_heights(features: DataFrame, cells: DataFrame, height: Column, buffer_m: float, cell_m: float = 1.0) -> DataFrame:
    """r, c, agl_m, owner: the tallest footprint over each cell of cells(r, c, y), ties to the smaller fid.

    features(fid, kind, part, i, x, y, agl_m) are points, lines of parts and areas of rings (even-odd). Points reach cells whose centre is
    within the buffer, or three quarters of a cell; lines and outlines reach as far around the cells that they touch; areas have their inner cells too.
    """
    radius = max(buffer_m, 0.75 * cell_m)
    k = int(math.ceil(radius / cell_m)) + 1
    around = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in range(-k, k + 1) for dc in range(-k, k + 1) if dr * dr + dc * dc <= (radius / cell_m + 1.5) ** 2)))
    near = cell_of(features.filter("kind = 'point'"), height, cell_m).withColumn("o", around).select("fid", "agl_m", "x", "y", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    dx, dy = (F.col("c") + 0.5) * cell_m - F.col("x"), (height - F.col("r") - 0.5) * cell_m - F.col("y")
    points = near.filter(dx * dx + dy * dy <= radius * radius)
    tall = features.select("fid", "agl_m").distinct()
    outlines = closed(features.filter("kind != 'point'"))
    touched = cell_of(densify(outlines, cell_m / 2), height, cell_m).select("fid", "r", "c").distinct().join(tall, "fid")
    inner = polygon_cells(features.filter("kind = 'area'").withColumnRenamed("part", "ring"), cells, cell_m).join(tall, "fid")
    parts = [x.select("r", "c", "agl_m", "fid") for x in (points, tallest_within(touched, radius / cell_m), inner)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("r", "c").agg(F.max(F.struct("agl_m", (-F.col("fid")).alias("back"))).alias("t"))
    return whole.join(cells.select("r", "c"), ["r", "c"], "left_semi").select("r", "c", "t.agl_m", (-F.col("t.back")).alias("owner"))


def footprint_samples(features: DataFrame, cells: DataFrame, height: Column, step_m: float = 5.0, cell_m: float = 1.0) -> DataFrame:
    """owner, x, y, top_m: points, and points along lines and outlines at most a step apart, with the height of their tops; those over unknown ground go."""
    tall = features.select("fid", "agl_m").distinct()
    along = densify(closed(features.filter("kind != 'point'")), step_m).select("fid", "x", "y").unionByName(features.filter("kind = 'point'").select("fid", "x", "y"))
    at = cell_of(along.join(tall, "fid"), height, cell_m).join(cells.filter("z is not null").select("r", "c", "z"), ["r", "c"])
    return at.select(F.col("fid").alias("owner"), "x", "y", (F.col("z") + F.col("agl_m")).alias("top_m"))


def burn_heights(cells: DataFrame, footprints: DataFrame) -> DataFrame:
    """cells(r, c, z, dsm) whose surface is raised to the ground plus the tallest of footprints(r, c, agl_m)."""
    tallest = footprints.groupBy("r", "c").agg(F.max("agl_m").alias("_agl"))
    out = cells.join(tallest, ["r", "c"], "left")
    top = F.col("z") + F.col("_agl")
    return out.withColumn("dsm", F.when(top.isNull(), F.col("dsm")).otherwise(F.greatest(F.coalesce("dsm", top), top))).select(*cells.columns)


def nearest_centre(points: DataFrame, circles: DataFrame, key: str = "id") -> DataFrame:
    """key, centre, distance and bearing to the nearest centre of every point; the smaller id wins ties. Null where a point has no position or there are no centres.

    Up to FEW_CENTRES centres are compared with every point; of more, each point meets those in growing square bins. Both give the same rows.
    """
    found = _nearest_centre(points.filter("x is not null and y is not null"), circles.filter("x is not null and y is not null"), key)
    return points.select(key).join(found, key, "left")


def _nearest_centre(points: DataFrame, circles: DataFrame, key: str) -> DataFrame:
    centres = circles.select(F.col("id").alias("centre"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    reduced = lambda pairs: pairs.withColumn("distance", F.hypot(dx, dy)).withColumn("bearing", F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0))).groupBy(key).agg(F.min(F.struct("distance", "centre", "bearing")).alias("b")).select(key, "b.centre", "b.distance", "b.bearing")
    if centres.limit(FEW_CENTRES + 1).count() <= FEW_CENTRES:
        return reduced(points.crossJoin(F.broadcast(centres)))
    span = points.select("x", "y").union(centres.select("x2", "y2")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    widest = math.hypot(span["x1"] - span["x0"], span["y1"] - span["y0"])
    store, out, left, radius = Store(points.sparkSession, "nearest"), None, points, max(widest / math.sqrt(centres.count()), 1e-9)
    while True:
        found = store.put(f"found-{radius:.6g}", reduced(spatial.near_join(left, centres, radius)))
        out = found if out is None else out.unionByName(found)
        left = left.join(found, key, "left_anti")
        if radius > widest or left.isEmpty():
            return out
        radius *= 2
