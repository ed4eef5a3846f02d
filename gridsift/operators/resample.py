"""A grid in degrees resampled to square metres of its UTM zone, target cell by target cell.

The target grid covers the projected border of the source. Each target centre is carried back by the inverse series and
dealt to the source tile that it falls in; source cells go to their tile and, at its first row and column, to the ones before. So
bare source cells and target cells are exchanged once, and a task holds one source tile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.functions import geodesy as g
from gridsift.operators.tiles import TILE

#: Points on each side of the border that are projected.
SIDE = 20


@dataclass(frozen=True)
class DegreeGrid:
    """rows x cols cells; north and west are the outer edges, steps are positive degrees."""

    rows: int
    cols: int
    north: float
    west: float
    lat_step: float
    lon_step: float


@dataclass(frozen=True)
class Target:
    zone: int
    is_north: bool
    east: float  # the western edge
    north: float  # the northern edge
    cell_m: float
    rows: int
    cols: int


def target_of(spark: SparkSession, grid: DegreeGrid) -> Target:
    """The target grid: zone of the centre, square cells of the source's mean size there, edges at whole cells. The border has 4 SIDE points."""
    lat, lon = grid.north - grid.rows * grid.lat_step / 2, grid.west + grid.cols * grid.lon_step / 2
    lon_m, lat_m = g.metres_per_degree("lat")
    centre = spark.createDataFrame([(lat, lon)], "lat double, lon double").select(F.expr(g.zone("lat", "lon")).alias("zone"), F.expr(f"sqrt({grid.lat_step!r}D * {lat_m} * {grid.lon_step!r}D * {lon_m})").alias("cell")).first()
    height, width = grid.rows * grid.lat_step, grid.cols * grid.lon_step
    border = [(grid.north - a * height, grid.west + b * width) for k in range(SIDE + 1) for t in (k / SIDE,) for a, b in ((0.0, t), (1.0, t), (t, 0.0), (t, 1.0))]
    east, north = g.to_utm("lat", "lon", str(centre["zone"]))
    if lat >= 0:  # a grid across the equator is in the numbers of its centre's side
        north = north.replace("case when lat < 0 then 10000000 else 0 end", "0")
    else:
        north = north.replace("case when lat < 0 then 10000000 else 0 end", "10000000")
    box = spark.createDataFrame(border, "lat double, lon double").select(F.expr(east).alias("e"), F.expr(north).alias("n")).agg(F.min("e").alias("e0"), F.max("e").alias("e1"), F.min("n").alias("n0"), F.max("n").alias("n1")).first()
    cell = centre["cell"]
    west, top = math.floor(box["e0"] / cell) * cell, math.ceil(box["n1"] / cell) * cell
    return Target(centre["zone"], lat >= 0, west, top, cell, math.ceil((top - box["n0"]) / cell - 1e-9), math.ceil((box["e1"] - west) / cell - 1e-9))


def to_utm_grid(cells: DataFrame, grid: DegreeGrid, target: Target, value: str = "z", tile: int = TILE) -> DataFrame:
    """r, c, x, y and value of every cell of the target, bilinear in the source's cells(r, c, value).

    Null where one of the four cells around is unknown or missing, and outside the source.
    """
    spark, n = cells.sparkSession, target.rows * target.cols
    cell = F.lit(target.cell_m)
    own = spark.range(n).select(F.expr(f"id div {target.cols}").alias("r"), (F.col("id") % target.cols).alias("c"))
    own = own.withColumn("x", F.lit(target.east) + (F.col("c") + 0.5) * cell).withColumn("y", F.lit(target.north) - (F.col("r") + 0.5) * cell)
    foot, x = g.from_utm(str(target.zone), "true" if target.is_north else "false", "x", "y")
    own = own.withColumn("_foot", F.expr(foot)).withColumn("_x", F.expr(x))
    lat, lon = g.from_utm_steps(str(target.zone), "_foot", "_x")
    own = own.select("r", "c", "x", "y", ((F.lit(grid.north) - F.expr(lat)) / grid.lat_step - 0.5).alias("v"), ((F.expr(lon) - grid.west) / grid.lon_step - 0.5).alias("u"))
    own = own.withColumn("tr", F.floor(F.col("v") / tile)).withColumn("tc", F.floor(F.col("u") / tile))
    both = lambda k: F.explode(F.array_distinct(F.array(F.floor(F.col(k) / tile), F.floor((F.col(k) - 1) / tile))))
    moved = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("value")).withColumn("tr", both("r")).withColumn("tc", both("c"))

    def run(key: tuple[pa.Scalar, ...], source: pa.Table, wanted: pa.Table) -> pa.Table:
        r0, c0 = (k.as_py() * tile for k in key)
        height = np.full((tile + 1, tile + 1), np.nan)
        height[source["r"].to_numpy() - r0, source["c"].to_numpy() - c0] = source["value"].to_numpy()
        v, u = wanted["v"].to_numpy() - r0, wanted["u"].to_numpy() - c0
        i, j = np.floor(v).astype(int), np.floor(u).astype(int)
        a, b = v - i, u - j
        out = (1 - a) * ((1 - b) * height[i, j] + b * height[i, j + 1]) + a * ((1 - b) * height[i + 1, j] + b * height[i + 1, j + 1])
        return pa.table({k: wanted[k] for k in ("r", "c", "x", "y")} | {value: pa.array(out, pa.float64(), from_pandas=True)})

    return moved.groupBy("tr", "tc").cogroup(own.groupBy("tr", "tc")).applyInArrow(run, f"r long, c long, x double, y double, {value} double")
