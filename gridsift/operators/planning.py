"""Tiles, resuming, run signatures and checks of a run's inputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.operators import sketches

DATUM_TOLERANCE_M, MOST_BELOW = 0.5, 0.05
SECONDS_PER_MILLION = (2.0, 5.0)


def tiles(spark: SparkSession, rows: int, cols: int, tile_px: int) -> DataFrame:
    """index, r0, r1, c0, c1 (half open): near-equal tiles that cover the grid once."""
    n_r, n_c = max(1, -(-rows // tile_px)), max(1, -(-cols // tile_px))
    i, j = F.floor(F.col("id") / n_c), F.col("id") % n_c
    edge = lambda k, n, size: F.bround(F.lit(float(size)) * k / n).cast("long")
    return spark.range(n_r * n_c).select((F.col("id") + 1).alias("index"), edge(i, n_r, rows).alias("r0"), edge(i + 1, n_r, rows).alias("r1"), edge(j, n_c, cols).alias("c0"), edge(j + 1, n_c, cols).alias("c1"))


@F.udtf(returnType="index long, r0 long, r1 long, c0 long, c1 long")
class PlanTiles:
    """plan_tiles(rows, cols, tile_px) in SQL: the tiles of a grid, which may differ from row to row of a lateral join."""

    def eval(self, rows: int, cols: int, tile_px: int):
        if rows is None or cols is None or rows < 1 or cols < 1:
            return
        n_r, n_c = -(-rows // tile_px), -(-cols // tile_px)
        edge = lambda k, n, size: round(size * k / n)
        for i in range(n_r):
            for j in range(n_c):
                yield i * n_c + j + 1, edge(i, n_r, rows), edge(i + 1, n_r, rows), edge(j, n_c, cols), edge(j + 1, n_c, cols)


def register(spark: SparkSession) -> None:
    spark.udtf.register("plan_tiles", PlanTiles)


def tile_of(r: Column, c: Column, rows: int, cols: int, tile_px: int) -> Column:
    """index of the planned tile that a cell lies in, by arithmetic: the edge next to the proportional place is tried on both sides."""

    def place(v: Column, size: int) -> tuple[Column, int]:
        n = max(1, -(-size // tile_px))
        edge = lambda k: F.bround(F.lit(float(size)) * k / n)
        near = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v * n / size)))
        return near - F.when(v < edge(near), 1).otherwise(0) + F.when((v >= edge(near + 1)) & (near < n - 1), 1).otherwise(0), n

    (i, _), (j, n_c) = place(r, rows), place(c, cols)
    return (i * n_c + j + 1).cast("long")


def unfinished(planned: DataFrame, finished: DataFrame) -> DataFrame:
    """Tiles that a resumed run has yet to do."""
    return planned.join(finished.select("index"), "index", "left_anti")


def signature(settings: dict) -> str:
    """Digest of a run's settings, whatever the order of their keys."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:20]


def require_same(stored: str, settings: dict) -> None:
    """A run may be resumed only with the settings that it was begun with."""
    if stored != signature(settings):
        raise ValueError("the stored run has other settings; it cannot be resumed")


def runtime(estimates: DataFrame) -> DataFrame:
    """estimates(cells, tiles) with low_s and high_s."""
    low, high = SECONDS_PER_MILLION
    return estimates.withColumn("low_s", F.round(F.col("cells") / 1e6 * low, 3)).withColumn("high_s", F.round(F.col("cells") / 1e6 * high, 3))


def _samples(cells: DataFrame, every: int) -> DataFrame:
    """r, c, d: surface less ground on a regular sample of the cells."""
    return cells.filter((F.col("r") % every == 0) & (F.col("c") % every == 0)).select("r", "c", (F.col("dsm") - F.col("z")).alias("d")).filter("d is not null and not isnan(d)")


def surface_check(cells: DataFrame, every: int = 5, least: int = 100) -> DataFrame:
    """sampled, p05, below: the low end of surface less ground on a regular sample, and whether it hints at a vertical shift."""
    own = _samples(cells, every)
    p05 = sketches.exact_quantile(own, "d", 0.05)
    out = own.agg(F.count(F.lit(1)).alias("sampled"), F.lit(p05).cast("double").alias("p05"), F.avg((F.col("d") < -DATUM_TOLERANCE_M).cast("double")).alias("below"))
    return out.withColumn("suspicious", (F.col("sampled") >= least) & F.coalesce(F.abs("p05") > DATUM_TOLERANCE_M, F.lit(False)))


def tile_surface(cells: DataFrame, rows: int, cols: int, tile_px: int, every: int = 5, least: int = 1000) -> DataFrame:
    """index, sampled, p05, below, flagged of each planned tile with at least so many samples: a tile is flagged for its low end or for a share of more than 5 % below the ground."""
    own = _samples(cells, every).withColumn("index", tile_of(F.col("r"), F.col("c"), rows, cols, tile_px))
    per = own.groupBy("index").agg(F.count(F.lit(1)).alias("sampled"), F.percentile("d", F.lit(0.05)).alias("p05"), F.avg((F.col("d") < -DATUM_TOLERANCE_M).cast("double")).alias("below"))
    return per.filter(F.col("sampled") >= least).withColumn("flagged", (F.abs("p05") > DATUM_TOLERANCE_M) | (F.col("below") > MOST_BELOW))


def surface_of_run(per_tile: DataFrame) -> DataFrame:
    """tiles, flagged and median_p05 over the tiles of tile_surface. One row; the median of tiles is found without one task for all."""
    median = sketches.exact_quantile(per_tile, "p05", 0.5)
    return per_tile.agg(F.count(F.lit(1)).alias("tiles"), F.count_if("flagged").alias("flagged")).withColumn("median_p05", F.lit(median).cast("double"))


def bilinear(points: DataFrame, cells: DataFrame, height: int, cell_m: float = 1.0) -> DataFrame:
    """points(id, x, y) with z between the four cells around; null where one is unknown."""
    u, v = F.col("x") / cell_m - 0.5, height - F.col("y") / cell_m - 0.5
    own = points.select("id", F.floor(u).alias("c0"), F.floor(v).alias("r0"), (u - F.floor(u)).alias("fx"), (v - F.floor(v)).alias("fy"))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    four = own.withColumn("k", corner).select("id", (F.col("r0") + F.col("k.i")).alias("r"), (F.col("c0") + F.col("k.j")).alias("c"), (F.when(F.col("k.i") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("k.j") == 1, F.col("fx")).otherwise(1 - F.col("fx"))).alias("w"))
    seen = four.join(cells.select("r", "c", "z"), ["r", "c"], "left")
    return seen.groupBy("id").agg(F.when(F.count("z") == 4, F.sum(F.col("w") * F.col("z"))).alias("z"))
