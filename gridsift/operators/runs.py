"""Screening runs over tiles that can be stopped at any time and taken up again.

A run has a folder: its state (a digest of the settings, of the content of all inputs and of the plan of tiles), the sites of each tile, partitioned by
tile, and the list of finished tiles. A step does some tiles that are not finished; tiles that were written but not yet
listed are written again. Tiles do not depend on each other, so a resumed run ends like one that was never stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.operators import candidates, classify, digests, planning, spatial, storage, terrain
from gridsift.sources.profiles import Aircraft, Mission


#: Columns of a tile's sites besides the tile's index, by which they are partitioned.
SITES = "r long, c long, x double, y double, elevation double, slope double, aspect double, roughness double, tdp_obstacle double, ring_obstacle double, ring_coverage double, upslope boolean, quality double"


class TiledRun:
    """The folder of a run; opening it with other settings than it was begun with is an error."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict, planned: DataFrame):
        self.spark, self.folder, self.planned = spark, folder.rstrip("/"), planned
        state = f"{self.folder}/state"
        if storage.exists(spark, state):
            planning.require_same(spark.read.json(state).first()["signature"], settings)
        else:
            spark.createDataFrame([(planning.signature(settings), planned.count())], "signature string, tiles long").coalesce(1).write.json(state)

    def finished(self) -> DataFrame:
        """index of the finished tiles."""
        path = f"{self.folder}/finished"
        return self.spark.read.schema("index long").parquet(path) if storage.exists(self.spark, path) else self.spark.createDataFrame([], "index long")

    def todo(self, most: int) -> DataFrame:
        """The next tiles that are not finished, most at most."""
        return planning.unfinished(self.planned, self.finished()).orderBy("index").limit(most)

    def save(self, tiles: DataFrame, sites: DataFrame) -> None:
        """Write sites(index, ...) of these tiles, then list the tiles as finished."""
        sites.repartition("index").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index").parquet(f"{self.folder}/sites")
        tiles.select("index").coalesce(1).write.mode("append").parquet(f"{self.folder}/finished")

    def sites(self) -> DataFrame:
        """The sites of all finished tiles; a run none of whose tiles has a site has no rows."""
        path, kind = f"{self.folder}/sites", f"{SITES}, index long"
        found = self.spark.read.schema(kind).parquet(path) if storage.exists(self.spark, path) else self.spark.createDataFrame([], kind)
        return found.join(self.finished(), "index", "left_semi")


def sites_of(tiles: DataFrame, cells: DataFrame, rows: int, cols: int, tile_px: int, aircraft: Aircraft, mission: Mission, removed: DataFrame | None = None) -> DataFrame:
    """The sites that each of tiles(index, r0, r1, c0, c1) of the plan has by itself: index and the attributes of candidates.

    Only cells that the tiles' windows may reach are read. removed(r, c) are cells that are excluded.
    """
    span = tiles.agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).first()
    halo = terrain.halo_px(aircraft)
    near = cells.filter(F.col("r").between(span["r0"] - halo, span["r1"] + halo) & F.col("c").between(span["c0"] - halo, span["c1"] + halo))
    classes = classify.classify(terrain.analyze(near, aircraft), aircraft, mission)
    classes = classes if removed is None else classify.remove(classes, removed, 8)
    found = candidates.checked(near, classes, aircraft, mission).withColumn("index", planning.tile_of(F.col("r"), F.col("c"), rows, cols, tile_px))
    found = found.join(F.broadcast(tiles.select("index")), "index", "left_semi")  # the tiles of one step
    return candidates.select_apart(found, near, aircraft, mission, within="index")


def settings_of(cells: DataFrame, rows: int, cols: int, aircraft: Aircraft, mission: Mission, tile_px: int, removed: DataFrame | None = None, inputs: dict[str, DataFrame] | None = None) -> dict:
    """All that a run's results depend on: profiles, grid, and digests of the content of cells, excluded cells and other named inputs, in whatever order their rows come."""
    content = {"cells": digests.text_of(cells, ["r", "c", "x", "y", "z", "dsm"]), "removed": digests.text_of(removed, ["r", "c"])}
    content |= {name: digests.text_of(df) for name, df in (inputs or {}).items()}
    return {"aircraft": vars(aircraft), "mission": vars(mission), "rows": rows, "cols": cols, "tile_px": tile_px, "content": content}


def screen(
    spark: SparkSession, cells: DataFrame, rows: int, cols: int, aircraft: Aircraft, mission: Mission, folder: str, tile_px: int, per_step: int = 64, steps: int | None = None,
    removed: DataFrame | None = None, inputs: dict[str, DataFrame] | None = None, progress: Callable[[int, int], None] | None = None, tag: str | None = None,
) -> DataFrame | None:
    """The run's sites, those of different tiles kept apart, best first; None if it was stopped after so many steps.

    The run's folder must be one that the driver and executors share. It can be taken up again only with equal profiles,
    grid and content of all inputs; inputs are tables that the caller derived removed or cells from (obstacles, centres). progress
    is called with the numbers of finished and of all tiles, before the first step and after each. With a tag, the jobs of the run
    carry it, so that another thread can stop them by the context's cancelJobsWithTag; what was finished stays, and the run can be taken up again.
    """
    if tag:
        spark.sparkContext.addJobTag(tag)
    try:
        run = TiledRun(spark, folder, settings_of(cells, rows, cols, aircraft, mission, tile_px, removed, inputs), planning.tiles(spark, rows, cols, tile_px))
        planned = run.planned.count()
        while True:
            if progress:
                progress(run.finished().count(), planned)
            tiles = spark.createDataFrame(run.todo(per_step).collect(), "index long, r0 long, r1 long, c0 long, c1 long")  # per_step rows
            if tiles.isEmpty():
                break
            if steps is not None and steps <= 0:
                return None
            with storage.scratch():
                run.save(tiles, sites_of(tiles, cells, rows, cols, tile_px, aircraft, mission, removed))
            steps = steps - 1 if steps is not None else None
        return kept_apart(run.sites(), aircraft, mission)
    finally:
        if tag:
            spark.sparkContext.removeJobTag(tag)


def kept_apart(sites: DataFrame, aircraft: Aircraft, mission: Mission) -> DataFrame:
    """Sites of all tiles, none closer to a better one than the separation, with their place, best first."""
    apart = aircraft.tdp_diameter_m * mission.minimum_candidate_separation_factor
    found = sites.withColumn("id", F.col("r") * F.lit(1 << 31) + F.col("c")).withColumn("worse", -F.col("quality"))
    kept = spatial.suppress(found, apart - 1e-6, ["worse"])
    place = F.row_number().over(Window.orderBy("worse", "id"))  # sites, which are capped by tile
    return kept.withColumn("place", place).filter(F.col("place") <= mission.max_candidates).drop("id", "worse", "index")
