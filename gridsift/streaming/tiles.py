"""A run over tiles as a stream of tile numbers, whose progress is the stream's own checkpoint.

The plan lies in files, a step of tiles in each. Each batch takes one, and writes its sites under the number of the batch, so that a batch that is
done again after a failure replaces what it wrote. More tiles can be added to the plan at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.operators import planning, runs, storage
from gridsift.sources.profiles import Aircraft, Mission

TILE = "index long, r0 long, r1 long, c0 long, c1 long"


def plan(tiles: DataFrame, folder: str, per_step: int) -> None:
    """Add tiles(index, r0, r1, c0, c1) to the plan, per_step of them in a file."""
    tiles.repartitionByRange("index").sortWithinPartitions("index").write.mode("append").option("maxRecordsPerFile", per_step).parquet(f"{folder}/plan")


def run(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Work off the tiles of the plan that no finished batch had: work maps a table of tiles to rows with their index."""
    stream = spark.readStream.schema(TILE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/plan")

    def step(tiles: DataFrame, batch: int) -> None:
        tiles = spark.createDataFrame(tiles.collect(), TILE)  # a step of tiles
        with storage.scratch():
            work(tiles).write.mode("overwrite").parquet(f"{folder}/sites/batch={batch}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def screen(spark: SparkSession, cells: DataFrame, rows: int, cols: int, aircraft: Aircraft, mission: Mission, folder: str, tile_px: int, per_step: int = 64, removed: DataFrame | None = None) -> DataFrame:
    """runs.screen as a stream: the same sites. A folder that has a plan is gone on with, if profiles, grid and the content of all inputs are the same."""
    folder = folder.rstrip("/")
    planned = planning.tiles(spark, rows, cols, tile_px)
    began = storage.exists(spark, f"{folder}/plan/_SUCCESS")
    runs.TiledRun(spark, folder, runs.settings_of(cells, rows, cols, aircraft, mission, tile_px, removed), planned)  # refuses other inputs
    if not began:
        storage.delete(spark, f"{folder}/plan")
        plan(planned, folder, per_step)
    run(spark, folder, lambda tiles: runs.sites_of(tiles, cells, rows, cols, tile_px, aircraft, mission, removed))
    kind = f"{runs.SITES}, index long, batch long"
    return runs.kept_apart(spark.read.schema(kind).option("basePath", f"{folder}/sites").parquet(f"{folder}/sites").drop("batch"), aircraft, mission).select("r", "c", *[F.col(c) for c in ("x", "y", "elevation", "slope", "aspect", "roughness", "tdp_obstacle", "ring_obstacle", "ring_coverage", "upslope", "quality", "place")])
