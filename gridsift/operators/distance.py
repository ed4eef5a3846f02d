"""Distance from every cell to the nearest cell of a mask, however far: two passes, along columns and then along rows.

Along a column, the nearest mask cell is above or below: tiles of cells find it by running scans, and what lies beyond a tile
comes from a table with the first and last mask cell of each column in each row of tiles. Along a row, the square of the distance
is the lower envelope of parabolas, one over each column. Both passes exchange each cell once, whatever the distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsift.operators.tiles import TILE

#: Rows that a task takes together in the second pass.
BAND = 32
FAR = np.int64(1) << 40


def _along_columns(cells: DataFrame, mask: DataFrame, tile: int) -> DataFrame:
    """r, c, gap (to the nearest mask cell in the column, in cells) and own (a cell of cells), for the rows of tiles that have cells."""
    at = F.floor(F.col("r") / tile)
    span = cells.agg(F.floor(F.min("r") / tile).alias("low"), F.floor(F.max("r") / tile).alias("high")).first()
    if span["low"] is None:
        return cells.select("r", "c", F.lit(None).cast("long").alias("gap"), F.lit(True).alias("own"))
    ends = mask.groupBy(at.alias("tr"), "c").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    # a row for each column with a mask cell and each row of tiles that has cells
    some = mask.select("c").distinct().select(F.explode(F.sequence(F.lit(span["low"]), F.lit(span["high"]))).alias("tr"), "c")
    column = Window.partitionBy("c").orderBy("tr")
    beyond = some.withColumn("here", F.lit(True)).join(ends, ["tr", "c"], "full").withColumn("up", F.max("last").over(column.rowsBetween(Window.unboundedPreceding, -1))).withColumn("down", F.min("first").over(column.rowsBetween(1, Window.unboundedFollowing)))
    carried = beyond.filter("here").select("tr", "c", F.explode(F.array("up", "down")).alias("r")).filter("r is not null")
    tc = F.floor(F.col("c") / tile)
    rows = cells.select(at.alias("tr"), tc.alias("tc"), "r", "c", F.lit(True).alias("own"))
    rows = rows.unionByName(mask.filter(at.between(span["low"], span["high"])).select(at.alias("tr"), tc.alias("tc"), "r", "c", F.lit(False).alias("own")))
    rows = rows.unionByName(carried.select("tr", tc.alias("tc"), "r", "c", F.lit(False).alias("own")))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r0, c0 = (k.as_py() * tile for k in key)
        r, c, own = table["r"].to_numpy() - r0, table["c"].to_numpy() - c0, table["own"].to_numpy()
        above, below = np.full((tile, tile), -FAR), np.full((tile, tile), FAR)
        kept, there = np.zeros((tile, tile), bool), ~own
        kept[r[own], c[own]] = True
        inside = there & (r >= 0) & (r < tile)
        above[r[inside], c[inside]] = below[r[inside], c[inside]] = r[inside]
        over, under = there & (r < 0), there & (r >= tile)
        np.maximum.at(above, (0, c[over]), r[over])
        np.minimum.at(below, (tile - 1, c[under]), r[under])
        row = np.arange(tile)[:, None]
        gap = np.minimum(row - np.maximum.accumulate(above, axis=0), np.minimum.accumulate(below[::-1], axis=0)[::-1] - row)
        i, j = np.nonzero(kept | (gap < FAR >> 1))
        known = gap[i, j]
        return pa.table({"r": i + r0, "c": j + c0, "gap": pa.array(known, mask=known >= FAR >> 1), "own": kept[i, j]})

    return rows.groupBy("tr", "tc").applyInArrow(run, "r long, c long, gap long, own boolean")


def lower_envelope(squares: np.ndarray) -> np.ndarray:
    """For each row of squares and each place q, the least of (q - p)**2 + squares[p]; infinite where all of a row are.

    All rows go through the places together: each keeps the parabolas that are lowest somewhere, and where the next takes over.
    """
    n, m = squares.shape
    who, start, top = np.zeros((n, m), np.int64), np.full((n, m + 1), np.inf), np.full(n, -1)
    for q in range(m):
        new = np.flatnonzero(np.isfinite(squares[:, q]))
        while len(new):
            some = new[top[new] >= 0]
            p = who[some, top[some]]
            cross = (squares[some, q] + q * q - squares[some, p] - p * p) / (2.0 * (q - p))
            lower = cross <= start[some, top[some]]
            top[some[lower]] -= 1
            put = np.concatenate([new[top[new] < 0], some[~lower]])
            put = np.unique(put)
            first = top[put] < 0
            at = np.full(len(put), -np.inf)
            stay = dict(zip(some[~lower].tolist(), cross[~lower].tolist(), strict=True))
            at[~first] = [stay[i] for i in put[~first].tolist()]
            top[put] += 1
            who[put, top[put]], start[put, top[put]] = q, at
            start[put, top[put] + 1] = np.inf
            new = np.setdiff1d(new, put)
    out, k, rows = np.full((n, m), np.inf), np.zeros(n, np.int64), np.flatnonzero(top >= 0)
    for q in range(m):
        while True:
            ahead = rows[start[rows, k[rows] + 1] < q]
            if not len(ahead):
                break
            k[ahead] += 1
        p = who[rows, k[rows]]
        out[rows, q] = (q - p) ** 2 + squares[rows, p]
    return out


def to_mask(cells: DataFrame, mask: DataFrame, cell_m: float = 1.0, tile: int = TILE, band: int = BAND) -> DataFrame:
    """r, c, distance of each of cells(r, c) to the nearest of mask(r, c), centre to centre; null if the mask is empty.

    Cells and mask may have gaps and repeated rows, and mask cells need not be among the cells. A task of the second pass holds `band` rows of the grid, whatever their length.
    """
    there = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    gaps = _along_columns(there, mask.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct(), tile)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r, c, own = table["r"].to_numpy(), table["c"].to_numpy(), table["own"].to_numpy()
        r0, c0 = key[0].as_py() * band, int(c.min())
        squares = np.full((band, int(c.max()) - c0 + 1), np.inf)
        gap = table["gap"].to_numpy().astype(float)
        squares[r - r0, c - c0] = np.where(np.isnan(gap), np.inf, gap * gap)
        found = lower_envelope(squares)[r[own] - r0, c[own] - c0]
        return pa.table({"r": r[own], "c": c[own], "distance": pa.array(np.sqrt(found) * cell_m, mask=np.isinf(found))})

    return gaps.groupBy(F.floor(F.col("r") / band).alias("band")).applyInArrow(lambda key, t: run(key, t), "r long, c long, distance double")
