"""Moving windows over the grid in square tiles, as array operations on one tile at a time.

A cell goes to its own tile and, near an edge, to the tiles whose windows reach it. So one exchange moves the bare
cells, (1 + 2 reach / tile)**2 rows for each, and all windows of a step follow from it; putting window rows together by
aggregation moves a row of all partial sums for every row of the disk instead. A task holds one tile at a time,
whatever the size of the grid. Cells may be missing; they are unknown, like cells whose value is null or not a number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


def in_tiles(cells: DataFrame, values: list[str], reach: int, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], names: list[str], tile: int = TILE) -> DataFrame:
    """r, c and the columns names of work's result for every cell: work maps arrays of values to arrays of the same shape.

    An array covers a tile and reach cells around it; unknown is NaN there and null in the result.
    """
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    moved = cells.select("r", "c", *values).withColumn("tr", spread("r")).withColumn("tc", spread("c"))
    size = tile + 2 * reach

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        r, c = (rows[x].to_numpy() - (k.as_py() * tile - reach) for x, k in zip(("r", "c"), key, strict=True))
        arrays = {}
        for v in values:
            arrays[v] = np.full((size, size), np.nan)
            arrays[v][r, c] = rows[v].to_numpy()
        own = (np.minimum(r, c) >= reach) & (np.maximum(r, c) < reach + tile)
        with np.errstate(all="ignore"):
            out = work(arrays)
        return pa.table({x: rows[x].filter(pa.array(own)) for x in ("r", "c")} | {x: pa.array(out[x][r[own], c[own]], pa.float64(), from_pandas=True) for x in names})

    return moved.groupBy("tr", "tc").applyInArrow(run, "r long, c long, " + ", ".join(f"{x} double" for x in names))


def row_sums(values: np.ndarray, widths: set[int], power: int = 0) -> dict[int, np.ndarray]:
    """width w -> the sum over the columns d = -w .. w beside each cell of d**power times the value."""
    n, most = values.shape[1], max(widths)
    wide = np.pad(values, ((0, 0), (most, most)))
    total, out = (values if power == 0 else np.zeros_like(values)), {}
    for w in range(most + 1):
        if w:
            total = total + (float((-w) ** power) * wide[:, most - w : most - w + n] + float(w**power) * wide[:, most + w : most + w + n])
        if w in widths:
            out[w] = total
    return out


def stacked(rows: dict[int, np.ndarray], span: dict[int, int], power: int = 0) -> np.ndarray:
    """The sum over the rows dr of a disk of (-dr)**power times the row's sum; span: dr -> width."""
    most = max(map(abs, span))
    out = np.zeros_like(next(iter(rows.values())))
    padded = {w: np.pad(x, ((most, most), (0, 0))) for w, x in rows.items()}
    for dr, w in span.items():
        out += float((-dr) ** power) * padded[w][most + dr : most + dr + len(out)]
    return out


def largest(values: np.ndarray, span: dict[int, int]) -> np.ndarray:
    """The largest known value over the spans around each cell; NaN where none is known."""
    widths, n, most, high = set(span.values()), values.shape[1], max(span.values()), max(map(abs, span))
    known = np.where(np.isnan(values), -np.inf, values)
    wide = np.pad(known, ((high, high), (most, most)), constant_values=-np.inf)
    top, rows = wide[:, most : most + n], {}
    for w in range(most + 1):
        if w:
            top = np.maximum(top, np.maximum(wide[:, most - w : most - w + n], wide[:, most + w : most + w + n]))
        if w in widths:
            rows[w] = top
    out = np.full_like(known, -np.inf)
    for dr, w in span.items():
        np.maximum(out, rows[w][high + dr : high + dr + len(out)], out=out)
    return np.where(np.isinf(out), np.nan, out)


def counted(known: np.ndarray, span: dict[int, int]) -> np.ndarray:
    return stacked(row_sums(known.astype(float), set(span.values())), span)


def moments(z: np.ndarray, span: dict[int, int], cell_m: float) -> dict[str, np.ndarray]:
    """The ten moments of z over the spans: x is east and y north of the cell, in metres."""
    known, m = (~np.isnan(z)).astype(float), cell_m
    z = np.where(np.isnan(z), 0.0, z)
    widths = set(span.values())
    k, kx, v, vx = row_sums(known, widths), row_sums(known, widths, 1), row_sums(z, widths), row_sums(z, widths, 1)
    return {
        "n": stacked(k, span), "sx": stacked(kx, span) * m, "sy": stacked(k, span, 1) * m,
        "sxx": stacked(row_sums(known, widths, 2), span) * m * m, "syy": stacked(k, span, 2) * m * m, "sxy": stacked(kx, span, 1) * m * m,
        "sz": stacked(v, span), "sxz": stacked(vx, span) * m, "syz": stacked(v, span, 1) * m, "szz": stacked(row_sums(z * z, widths), span),
    }
