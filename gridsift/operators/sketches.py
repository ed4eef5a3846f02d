"""Distinct counts and quantiles from sketches that are stored by group and merged, and exact quantiles without one task for all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers (as a power of 2) of a distinct-count sketch, and its stated error: three times 1.04 / sqrt(2**14).
REGISTERS, DISTINCT_ERROR = 14, 0.025
#: Size of a quantile sketch, and its stated error of rank.
K, RANK_ERROR = 400, 0.01
#: Ranks around the wanted one, as a share, that a pass of the exact quantile keeps, and the different values that end it.
NARROW, FEW = 0.01, 10_000


def distinct_sketches(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and sketch: what a table of counts keeps of each group; sketches of groups can be merged by any coarser grouping."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(value), REGISTERS).alias("sketch"))


def distinct_of(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by and estimate: distinct values of merged sketches, within DISTINCT_ERROR."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def quantile_sketches(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n and sketch of the values of each group; null and not-a-number are left out."""
    known = F.when(~F.isnan(value), F.col(value))
    return rows.filter(known.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value), F.lit(K)).alias("sketch"))


def quantile_of(sketches: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """by, n and estimate: the value whose rank is q, within RANK_ERROR of the rank, of merged sketches."""
    merged = sketches.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"))
    return merged.select(*(by or []), "n", F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("estimate"))


def exact_quantile(rows: DataFrame, value: str, q: float) -> float | None:
    """The q-quantile of value, interpolated between its neighbours; null for no values.

    Each pass sketches the values between the bounds so far and takes narrower ones around the rank, which are checked by counting; when at most FEW
    different values are between them, those decide. Values are never gathered in one task.
    """
    known = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = known.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not ends["n"]:
        return None
    place, below, low, high = q * (ends["n"] - 1), 0, ends["low"], ends["high"]
    first, second = int(place), min(int(place) + 1, ends["n"] - 1)
    while True:
        between = known.filter(F.col("v").between(low, high))
        values = between.groupBy("v").agg(F.count(F.lit(1)).alias("m"))
        few = values.limit(FEW + 1).collect()
        if len(few) <= FEW:
            break
        margin, narrower = NARROW, None
        state = between.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(K)).alias("s"))
        while narrower is None and margin < 1:
            at = lambda p: F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, p))))
            middle = (place - below) / state.first()["n"]
            a, b = state.select(at(middle - margin), at(middle + margin)).first()
            under, upto = between.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
            if below + under <= first and second < below + upto and (a > low or b < high):
                narrower = (a, b, below + under)
            margin *= 4
        if narrower is None:  # nothing to go by but the values themselves
            few = values.collect()
            break
        low, high, below = narrower
    picked, upto = [], below
    for v, m in sorted((r["v"], r["m"]) for r in few):
        picked += [v] * (upto <= first < upto + m) + [v] * (upto <= second < upto + m)
        upto += m
    return picked[0] + (picked[1] - picked[0]) * (place - first)
