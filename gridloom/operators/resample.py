"""The fourteen resampling methods, as kernel expressions and aggregations.

u is a coordinate in source pixels, quantised to nine decimals (transcendental functions differ in the last bits between
engines); the centre of pixel c is c + 0.5. Kernels stretch by the ratio of cell sizes when the output is coarser.
Weights are renormalised over valid pixels. Order statistics and the mode take the pixels that overlap the output cell
unweighted; of values as frequent, the one that comes first by row and column is the mode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half-widths of the interpolating kernels, in pixels.
REACH = {"bilinear": 1, "cubic": 2, "cubicspline": 2, "lanczos": 3}
FOOTPRINT = ("average", "rms", "sum", "min", "max", "med", "q1", "q3", "mode")
QUANTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}
#: Kernels with negative lobes, whose weights may cancel out.
LOBES = ("cubic", "lanczos")
#: Overlaps below this many pixels are rounding, as is what is left of weights that cancel out to below this part of them.
LEAST_OVERLAP = 1e-9


def kernel(method: str, d: Column) -> Column:
    """Weight at a distance d >= 0 in (stretched) pixels; 0 from the half-width on."""
    d2, d3 = d * d, d * d * d
    if method == "bilinear":
        inner = 1 - d
    elif method == "cubic":  # Keys 1981, a = -0.5
        inner = F.when(d <= 1, 1.5 * d3 - 2.5 * d2 + 1).otherwise(-0.5 * d3 + 2.5 * d2 - 4 * d + 2)
    elif method == "cubicspline":  # Hou and Andrews 1978
        inner = F.when(d < 1, 2 / 3 - d2 + d3 / 2).otherwise((2 - d) * (2 - d) * (2 - d) / 6)
    else:  # lanczos, three lobes (Duchon 1979)
        x = d * math.pi
        inner = F.when(d == 0, 1.0).otherwise(F.sin(x) / x * F.sin(x / 3) / (x / 3))
    return F.when(d < REACH[method], inner).otherwise(0.0)


def weighted_mean(rows: DataFrame, keys: list[str], method: str, s: Column, n: Column, size: Column) -> DataFrame:
    """Sum of s over sum of n, the weights, for each key, however small these are; a key whose weights cancel out has no
    value. size is the weights' magnitude, of which only kernels with negative lobes need the sum."""
    sums = rows.groupBy(*keys).agg(F.sum(s).alias("s"), F.sum(n).alias("n"), *([F.sum(size).alias("size")] if method in LOBES else []))
    kept = sums.where(F.abs("n") > LEAST_OVERLAP * F.col("size")) if method in LOBES else sums
    return kept.select(*keys, (F.col("s") / F.col("n")).alias("value"))


def combine(weighted: DataFrame, keys: list[str], method: str) -> DataFrame:
    """One value for each key from rows (keys, row, col, value, w) of valid pixels, with partial aggregation."""
    if method in ("average", *REACH):
        return weighted_mean(weighted, keys, method, F.col("w") * F.col("value"), F.col("w"), F.abs("w"))
    if method == "rms":
        return weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("value") * F.col("value")) / F.sum("w")).alias("value"))
    if method == "sum":
        return weighted.groupBy(*keys).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    if method in ("min", "max"):
        return weighted.groupBy(*keys).agg(getattr(F, method)("value").alias("value"))
    if method in QUANTILES:
        return weighted.groupBy(*keys).agg(F.expr(f"percentile_disc({QUANTILES[method]}) WITHIN GROUP (ORDER BY value)").alias("value"))
    if method == "mode":
        found = weighted.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min(F.struct("row", "col")).alias("at"))
        return found.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("n"), F.col("at"))).alias("value"))
    return weighted.groupBy(*keys).agg(F.first("value").alias("value"))  # near: one pixel for each key
