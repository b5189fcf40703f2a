"""Which boxes of two tables overlap, by an equi-join on grid cells.

A box belongs to the level of the power of two that is at least its longer side, and touches four cells of that size at most.
Two boxes meet at the larger of their levels; so each side is dealt to its own level and to the other side's larger ones, of
which there are few. What shares a cell is checked exactly, and a pair counts in one cell only: that of the lower left corner
of what both cover. There is no cell size to choose, and boxes of any sizes may be mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level() -> Column:
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1e-9))
    return F.ceil(F.log2(side)).cast("int")


def _dealt(boxes: DataFrame, own: str, levels: list[int], inclusive: bool, on: list[str], prefix: str) -> DataFrame:
    """Boxes at their own level and at those of levels that are larger (or equal)."""
    more = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v >= F.col("_l") if inclusive else v > F.col("_l"))
    rows = boxes.withColumn("_l", _level()).withColumn("_m", F.explode(F.array_union(F.array("_l"), more)))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_m")))
    spread = rows.withColumn("_cx", F.explode(F.sequence(cell("xmin"), cell("xmax")))).withColumn("_cy", F.explode(F.sequence(cell("ymin"), cell("ymax"))))
    return spread.select(own, *on, "_m", "_cx", "_cy", F.col("_l").alias(f"{prefix}_l"), *[F.col(n).alias(f"{prefix}_{n}") for n in ("xmin", "ymin", "xmax", "ymax")])


def overlap_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: list[str] | None = None) -> DataFrame:
    """left_key and right_key of every two boxes (xmin, ymin, xmax, ymax) that share an area and agree in the columns ``on``,
    each pair once. Boxes with nulls, or without an area, overlap nothing. Two small jobs find the levels of either side."""
    on = on or []
    sound = (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))
    left, right = left.where(sound).select(left_key, *on, "xmin", "ymin", "xmax", "ymax"), right.where(sound).select(right_key, *on, "xmin", "ymin", "xmax", "ymax")
    levels = [sorted(r[0] for r in side.select(_level().alias("v")).distinct().collect()) for side in (left, right)]
    a = _dealt(left, left_key, levels[1], True, on, "a")
    b = _dealt(right, right_key, levels[0], False, on, "b")
    met = a.join(b, [*on, "_m", "_cx", "_cy"]).where(F.col("_m") == F.greatest("a_l", "b_l"))
    low = {n: F.greatest(f"a_{n}min", f"b_{n}min") for n in "xy"}
    shares = [low[n] < F.least(f"a_{n}max", f"b_{n}max") for n in "xy"]
    here = [F.floor(low[n] / F.pow(F.lit(2.0), F.col("_m"))) == F.col(f"_c{n}") for n in "xy"]
    return met.where(shares[0] & shares[1] & here[0] & here[1]).select(left_key, right_key)
