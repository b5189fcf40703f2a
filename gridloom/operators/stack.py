"""Stacking: each source's bands become bands of their own in one output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.warp import gather
from gridloom.plans.spec import OutGrid, methods_for


def band_offsets(catalog: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The number of bands of the sources before each, within a stack."""
    before = Window.partitionBy(*(group or [])).orderBy("src_idx").rowsBetween(Window.unboundedPreceding, -1)
    return catalog.withColumn("band_offset", F.coalesce(F.sum("n_bands").over(before), F.lit(0)))


def stem(src: Column) -> Column:
    """A source's file name without query string and extension."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(src, r"\?.*$", ""), r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")


def label(src: Column, n_bands: Column, band: Column) -> Column:
    """A band's label: its source's stem, and the band's number if there are several."""
    return F.when(n_bands == 1, stem(src)).otherwise(F.concat(stem(src), F.lit("_b"), band.cast("string")))


def labels(catalog: DataFrame, group: list[str] | None = None) -> DataFrame:
    """out_band and label of every band of a stack; sources of several bands count them."""
    each = band_offsets(catalog, group).withColumn("band", F.explode(F.sequence(F.lit(1), F.col("n_bands"))))
    name = label(F.col("src"), F.col("n_bands"), F.col("band"))
    return each.select(*(group or []), "src_idx", "band", (F.col("band_offset") + F.col("band")).cast("long").alias("out_band"), name.alias("label"))


def label_list(catalog: DataFrame, total: int, own: list[str] | None = None) -> list[str]:
    """The labels of a stack's bands in order: one's own, which must be as many, or those of labels()."""
    if own is not None and len(own) != total:
        raise ValueError(f"{len(own)} labels for {total} bands")
    return own if own is not None else [r.label for r in labels(catalog).orderBy("out_band").collect()]


def stack(pixels: DataFrame, catalog: DataFrame, grid: OutGrid, r: str | list[str] | None = None, warp=gather) -> DataFrame:
    """(band, orow, ocol, value) with renumbered bands; r is a method or one for each source, in order of src_idx."""
    methods = methods_for(r, catalog.count() if isinstance(r, list) and len(r) > 1 else 1)
    numbered = catalog.withColumn("_n", F.row_number().over(Window.orderBy("src_idx")) - 1) if len(methods) > 1 else catalog.withColumn("_n", F.lit(0))
    parts = []
    for m in dict.fromkeys(methods):  # one branch for each distinct method
        own = numbered.where(F.col("_n").isin([i for i, x in enumerate(methods) if x == m])).drop("_n") if len(methods) > 1 else numbered.drop("_n")
        parts.append(warp(pixels.join(own.select("src_idx"), "src_idx", "left_semi"), own, grid, m))
    warped = reduce(DataFrame.unionByName, parts)
    return warped.join(band_offsets(catalog).select("src_idx", "band_offset"), "src_idx").select((F.col("band") + F.col("band_offset")).cast("long").alias("band"), "orow", "ocol", "value")
