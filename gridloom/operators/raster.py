"""Rasters as rows: pixels, tiles, windows, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_bands(pixels: DataFrame, bands: list[int]) -> DataFrame:
    """Bands in the order asked for, numbered anew; a band may come twice, none means all."""
    if not bands:
        return pixels
    wanted = pixels.where(F.col("band").isin(bands))  # reaches the scan
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for i, b in enumerate(bands, 1)])
    own = wanted.withColumn("_at", F.explode(F.filter(places, lambda p: p["b"] == F.col("band"))))
    return own.withColumn("band", F.col("_at.i")).drop("_at")


def cut_window(pixels: DataFrame, planned: DataFrame) -> DataFrame:
    """The pixels of each source's window, counted from its corner."""
    w = planned.select("src_idx", "xoff", "yoff", "xsize", "ysize")
    inside = F.col("col").between(F.col("xoff"), F.col("xoff") + F.col("xsize") - 1) & F.col("row").between(F.col("yoff"), F.col("yoff") + F.col("ysize") - 1)
    return pixels.join(w, "src_idx").where(inside).select("src_idx", "band", (F.col("row") - F.col("yoff")).alias("row"), (F.col("col") - F.col("xoff")).alias("col"), "value")


def fill_window(window: DataFrame, planned: DataFrame, bands: list[int]) -> DataFrame:
    """Every pixel of the windows; missing ones get the source's nodata, else 0."""
    grid = planned.withColumns({"row": F.explode(F.sequence(F.lit(0).cast("long"), F.col("ysize") - 1))}).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xsize") - 1))).select("src_idx", "row", "col", "nodata", F.explode(F.array(*map(F.lit, bands))).alias("band"))
    return grid.join(window, ["src_idx", "band", "row", "col"], "left").select("src_idx", "band", "row", "col", F.coalesce("value", "nodata", F.lit(0.0)).alias("value"))


def to_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """(src_idx, band, ty, tx, data): a tile's values by place within it, absent ones left out. Written as Parquet sorted
    by these columns, a window's predicates on ty, tx and band prune row groups."""
    place = (F.col("row") % tile) * tile + F.col("col") % tile
    return pixels.groupBy("src_idx", "band", F.expr(f"row div {tile}").alias("ty"), F.expr(f"col div {tile}").alias("tx")).agg(F.array_sort(F.collect_list(F.struct(place.cast("int").alias("at"), "value"))).alias("data"))


def from_tiles(tiles: DataFrame, tile: int) -> DataFrame:
    rows = tiles.select("src_idx", "band", "ty", "tx", F.explode("data").alias("p"))
    return rows.select("src_idx", "band", (F.col("ty") * tile + F.expr(f"p.at div {tile}")).alias("row"), (F.col("tx") * tile + F.col("p.at") % tile).alias("col"), F.col("p.value").alias("value"))


def read_window(tiles: DataFrame, planned: DataFrame, tile: int, bands: list[int]) -> DataFrame:
    """A window straight from tiles, counted from its corner: only the tiles and bands that it touches are unpacked. Tiles
    are matched by source, row and column, so a source of many tiles isn't one key."""
    span = lambda off, size: F.sequence(F.expr(f"{off} div {tile}"), F.expr(f"({off} + {size} - 1) div {tile}"))
    cover = planned.select("src_idx", "xoff", "yoff", "xsize", "ysize", F.explode(span("yoff", "ysize")).alias("ty")).withColumn("tx", F.explode(span("xoff", "xsize")))
    touched = tiles.where(F.col("band").isin(bands)).join(cover, ["src_idx", "ty", "tx"])
    pixels = touched.select("src_idx", "band", "ty", "tx", "xoff", "yoff", "xsize", "ysize", F.explode("data").alias("p"))
    row, col = F.col("ty") * tile + F.expr(f"p.at div {tile}") - F.col("yoff"), F.col("tx") * tile + F.col("p.at") % tile - F.col("xoff")
    placed = pixels.select("src_idx", "band", row.alias("row"), col.alias("col"), F.col("p.value").alias("value"), "xsize", "ysize")
    return select_bands(placed.where("row >= 0 and row < ysize and col >= 0 and col < xsize").drop("xsize", "ysize"), bands)


def to_numpy(dense_cells: DataFrame, width: int, height: int, bands: int, most_bytes: float = 1e9, fill: float = float("nan")):
    """bands x height x width, fill where there is no cell; raises before anything is collected if that is larger than most_bytes."""
    import numpy as np

    if width * height * bands * 8 > most_bytes:
        raise MemoryError(f"the array would take {width * height * bands * 8} bytes")
    rows = dense_cells.select("band", "orow", "ocol", "value").toPandas()
    out = np.full((bands, height, width), fill)
    out[rows.band - 1, rows.orow, rows.ocol] = rows.value
    return out
