"""Warping: from source pixels to an output grid.

Pixels are rows (src_idx, band, row, col, value). Two plans give the same values:

``scatter`` is for sources whose axes are parallel to the output's, in its coordinate system: each pixel goes straight to
the few output cells it contributes to, and one aggregation with map-side partial sums makes the cells. There is no
join. The wide kernels (cubic, cubicspline, lanczos) run as two passes, columns then rows, so a pixel makes tens of rows
rather than hundreds.

``gather`` is for everything else: the output cells under each source are mapped back to source coordinates, their taps
are joined with the pixels by position, and aggregated. Bands ride on the pixels' side of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import crs as projections
from gridloom.functions.metadata import extent
from gridloom.operators.resample import FOOTPRINT, LEAST_OVERLAP, LOBES, REACH, combine, kernel, weighted_mean
from gridloom.plans.spec import OutGrid

CELL = ["src_idx", "band", "orow", "ocol"]


def valid(pixels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pixels that aren't nodata of their source (NaN equals NaN), with the source's transform. Pixels that carry both
    already, as a reader's do, aren't joined."""
    own = pixels if {"gt", "nodata"} <= set(pixels.columns) else pixels.join(catalog.select("src_idx", "gt", "nodata"), "src_idx")
    return own.where(F.col("value").isNotNull() & (F.col("nodata").isNull() | (F.col("value") != F.col("nodata")))).drop("nodata")


def _q(x: Column) -> Column:
    return F.round(x, 9)


def _axis(rows: DataFrame, pixel: str, out: str, weight: str, off: Column, ratio: Column, n: int, method: str) -> DataFrame:
    """A row for each output index to which a pixel index contributes, with its weight along this axis."""
    stretch = F.greatest(F.lit(1.0), F.abs(ratio))
    reach = F.lit(0.5) if method == "near" else F.abs(ratio) / 2 + 0.5 if method in FOOTPRINT else stretch * REACH[method]
    c = F.col(pixel)
    ends = [(c + 0.5 + sign * reach - off) / ratio - 0.5 for sign in (-1, 1)]
    lo, hi = F.greatest(F.lit(0).cast("long"), F.floor(F.least(*ends)) - 1), F.least(F.lit(n - 1).cast("long"), F.ceil(F.greatest(*ends)) + 1)
    rows = rows.where(lo <= hi).withColumn(out, F.explode(F.sequence(lo, hi)))
    o = F.col(out)
    if method == "near":
        return rows.where(F.floor(_q(off + (o + 0.5) * ratio)) == c).withColumn(weight, F.lit(1.0))
    if method in FOOTPRINT:
        a, b = _q(off + o * ratio), _q(off + (o + 1) * ratio)
        return rows.withColumn(weight, F.least(c + 1, F.greatest(a, b)) - F.greatest(c, F.least(a, b))).where(F.col(weight) > LEAST_OVERLAP)
    return rows.withColumn(weight, kernel(method, F.abs(c + 0.5 - _q(off + (o + 0.5) * ratio)) / stretch)).where(F.col(weight) != 0)


def scatter(pixels: DataFrame, catalog: DataFrame, grid: OutGrid, method: str = "near") -> DataFrame:
    """(src_idx, band, orow, ocol, value) of the output cells that have a contributor."""
    rows, gt = valid(pixels, catalog), F.col("gt")
    x = ((F.lit(grid.xmin) - gt["gt0"]) / gt["gt1"], F.lit(grid.xres) / gt["gt1"], grid.width)
    y = ((F.lit(grid.ymax) - gt["gt3"]) / gt["gt5"], F.lit(-grid.yres) / gt["gt5"], grid.height)
    rows = _axis(rows, "col", "ocol", "wx", *x, method)
    if REACH.get(method, 0) >= 2:
        windows = ["turn"] if "turn" in rows.columns else []  # a source may be met at two turns
        rows = rows.groupBy("src_idx", *windows, "band", "row", "ocol").agg(F.sum(F.col("wx") * F.col("value")).alias("s"), F.sum("wx").alias("n"), *([F.sum(F.abs("wx")).alias("size")] if method in LOBES else []), F.first("gt").alias("gt"))
        rows = _axis(rows, "row", "orow", "wy", *y, method)
        return weighted_mean(rows, CELL, method, F.col("wy") * F.col("s"), F.col("wy") * F.col("n"), F.abs("wy") * F.col("size"))
    rows = _axis(rows, "row", "orow", "wy", *y, method).withColumn("w", F.col("wx") * F.col("wy"))
    return combine(rows, CELL, method)


def cell_blocks(catalog: DataFrame, grid: OutGrid, source: str | None, reach: int, side: int = 64) -> DataFrame:
    """src_idx, gt, width, height, turn and the cells r0..r1, c0..c1 of each block of ``side`` x ``side`` output cells under
    the extent of each source of one coordinate system, which is widened by ``reach`` source pixels and a cell. Where the
    grid's x repeats with every turn, at each of them that the grid has."""
    e = extent(F.col("gt"), F.col("width"), F.col("height"))
    turn = "turn" if "turn" in catalog.columns else F.lit(0).alias("turn")
    rows = catalog.select("src_idx", "crs", "gt", "width", "height", turn).withColumn("e", e)
    if source is not None and grid.crs is not None:
        target, step = projections.normalise(grid.crs), projections.turn(projections.normalise(grid.crs))
        key = rows.select("*", F.col("src_idx").alias("_own"), F.struct("src_idx", "turn").alias("_key")).drop("src_idx").withColumnRenamed("_key", "src_idx")
        rows = projections.with_image(key.drop("e"), "e", e, [projections.normalise(source)], target).drop("src_idx").withColumnRenamed("_own", "src_idx")
        if projections.parameters(projections.normalise(source)).kind == "longlat" and projections.parameters(target).kind == "merc":
            # Beyond a pole there is no bound: cells come ever closer to it.
            beyond = {"ymin": F.when(e["ymin"] <= -90, -1e15), "ymax": F.when(e["ymax"] >= 90, 1e15)}
            rows = rows.withColumn("e", F.struct(*[F.coalesce(beyond.get(n, F.lit(None)), F.col(f"e.{n}")).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]))
        if step:
            first, last = F.ceil((F.lit(grid.xmin) - F.col("e.xmax")) / step - 1e-9), F.floor((F.lit(grid.xmin + grid.width * grid.xres) - F.col("e.xmin")) / step + 1e-9)
            rows = rows.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array(F.lit(0).cast("long")))))
            moved = [(F.col(f"e.{n}") + F.col("_k") * step if n[0] == "x" else F.col(f"e.{n}")).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]
            rows = rows.withColumn("e", F.struct(*moved))
    lo = lambda v, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n).cast("long"), F.floor(v) - 1))
    hi = lambda v, n: F.least(F.lit(n - 1).cast("long"), F.ceil(v) + 1)
    # What a kernel reaches beyond the extent, in output cells; it stretches if these are larger than source pixels.
    px, py = [reach * F.greatest(F.lit(1.0), (F.col(f"e.{a}max") - F.col(f"e.{a}min")) / F.col(n) / res) for a, n, res in (("x", "width", grid.xres), ("y", "height", grid.yres))]
    c0, c1 = lo((F.col("e.xmin") - grid.xmin) / grid.xres - px, grid.width), hi((F.col("e.xmax") - grid.xmin) / grid.xres + px, grid.width)
    r0, r1 = lo((grid.ymax - F.col("e.ymax")) / grid.yres - py, grid.height), hi((grid.ymax - F.col("e.ymin")) / grid.yres + py, grid.height)
    under = rows.select("src_idx", "gt", "width", "height", "turn", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))
    steps = lambda a, b: F.explode_outer(F.when(F.col(a) <= F.col(b), F.sequence(F.expr(f"{a} div {side}"), F.expr(f"{b} div {side}"))))
    blocks = under.withColumn("br", steps("r0", "r1")).where("br is not null").withColumn("bc", steps("c0", "c1")).where("bc is not null")
    at = lambda a, f, v: f(F.col(a), F.col(v))
    cut = {"r0": at("r0", F.greatest, "br0"), "r1": at("r1", F.least, "br1"), "c0": at("c0", F.greatest, "bc0"), "c1": at("c1", F.least, "bc1")}
    return blocks.withColumns({"br0": F.col("br") * side, "br1": (F.col("br") + 1) * side - 1, "bc0": F.col("bc") * side, "bc1": (F.col("bc") + 1) * side - 1}).withColumns(cut).select("src_idx", "gt", "width", "height", "turn", "r0", "r1", "c0", "c1", "br", "bc")


def cells(catalog: DataFrame, grid: OutGrid, source: str | None, reach: int) -> DataFrame:
    """The cells of cell_blocks(), each once for each source and turn. Blocks are dealt to tasks before cells are made of them,
    so a large source's cells, and the formulas that take them back, are spread."""
    keys = ["src_idx", "turn", "br", "bc"]
    blocks = cell_blocks(catalog, grid, source, reach)
    if source is not None and grid.crs is not None and projections.turn(projections.normalise(grid.crs)):  # turns may overlap
        blocks = blocks.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("gt", "width", "height")], F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    dealt = blocks.repartition(int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.withColumn("orow", F.explode(F.sequence("r0", "r1"))).withColumn("ocol", F.explode(F.sequence("c0", "c1"))).select("src_idx", "turn", "gt", "width", "height", "orow", "ocol")


def _gather_one(pixels: DataFrame, catalog: DataFrame, grid: OutGrid, method: str, source: str | None) -> DataFrame:
    out, gt = cells(catalog, grid, source, REACH.get(method, 0)), F.col("gt")
    det = gt["gt1"] * gt["gt5"] - gt["gt2"] * gt["gt4"]

    def back(dx: float, dy: float) -> tuple[Column, Column]:
        x, y = grid.xmin + (F.col("ocol") + dx) * grid.xres, grid.ymax - (F.col("orow") + dy) * grid.yres
        if source is not None and grid.crs is not None:
            x, y = projections.transform(grid.crs, source, x, y)
        return _q((gt["gt5"] * (x - gt["gt0"]) - gt["gt2"] * (y - gt["gt3"])) / det), _q((gt["gt1"] * (y - gt["gt3"]) - gt["gt4"] * (x - gt["gt0"])) / det)

    u, v = back(0.5, 0.5)
    out = out.withColumns({"u": u, "v": v})
    if method in FOOTPRINT:
        corners = [back(i, j) for i in (0.0, 1.0) for j in (0.0, 1.0)]
        out = out.withColumns({"u0": F.least(*[c[0] for c in corners]), "u1": F.greatest(*[c[0] for c in corners]), "v0": F.least(*[c[1] for c in corners]), "v1": F.greatest(*[c[1] for c in corners])})
        spans = [(F.floor("u0"), F.ceil("u1") - 1), (F.floor("v0"), F.ceil("v1") - 1)]
    elif method == "near":
        spans = [(F.floor("u"), F.floor("u")), (F.floor("v"), F.floor("v"))]
    else:
        # Cell sizes over source pixel sizes, from the cell's own sides.
        (ua, va), (ub, vb) = back(0.0, 0.5), back(1.0, 0.5)
        (uc, vc), (ud, vd) = back(0.5, 0.0), back(0.5, 1.0)
        out = out.withColumns({"sx": F.greatest(F.lit(1.0), _q(F.greatest(F.abs(ub - ua), F.abs(ud - uc)))), "sy": F.greatest(F.lit(1.0), _q(F.greatest(F.abs(vb - va), F.abs(vd - vc))))})
        spans = [(F.floor(F.col(p) - 0.5 - REACH[method] * F.col(s)), F.ceil(F.col(p) - 0.5 + REACH[method] * F.col(s))) for p, s in (("u", "sx"), ("v", "sy"))]
    (c0, c1), (r0, r1) = [(F.greatest(F.lit(0).cast("long"), a), F.least(F.col(n).cast("long") - 1, b)) for (a, b), n in zip(spans, ("width", "height"), strict=True)]
    # Cells without taps go after they are made: a filter before would be pushed down and repeat the formulas.
    out = out.withColumns({"c0": c0, "c1": c1, "r0": r0, "r1": r1})
    within = lambda a, b: F.explode_outer(F.when(F.col(a) <= F.col(b), F.sequence(a, b)))
    taps = out.withColumn("row", within("r0", "r1")).where("row is not null").withColumn("col", within("c0", "c1")).where("col is not null")
    if method in FOOTPRINT:
        over = lambda c, a, b: F.least(F.col(c) + 1, F.col(b)) - F.greatest(F.col(c), F.col(a))
        taps = taps.withColumns({"wx": over("col", "u0", "u1"), "wy": over("row", "v0", "v1")}).where((F.col("wx") > LEAST_OVERLAP) & (F.col("wy") > LEAST_OVERLAP)).withColumn("w", F.col("wx") * F.col("wy"))
    elif method == "near":
        taps = taps.withColumn("w", F.lit(1.0))
    else:
        taps = taps.withColumn("w", kernel(method, F.abs(F.col("col") + 0.5 - F.col("u")) / F.col("sx")) * kernel(method, F.abs(F.col("row") + 0.5 - F.col("v")) / F.col("sy"))).where("w <> 0")
    keys = ["src_idx", *(["turn"] if "turn" in pixels.columns else []), "row", "col"]
    taps = taps.select(*keys, "orow", "ocol", "w")
    # Spark's size check doesn't count what explode() makes of a catalog's row, so taps would be broadcast however many they
    # are. They are the streamed side: of a pixel with many taps its bands are held, not the taps.
    return combine(taps.hint("merge").join(valid(pixels, catalog).drop("gt"), keys), CELL, method)


def gather(pixels: DataFrame, catalog: DataFrame, grid: OutGrid, method: str = "near") -> DataFrame:
    """As scatter(), for any transform and any pair of supported systems. Each system among the sources is a branch; a
    source without one raises if the grid has one."""
    if grid.crs is None:
        return _gather_one(pixels, catalog, grid, method, None)
    catalog, names = projections.canonical(catalog)
    if None in names:
        raise ValueError("a source has no coordinate system")
    crs = projections.normalised(F.col("crs"))
    parts = [_gather_one(pixels, catalog.where(crs == n), grid, method, n) for n in names or [projections.normalise(grid.crs)]]
    return reduce(DataFrame.unionByName, parts)


def warp_windows(pixels: DataFrame, windows: DataFrame, grid: OutGrid, method: str = "near") -> DataFrame:
    """scatter() of the windows that lie parallel to the grid in its own system, gather() of all others."""
    if grid.crs is None:
        return gather(pixels, windows, grid, method)
    windows, _ = projections.canonical(windows)
    parallel = (projections.normalised(F.col("crs")) == projections.normalise(grid.crs)) & (F.col("gt.gt2") == 0) & (F.col("gt.gt4") == 0)
    straight, other = windows.agg(F.bool_or(parallel), F.bool_or(~F.coalesce(parallel, F.lit(False)))).first()
    if not other:
        return scatter(pixels, windows, grid, method)
    if not straight:
        return gather(pixels, windows, grid, method)
    parts = [f(pixels.join(w.select("src_idx"), "src_idx", "left_semi"), w, grid, method) for f, w in ((scatter, windows.where(parallel)), (gather, windows.where(~F.coalesce(parallel, F.lit(False)))))]
    return parts[0].unionByName(parts[1])


def mosaic(warped: DataFrame) -> DataFrame:
    """(band, orow, ocol, value): of overlapping sources the last one's valid value."""
    return warped.groupBy("band", "orow", "ocol").agg(F.max_by("value", "src_idx").alias("value"))


def dense(values: DataFrame, grid: OutGrid, bands: list[int], init: float | None = None) -> DataFrame:
    """Every cell of the grid; cells without a value get init (0 if there is none)."""
    spark = values.sparkSession
    all_cells = spark.range(grid.width * grid.height).select(F.expr(f"id div {grid.width}").alias("orow"), (F.col("id") % grid.width).alias("ocol"), F.explode(F.array(*map(F.lit, bands))).alias("band"))
    return all_cells.join(values.select("band", "orow", "ocol", "value"), ["band", "orow", "ocol"], "left").select("band", "orow", "ocol", F.coalesce("value", F.lit(float(init or 0))).alias("value"))


def covered_blocks(catalog: DataFrame, grid: OutGrid, block: int = 256) -> DataFrame:
    """br, bc of the blocks of ``block`` x ``block`` cells that lie under a source (or window), a cell more on each side: an
    index of where a grid has anything at all, from the catalog alone. Systems as in gather()."""
    if grid.crs is None:
        parts = [cell_blocks(catalog, grid, None, 0, block)]
    else:
        catalog, names = projections.canonical(catalog)
        if None in names:
            raise ValueError("a source has no coordinate system")
        parts = [cell_blocks(catalog.where(F.col("crs") == n), grid, n, 0, block) for n in names] or [cell_blocks(catalog, grid, grid.crs, 0, block)]
    return reduce(DataFrame.unionByName, parts).select("br", "bc").distinct()


def dense_blocks(values: DataFrame, covered: DataFrame, grid: OutGrid, bands: list[int], init: float | None = None, block: int = 256) -> DataFrame:
    """As dense(), for the covered blocks only: cells are made, and filled, where a source can have some."""
    dealt = covered.repartition(int(covered.sparkSession.conf.get("spark.sql.shuffle.partitions")), "br", "bc")
    side = lambda b, most: F.explode(F.sequence(F.col(b) * block, F.least((F.col(b) + 1) * block, F.lit(most)) - 1))
    made = dealt.withColumn("orow", side("br", grid.height)).withColumn("ocol", side("bc", grid.width)).select("orow", "ocol", F.explode(F.array(*map(F.lit, bands))).alias("band"))
    return made.join(values.select("band", "orow", "ocol", "value"), ["band", "orow", "ocol"], "left").select("band", "orow", "ocol", F.coalesce("value", F.lit(float(init or 0))).alias("value"))
