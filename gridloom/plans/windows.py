"""Window planning: which pixels of which level of each source a request needs. One row a source; no pixel is read.

A catalog has src, src_idx, width, height, n_bands, dtype, nodata, crs, gt (struct gt0..gt5) and levels (array of struct
level, width, height, tile_width, tile_height, the full resolution first).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import crs as projections
from gridloom.functions.metadata import extent, grid_signature, number, sample_bytes
from gridloom.operators.overlap import overlap_pairs
from gridloom.plans.spec import OutGrid, WarpSpec


def flat(catalog: DataFrame) -> DataFrame:
    """The sixteen columns that describe a source."""
    e, first = extent(F.col("gt"), F.col("width"), F.col("height")), F.get("levels", F.lit(0))
    return catalog.select("src", "width", "height", "n_bands", "dtype", "nodata", "crs", F.abs("gt.gt1").alias("res_x"), F.abs("gt.gt5").alias("res_y"), *[e[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax")], F.size("levels").alias("n_levels"), first["tile_width"].alias("tile_width"), first["tile_height"].alias("tile_height"))


def summary(catalog: DataFrame) -> DataFrame:
    """What the sources share (null: it varies), how many values there are, and the joint extent if there is one CRS."""
    rows = flat(catalog)
    shared = [F.when(F.count_distinct(c) == 1, F.min(c)).alias(f"shared_{c}") for c in ("width", "height", "n_bands", "dtype", "crs")]
    one = F.count_distinct("crs") == 1
    return rows.agg(F.count("*").alias("n_sources"), *shared, F.count_distinct("nodata").alias("n_nodata"), *[F.when(one, f(c)).alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])


def described(catalog: DataFrame, most_names: int = 8) -> DataFrame:
    """Eight facts of each source as text: size, megapixels, bands, resolution, crs, nodata, overviews, band names (the
    first ones, then how many more)."""
    x, y = number(F.abs("gt.gt1")), number(F.abs("gt.gt5"))
    sizes = F.array_join(F.transform("levels", lambda v: F.concat(v["width"].cast("string"), F.lit("x"), v["height"].cast("string"))), ", ")
    n = F.size("band_names")
    names = F.concat(F.array_join(F.slice("band_names", 1, most_names), ", "), F.when(n > most_names, F.concat(F.lit(" and "), (n - most_names).cast("string"), F.lit(" more"))).otherwise(""))
    return catalog.select(
        "src", "src_idx", F.format_string("%d x %d", "width", "height").alias("size"), F.round(F.col("width") * F.col("height") / 1e6, 1).alias("megapixels"),
        F.concat(F.col("n_bands").cast("string"), F.lit(" "), F.col("dtype")).alias("bands"), F.when(x == y, x).otherwise(F.concat(x, F.lit(" x "), y)).alias("resolution"),
        F.coalesce("crs", F.lit("<none>")).alias("crs"), F.coalesce(number(F.col("nodata")), F.lit("<none>")).alias("nodata"),
        F.concat((F.size("levels") - 1).cast("string"), F.lit(" ("), sizes, F.lit(")")).alias("overviews"), names.alias("band_names"),
    )


def densified(extents: DataFrame, source: str, target: str, per_edge: int = 21) -> DataFrame:
    """id and extent of each row (id, xmin, ymin, xmax, ymax) in another system, over sampled edges."""
    s = F.col("s") / (per_edge - 1)
    edges = extents.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1))))
    x, y = F.col("xmin") + s * (F.col("xmax") - F.col("xmin")), F.col("ymin") + s * (F.col("ymax") - F.col("ymin"))
    points = edges.select("id", F.explode(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, F.col("ymin")), (x, F.col("ymax")), (F.col("xmin"), y), (F.col("xmax"), y))])).alias("p"))
    u, v = projections.transform(source, target, F.col("p.x"), F.col("p.y"))
    return points.groupBy("id").agg(F.min(u).alias("xmin"), F.min(v).alias("ymin"), F.max(u).alias("xmax"), F.max(v).alias("ymax"))


def pick_level(levels: Column, decimation: Column) -> Column:
    """The coarsest level that is at least as fine as the output; 1 if the output is finer than the source."""
    full = F.get(levels, F.lit(0))["width"]
    fits = F.filter(levels, lambda x: (full / x["width"]) <= decimation)
    return F.when(decimation.isNull() | F.isnan(decimation) | (decimation < 1), 1).otherwise(F.coalesce(F.array_max(F.transform(fits, lambda x: x["level"])), F.lit(1)))


def _box(values: tuple) -> Column:
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), values, strict=True)])


def extents(catalog: DataFrame, spec: WarpSpec) -> DataFrame:
    """The catalog with two extents a row: ``want``, what is asked of a source, in its own system, and ``target``, the same
    in the output's. te is in te_srs, else t_srs, else the source's system; the output's is t_srs, else the source's. Where x
    repeats with every turn, ``step`` is a turn and ``turn`` says at which one the source meets what is wanted: a row for
    each, so a source may have two."""
    own = extent(F.col("gt"), F.col("width"), F.col("height"))
    rows, names = _extents(catalog, spec, own)
    steps = {n: projections.turn(n) for n in names}
    steps = {n: t for n, t in steps.items() if t}
    zero = F.lit(0).cast("int")
    if spec.te is None or not steps:
        return rows.withColumns({"step": F.lit(0.0), "turn": zero})
    crs = projections.normalised(F.col("crs"))
    rows = rows.withColumn("step", F.coalesce(*[F.when(crs == n, F.lit(t)) for n, t in steps.items()], F.lit(0.0)))
    reach = lambda a, b: (own[a] - F.col(f"want.{b}")) / F.nullif("step", F.lit(0.0))
    first, last = F.floor(reach("xmin", "xmax") + 1e-9) + 1, F.ceil(reach("xmax", "xmin") - 1e-9) - 1
    met = F.when(first <= last, F.sequence(first, last)).otherwise(F.array(F.lit(0).cast("long")))
    turns = F.explode(F.array_union(F.array(zero), F.coalesce(met, F.array(F.lit(0).cast("long"))).cast("array<int>")))
    rows = rows.withColumn("turn", turns)
    moved = [F.col(f"want.{n}") + (F.col("step") * F.col("turn") if n[0] == "x" else 0.0) for n in ("xmin", "ymin", "xmax", "ymax")]
    return rows.withColumn("want", F.struct(*[m.alias(n) for m, n in zip(moved, ("xmin", "ymin", "xmax", "ymax"), strict=True)]))


def _extents(catalog: DataFrame, spec: WarpSpec, own: Column) -> tuple[DataFrame, list[str]]:
    """want and target at turn 0, and the systems of the sources as far as they matter."""
    t_srs, te_srs = spec.t_srs and projections.normalise(spec.t_srs), spec.te_srs and projections.normalise(spec.te_srs)
    given = te_srs or t_srs
    if spec.te is None and t_srs is None:
        return catalog.withColumns({"want": own, "target": own}), []
    if given is None:
        return catalog.withColumns({"want": _box(spec.te), "target": _box(spec.te)}), []
    catalog, found = projections.canonical(catalog)
    names = [n for n in found if n is not None]
    if spec.te is None:
        return projections.with_image(catalog, "target", own, names or [t_srs], t_srs).withColumn("want", own), names
    images = projections.boxes(catalog.sparkSession, spec.te, given, list({*names, *([t_srs] if t_srs else []), given}))
    crs = projections.normalised(F.col("crs"))
    want = F.coalesce(*[F.when(crs == n, _box(images[n])) for n in names], _box(images[given]))
    return catalog.withColumns({"want": want, "target": _box(images[t_srs]) if t_srs else want}), names


def problem(spec: WarpSpec) -> Column:
    """Why a source of the catalog can't be planned, null if it can."""
    most = max(spec.bands, default=0)
    return (
        F.when(F.col("gt.gt0").isNull() | F.col("gt.gt1").isNull(), F.concat(F.lit("no georeference in "), F.col("src")))
        .when(F.col("crs").isNull(), F.concat(F.lit("no coordinate system in "), F.col("src")))
        .when(F.col("n_bands") < most, F.concat(F.lit(f"no band {most} in "), F.col("src")))
    )


def plan(catalog: DataFrame, spec: WarpSpec, strict: bool = True) -> DataFrame:
    """src_idx, level, xoff, yoff, xsize, ysize, the window's transform (win_gt), is_copy, n_bytes, over_limit, sig and turn of
    each source that the request overlaps; a source without overlap has no row, and one that it meets at two turns (across
    the antimeridian) has two. win_gt is at the request's turn. A request without te wants whole sources.
    A source without georeference, system or a band that is asked for raises, or has no row if not strict (see problem)."""
    unfit = problem(spec)
    sound = catalog.where(F.when(unfit.isNotNull(), F.raise_error(unfit).cast("boolean")).otherwise(F.lit(True)) if strict else unfit.isNull())
    same = F.lit(True) if spec.t_srs is None else projections.normalised(F.col("crs")) == projections.normalise(spec.t_srs)
    rows = extents(sound, spec)  # with the systems' normal names, if these matter
    return _windows(rows.withColumn("copy", same & F.lit(spec.tr is None and spec.ts is None)), spec)


def plan_requests(catalog: DataFrame, requests: DataFrame, spec: WarpSpec) -> DataFrame:
    """plan() of many requests at once: req_idx, xmin, ymin, xmax, ymax of each, in the system that it shares with the sources
    it is for (``crs``, if requests have it, else all sources'). A row for each request and source that overlap; they are
    found by grid cells (operators.overlap), so neither side is read by the driver or meets the other as a whole. te, t_srs
    and te_srs of spec aren't looked at; with tr or ts it says how large the cells are."""
    sound = catalog.where(problem(spec).isNull())
    e = extent(F.col("gt"), F.col("width"), F.col("height"))
    on = ["crs"] if "crs" in requests.columns else []
    boxes_ = ("xmin", "ymin", "xmax", "ymax")
    own = sound.select("src_idx", *on, *[e[n].alias(n) for n in boxes_])
    pairs = overlap_pairs(requests.select("req_idx", *on, *boxes_), own, "req_idx", "src_idx", on)
    asked = pairs.join(requests.select("req_idx", F.struct(*boxes_).alias("want")), "req_idx")
    rows = sound.join(asked, "src_idx").withColumns({"target": F.col("want"), "step": F.lit(0.0), "turn": F.lit(0), "copy": F.lit(spec.tr is None and spec.ts is None)})
    return _windows(rows, spec, ["req_idx"])


def _windows(rows: DataFrame, spec: WarpSpec, keys: list[str] | None = None) -> DataFrame:
    """The windows of rows that have want and target."""
    gt = F.col("gt")
    det = gt["gt1"] * gt["gt5"] - gt["gt2"] * gt["gt4"]
    col = lambda x, y: (gt["gt5"] * (x - gt["gt0"]) - gt["gt2"] * (y - gt["gt3"])) / det
    row = lambda x, y: (gt["gt1"] * (y - gt["gt3"]) - gt["gt4"] * (x - gt["gt0"])) / det
    corners = [(F.col(f"want.{a}"), F.col(f"want.{b}")) for a in ("xmin", "xmax") for b in ("ymin", "ymax")]
    cols, lines = [col(*p) for p in corners], [row(*p) for p in corners]
    rows = rows.withColumns({"c0": F.least(*cols), "c1": F.greatest(*cols), "r0": F.least(*lines), "r1": F.greatest(*lines)})
    # Output cell size in source units, over the source's cell size; the x axis decides.
    target_span, source_span = F.col("target.xmax") - F.col("target.xmin"), F.col("want.xmax") - F.col("want.xmin")
    cell = F.lit(float(spec.tr[0])) if spec.tr else target_span / spec.ts[0] if spec.ts else F.lit(None).cast("double")
    decimation = cell * F.when(target_span != 0, source_span / target_span).otherwise(1.0) / F.abs(gt["gt1"])
    forced = F.greatest(F.lit(1), F.least(F.size("levels"), F.lit(spec.overview)))
    level = forced if spec.overview else pick_level(F.col("levels"), F.round(decimation, 9))
    rows = rows.withColumn("level", level.cast("int")).withColumn("lv", F.get("levels", F.col("level") - 1))
    margin = F.when(F.col("copy"), 0).otherwise(spec.margin)
    rows = rows.withColumns({"fx": F.col("width") / F.col("lv.width"), "fy": F.col("height") / F.col("lv.height"), "m": margin})
    lo = lambda v, f: F.greatest(F.lit(0), F.floor(F.round(F.col(v) / F.col(f), 9)) - F.col("m"))
    hi = lambda v, f, most: F.least(F.col(most), F.ceil(F.round(F.col(v) / F.col(f), 9)) + F.col("m"))
    rows = rows.withColumns({"xoff": lo("c0", "fx"), "yoff": lo("r0", "fy"), "xend": hi("c1", "fx", "lv.width"), "yend": hi("r1", "fy", "lv.height")})
    # A plain filter on these would be pushed down and repeat all the arithmetic; this one stays where it is.
    overlap = F.filter(F.array(F.lit(True)), lambda _: (F.col("xend") > F.col("xoff")) & (F.col("yend") > F.col("yoff")))
    rows = rows.withColumn("overlaps", F.explode_outer(overlap)).where("overlaps is not null")
    rows = rows.withColumns({"xsize": F.col("xend") - F.col("xoff"), "ysize": F.col("yend") - F.col("yoff")})
    # The columns of a transform scale by fx (gt1, gt4) and fy (gt2, gt5): a level's pixel covers fx by fy pixels.
    scaled = {"gt1": gt["gt1"] * F.col("fx"), "gt2": gt["gt2"] * F.col("fy"), "gt4": gt["gt4"] * F.col("fx"), "gt5": gt["gt5"] * F.col("fy")}
    origin = lambda o, a, b: gt[o] + F.col("xoff") * scaled[a] + F.col("yoff") * scaled[b]
    win = {"gt0": origin("gt0", "gt1", "gt2") - F.col("step") * F.col("turn"), "gt3": origin("gt3", "gt4", "gt5"), **scaled}
    return rows.select(
        *(keys or []), "src", "src_idx", "level", *[F.col(c).cast("long").alias(c) for c in ("xoff", "yoff", "xsize", "ysize")],
        F.struct(*[win[f"gt{i}"].alias(f"gt{i}") for i in range(6)]).alias("win_gt"), F.col("copy").alias("is_copy"), "nodata", *_costs(spec),
        grid_signature(gt, F.col("crs"), F.col("levels")).alias("sig"), F.col("lv.tile_width").alias("tile_width"), F.col("lv.tile_height").alias("tile_height"), "n_bands", "dtype", "crs", "turn",
    )


def _costs(spec: WarpSpec) -> list[Column]:
    """n_bytes of a window at its source's own sample type, and whether that is over the limit."""
    n = F.lit(len(spec.bands)) if spec.bands else F.col("n_bands")
    size = (F.col("xsize") * F.col("ysize") * n * sample_bytes(F.col("dtype"))).cast("long")
    return [size.alias("n_bytes"), (size > spec.max_bytes).alias("over_limit")]


def plan_by_grid(catalog: DataFrame, spec: WarpSpec) -> DataFrame:
    """plan(), computed once for each distinct grid and joined back. What depends on a source's bands, sample type, nodata
    or tiles stays its own."""
    own = catalog.withColumn("sig", grid_signature(F.col("gt"), F.col("crs"), F.col("levels")))
    grids = own.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("src", "src_idx", "width", "height", "dtype", "nodata", "gt", "crs", "levels")], F.max("n_bands").alias("n_bands"))
    windows = plan(grids.drop("sig"), spec).select("sig", "level", "xoff", "yoff", "xsize", "ysize", "win_gt", "is_copy", "turn")
    rows = own.select("src", "src_idx", "nodata", "n_bands", "dtype", "crs", "levels", "sig").join(windows, "sig")
    lv = F.get("levels", F.col("level") - 1)
    return rows.select(*windows.columns, "src", "src_idx", "nodata", "n_bands", "dtype", "crs", *_costs(spec), lv["tile_width"].alias("tile_width"), lv["tile_height"].alias("tile_height"))


def as_catalog(planned: DataFrame) -> DataFrame:
    """The planned windows as rasters of their own: what was read of a window lies on its transform, at the level that was
    picked, and is counted from its corner."""
    return planned.select("src", "src_idx", F.col("xsize").cast("int").alias("width"), F.col("ysize").cast("int").alias("height"), "n_bands", "dtype", "nodata", "crs", F.col("win_gt").alias("gt"), "turn")


def output_grid(catalog: DataFrame, spec: WarpSpec) -> OutGrid:
    """The output grid of a request over a catalog. te comes in te_srs and goes to t_srs (else the first source's system);
    without te it is the joint extent of all sources there. Without tr and ts cells are square, and as many along an
    extent's diagonal as the finest source has pixels there. One small aggregation over the catalog."""
    if not spec.t_srs:
        first = catalog.agg(F.min_by("crs", "src_idx")).first()[0]
        if first is None:
            raise ValueError("no source, or no coordinate system")
        spec = replace(spec, t_srs=projections.normalise(first))
    whole = extents(catalog, replace(spec, te=None))
    e = lambda n: F.col(f"target.{n}")
    diagonal = F.sqrt((e("xmax") - e("xmin")) ** 2 + (e("ymax") - e("ymin")) ** 2) / F.sqrt(F.col("width") ** 2 + F.col("height") ** 2)
    *te, finest = whole.agg(F.min(e("xmin")), F.min(e("ymin")), F.max(e("xmax")), F.max(e("ymax")), F.min(diagonal)).first()
    if te[0] is None:
        raise ValueError("no source gives an extent")
    if spec.te is not None:
        t_srs = projections.normalise(spec.t_srs)
        te = projections.boxes(catalog.sparkSession, spec.te, projections.normalise(spec.te_srs or spec.t_srs), [t_srs])[t_srs]
    cells = {} if spec.tr or spec.ts else {"tr": (finest, finest), "tap": False}
    return replace(spec, te=tuple(te), te_srs=None, **cells).grid()


def plan_on_grid(catalog: DataFrame, spec: WarpSpec) -> tuple[DataFrame, OutGrid]:
    """The output grid and the windows on it. They are planned in the grid's system, whatever the sources': levels follow from
    the cells there, not from which source comes first; and tap may have moved the extent."""
    grid = output_grid(catalog, spec)
    te = (grid.xmin, grid.ymax - grid.height * grid.yres, grid.xmin + grid.width * grid.xres, grid.ymax)
    return plan(catalog, replace(spec, te=None if spec.te is None else te, te_srs=None, t_srs=grid.crs)), grid


def require_one_grid(catalog: DataFrame) -> None:
    """For requests that plan once for all: raises if the sources don't share one grid. Looks at the catalog only."""
    if catalog.select(grid_signature(F.col("gt"), F.col("crs"), F.col("levels")).alias("s")).distinct().limit(2).count() > 1:
        raise ValueError("the sources must share one grid")


def require_overlap(planned: DataFrame) -> DataFrame:
    if planned.isEmpty():
        raise ValueError("the request does not overlap any source")
    return planned


def require_limit(planned: DataFrame) -> DataFrame:
    """Raises if a window would take more bytes than the request allows. Looks at the plan only."""
    over = planned.where("over_limit").select("src", "n_bytes").head()
    if over is not None:
        raise MemoryError(f"the window of {over.src} would take {over.n_bytes} bytes; ask for fewer bands or larger cells, or raise max_bytes")
    return planned


def tile_cover(planned: DataFrame) -> DataFrame:
    """A row for each tile that a window touches, with the level's grid of tiles numbered from 0."""
    tx = F.sequence(F.floor(F.col("xoff") / F.col("tile_width")), F.floor((F.col("xoff") + F.col("xsize") - 1) / F.col("tile_width")))
    ty = F.sequence(F.floor(F.col("yoff") / F.col("tile_height")), F.floor((F.col("yoff") + F.col("ysize") - 1) / F.col("tile_height")))
    return planned.withColumn("ty", F.explode(ty)).withColumn("tx", F.explode(tx)).select("src_idx", "level", "ty", "tx")
