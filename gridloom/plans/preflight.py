"""A request tried out before any tile is read: what would fail, by source, from the catalog alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import crs as projections
from gridloom.functions.metadata import grid_signature
from gridloom.plans.spec import WarpSpec
from gridloom.plans.windows import problem


def _own_fault(catalog: DataFrame, spec: WarpSpec) -> Column:
    """What a source's header says against it."""
    gt, src = F.col("gt"), F.col("src")
    unread = F.col("error") if "error" in catalog.columns else F.lit(None).cast("string")
    flat = F.coalesce(F.abs(gt["gt1"] * gt["gt5"] - gt["gt2"] * gt["gt4"]), F.lit(0.0)) == 0
    strips = F.exists("levels", lambda v: v["tile_width"].isNull() | v["tile_height"].isNull())
    more = F.when(flat, F.concat(F.lit("a transform that can't be inverted in "), src)).when(strips, F.concat(F.lit("no tiles in "), src))
    return F.coalesce(unread, problem(spec), more)


def preflight(catalog: DataFrame, spec: WarpSpec, most: int = 1000) -> DataFrame:
    """src_idx, src and error (null: none) of every source, at most ``most`` systems among them.

    Each distinct grid stands in as 4 x 4 points, which are taken to the output's system and back: a grid none of whose points
    has an image there, or whose points come back more than a pixel off, would warp to nothing, or to the wrong place. Besides
    that: files that couldn't be read (a catalog that isn't strict), no georeference or one that can't be inverted, no system
    or an unknown one, bands that are missing, strips, and requests whose extent has no image in the source's system. The
    output's system is t_srs, else that of the first source without a fault of its own. No tile is read; beyond two small
    lookups of systems this is one job, whose formulas run once a grid and not once a source."""
    system = projections.normalised(F.col("crs"))
    own = catalog.select("src_idx", "src", "crs", "gt", "width", "height", "levels", _own_fault(catalog, spec).alias("fault"))
    raw = [r[0] for r in own.where("fault is null").select(system.alias("n")).distinct().limit(most + 1).collect()]
    if len(raw) > most:
        raise ValueError(f"the sources have more than {most} coordinate systems")
    known: dict[str, str] = {}
    unknown: list[str] = []
    for name in raw:
        try:
            known[name] = projections.normalise(name)
        except ValueError:
            unknown.append(name)
    strange = F.when(system.isin(unknown), F.concat(F.lit("an unknown coordinate system in "), F.col("src"))) if unknown else F.lit(None).cast("string")
    names = sorted(set(known.values()))
    normal = F.coalesce(*[F.when(system == n, F.lit(to)) for n, to in known.items()], F.lit(None).cast("string"))
    own = own.withColumns({"fault": F.coalesce("fault", strange), "system": normal, "sig": grid_signature(F.col("gt"), F.col("crs"), F.col("levels"))})
    sound = own.where("fault is null")
    first = None if spec.t_srs else sound.agg(F.min_by("system", "src_idx")).first()[0]
    target = projections.normalise(spec.t_srs) if spec.t_srs else first
    if not names or target is None:
        return own.select("src_idx", "src", F.col("fault").alias("error"))
    out = own.select("src_idx", "src", "sig", "system", "fault").join(_grids(sound, names, target), "sig", "left")
    asked = F.lit(None).cast("string")
    if spec.te is not None:
        images = projections.boxes(catalog.sparkSession, spec.te, projections.normalise(spec.te_srs) if spec.te_srs else target, names)
        blind = [n for n, box in images.items() if None in box]
        asked = F.when(F.col("system").isin(blind), F.concat(F.lit("the request's extent has no image in the system of "), F.col("src"))) if blind else asked
    tried = F.when(F.col("n_shown") == 0, F.concat(F.lit(f"no image in {target} of "), F.col("src"))).when(F.col("n_off") > 0, F.concat(F.lit(f"an image in {target} that doesn't lead back to "), F.col("src")))
    return out.select("src_idx", "src", F.coalesce("fault", tried, asked).alias("error"))


def _grids(sound: DataFrame, names: list[str], target: str) -> DataFrame:
    """sig, n_shown and n_off: of a grid's 16 points, how many have an image, and how many of these come back elsewhere."""
    gt = F.col("gt")
    keep = ["sig", "system", "x", "y", "dx", "dy"]
    grids = sound.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("gt", "width", "height", "system")])
    at = [(i + 0.5) / 4 for i in range(4)]
    places = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in at for b in at]))
    points = grids.where(F.col("system") != target).withColumn("p", places)
    col, row = F.col("p.a") * F.col("width"), F.col("p.b") * F.col("height")
    points = points.select("sig", "system", (gt["gt0"] + col * gt["gt1"] + row * gt["gt2"]).alias("x"), (gt["gt3"] + col * gt["gt4"] + row * gt["gt5"]).alias("y"), (F.abs(gt["gt1"]) + F.abs(gt["gt2"])).alias("dx"), (F.abs(gt["gt4"]) + F.abs(gt["gt5"])).alias("dy"))
    choose = lambda of, i: F.coalesce(*[F.when(F.col("system") == s, v[i]) for s, v in of.items()], F.lit(None).cast("double"))

    there = {s: projections.to_degrees(s, F.col("x"), F.col("y")) for s in names}
    points = projections.computed(points, keep, lon=choose(there, 0), lat=choose(there, 1))
    u, v = projections.from_degrees(target, F.col("lon"), F.col("lat"))
    points = projections.computed(points, keep, u=u, v=v)
    lon, lat = projections.to_degrees(target, F.col("u"), F.col("v"))
    points = projections.computed(points, [*keep, "u", "v"], lon=lon, lat=lat)
    back = {s: projections.from_degrees(s, F.col("lon"), F.col("lat")) for s in names}
    points = projections.computed(points, [*keep, "u", "v"], x2=choose(back, 0), y2=choose(back, 1))
    finite = lambda c: F.coalesce(F.abs(c) < 1e300, F.lit(False))
    turns = {s: t for s in names if (t := projections.turn(s))}
    step = F.coalesce(*[F.when(F.col("system") == s, F.lit(t)) for s, t in turns.items()], F.lit(None).cast("double"))
    off = F.col("x2") - F.col("x")
    off = off - F.coalesce(F.round(off / step) * step, F.lit(0.0))  # a turn further is the same place
    shown = finite(F.col("u")) & finite(F.col("v"))
    near = F.coalesce((F.abs(off) <= F.col("dx")) & (F.abs(F.col("y2") - F.col("y")) <= F.col("dy")), F.lit(False))
    return points.groupBy("sig").agg(F.count_if(shown).alias("n_shown"), F.count_if(shown & ~near).alias("n_off"))
