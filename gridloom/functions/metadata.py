"""Raster metadata as column expressions: affine transforms, coordinate systems, nodata, band names, sample types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The meaning of GeoTIFF and EPSG codes.
PROJECTIONS = {1: "tmerc", 7: "merc", 8: "lcc", 9: "lcc", 10: "laea", 11: "aea", 12: "aeqd", 13: "eqdc", 14: "stere", 15: "stere", 16: "sterea", 17: "eqc", 19: "gnom", 21: "ortho", 24: "sinu", 28: "cea"}
TWO_PARALLELS = [8, 11, 13]
SCALED = [1, 9, 14, 16]
TRUE_SCALE_OR_SCALED = [7, 15]
TRUE_SCALE = [17, 28]
PRIME_MERIDIANS = {8902: "lisbon", 8903: "paris", 8904: "bogota", 8905: "madrid", 8906: "rome", 8907: "bern", 8908: "jakarta", 8909: "ferro", 8910: "brussels", 8911: "stockholm", 8912: "athens", 8913: "oslo"}
ELLIPSOIDS = {7001: "airy", 7002: "mod_airy", 7003: "aust_SA", 7004: "bessel", 7008: "clrk66", 7012: "clrk80", 7019: "GRS80", 7022: "intl", 7030: "WGS84", 7035: "sphere", 7043: "WGS72"}
WKT_WORDS = ["PROJCS", "PROJCRS", "GEOGCS", "GEOGCRS", "GEODCRS", "BOUNDCRS", "COMPD_CS", "COMPDCRS", "ENGCRS", "ENGCS", "VERTCS", "VERTCRS", "TIMECRS"]
BYTES = {"Byte": 1, "Int8": 1, "UInt16": 2, "Int16": 2, "UInt32": 4, "Int32": 4, "Float32": 4, "CInt16": 4, "Float64": 8, "UInt64": 8, "Int64": 8, "CInt32": 8, "CFloat32": 8, "CFloat64": 16}


def lookup(code: Column, names: dict) -> Column:
    """The name of a code, null if there is none."""
    (k, v), *rest = names.items()
    return reduce(lambda c, kv: c.when(code == kv[0], kv[1]), rest, F.when(code == k, v))


def number(x: Column) -> Column:
    """Shortest text of a number; whole numbers without a point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("double").cast("string"))


def geotransform(matrix: Column, scale: Column, tie: Column, raster_type: Column) -> Column:
    """Struct gt0..gt5 from a 16-entry transformation, else from pixel scale and tie point; raster type 2 says that
    coordinates are of pixel centres, so the origin moves back half a pixel."""
    at = lambda c, i: F.get(c, F.lit(i))
    sx, sy = at(scale, 0), at(scale, 1)
    whole = F.size(matrix) >= 16
    terms = [
        F.when(whole, at(matrix, 3)).otherwise(at(tie, 3) - at(tie, 0) * sx), F.when(whole, at(matrix, 0)).otherwise(sx), F.when(whole, at(matrix, 1)).otherwise(F.lit(0.0)),
        F.when(whole, at(matrix, 7)).otherwise(at(tie, 4) + at(tie, 1) * sy), F.when(whole, at(matrix, 4)).otherwise(F.lit(0.0)), F.when(whole, at(matrix, 5)).otherwise(-sy),
    ]
    back = F.when(raster_type == 2, 0.5).otherwise(0.0)
    shifted = [terms[0] - back * (terms[1] + terms[2]), *terms[1:3], terms[3] - back * (terms[4] + terms[5]), *terms[4:]]
    return F.struct(*[t.alias(f"gt{i}") for i, t in enumerate(shifted)])


def is_wkt(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.ltrim(text), r"^([^\[(\s]*)", 1).isin(WKT_WORDS), F.lit(False))


def prime_meridian(code: Column, degrees: Column) -> Column:
    named = lookup(code, PRIME_MERIDIANS)
    return F.when(code == 8901, F.lit(None)).when(named.isNotNull(), F.concat(F.lit("+pm="), named)).when(degrees != 0, F.concat(F.lit("+pm="), number(degrees)))


def ellipsoid(code: Column, a: Column, b: Column, rf: Column) -> Column:
    named = lookup(code, ELLIPSOIDS)
    size = F.concat(F.lit("+a="), number(a))
    return F.when(named.isNotNull(), F.concat(F.lit("+ellps="), named)).when(a.isNotNull() & rf.isNotNull(), F.concat(size, F.lit(" +rf="), number(rf))).when(a.isNotNull() & b.isNotNull(), F.concat(size, F.lit(" +b="), number(b))).when(a.isNotNull(), size).otherwise(F.lit("+ellps=WGS84"))


def proj_string(code: Column, lon_0: Column, lat_0: Column, x_0: Column, y_0: Column, lat_1: Column, lat_2: Column, k: Column, meridian: Column, ellps: Column) -> Column:
    """A proj string from projection parameters; null for unknown codes and conics without both parallels."""
    part = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"+{name}="), number(v)))
    scaled = F.concat(F.lit("+k_0="), number(F.coalesce(k, F.lit(1.0))))
    extra = (
        F.when(code.isin(SCALED), scaled)
        .when(code.isin(TRUE_SCALE_OR_SCALED), F.coalesce(part("lat_ts", lat_1), scaled))
        .when(code.isin(TWO_PARALLELS), F.concat(part("lat_1", lat_1), F.lit(" "), part("lat_2", lat_2)))
        .when(code.isin(TRUE_SCALE), part("lat_ts", lat_1))
    )
    name = lookup(code, PROJECTIONS)
    whole = F.concat_ws(" ", F.concat(F.lit("+proj="), name), part("lon_0", lon_0), part("lat_0", lat_0), part("x_0", x_0), part("y_0", y_0), extra, meridian, ellps, F.lit("+no_defs"))
    return F.when(name.isNotNull() & ~(code.isin(TWO_PARALLELS) & extra.isNull()), whole)


def degrees_string(model: Column, code: Column, meridian: Column, ellps: Column) -> Column:
    """A proj string of a user-defined geographic system; null for all others."""
    return F.when((model == 2) & (code == 32767), F.concat_ws(" ", F.lit("+proj=longlat"), meridian, ellps, F.lit("+no_defs")))


def crs(epsg: Column, citations: list[Column], proj: Column) -> Column:
    """EPSG code (0 and 32767 say user-defined), else the first citation that is WKT, else a proj string."""
    return F.coalesce(F.when(~epsg.isin(0, 32767), F.concat(F.lit("EPSG:"), epsg.cast("string"))), *[F.when(is_wkt(c), c) for c in citations], proj)


def nodata(text: Column) -> Column:
    return F.lower(F.trim(text)).try_cast("double")


def band_names(xml: Column, n_bands: Column) -> Column:
    """Descriptions by sample number, without blanks around them; band_01, band_02 and so on where there is none. An item's
    attributes come in any order, and of several items of a sample the last one counts."""
    text, item = F.coalesce(xml, F.lit("")), F.lit(r"(?s)<Item([^>]*)>(.*?)</Item>")
    heads, bodies = F.regexp_extract_all(text, item, F.lit(1)), F.regexp_extract_all(text, item, F.lit(2))
    both = F.transform(heads, lambda h, i: F.struct(h.alias("head"), F.btrim(F.get(bodies, i), F.lit(" \t\r\n")).alias("body")))
    named = F.filter(both, lambda x: F.regexp_extract(x["head"], r'\bname="([^"]*)"', 1) == "DESCRIPTION")
    numbered = F.transform(named, lambda x: F.struct(F.regexp_extract(x["head"], r'\bsample="(\d+)"', 1).try_cast("int").alias("sample"), x["body"].alias("body")))
    last = lambda i: F.try_element_at(F.filter(numbered, lambda x: x["sample"] == i), F.lit(-1))["body"]
    return F.transform(F.sequence(F.lit(0), n_bands - 1), lambda i: F.coalesce(last(i), F.format_string("band_%02d", i + 1)))


def dtype(sample_format: Column, bits: Column) -> Column:
    """1 unsigned, 2 signed, 3 floating point; other combinations are Float64."""
    names = {(1, 1): "Byte", (1, 8): "Byte", (2, 8): "Int8", (1, 16): "UInt16", (2, 16): "Int16", (1, 32): "UInt32", (2, 32): "Int32", (1, 64): "UInt64", (2, 64): "Int64", (3, 32): "Float32", (3, 64): "Float64"}
    return F.coalesce(lookup(sample_format * 100 + bits, {f * 100 + b: n for (f, b), n in names.items()}), F.lit("Float64"))


def sample_bytes(name: Column) -> Column:
    return F.coalesce(lookup(name, BYTES), F.lit(8))


def saturate(value: Column, low: float, high: float, kind: str) -> Column:
    """A saturating cast: towards zero, to the nearest limit, NaN to 0."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.nanvl(value, F.lit(0.0)))).cast(kind)


def extent(gt: Column, width: Column, height: Column) -> Column:
    """Struct xmin, ymin, xmax, ymax over the four corners."""
    x = [gt["gt0"] + c * gt["gt1"] + r * gt["gt2"] for c in (F.lit(0), width) for r in (F.lit(0), height)]
    y = [gt["gt3"] + c * gt["gt4"] + r * gt["gt5"] for c in (F.lit(0), width) for r in (F.lit(0), height)]
    return F.struct(F.least(*x).alias("xmin"), F.least(*y).alias("ymin"), F.greatest(*x).alias("xmax"), F.greatest(*y).alias("ymax"))


def grid_signature(gt: Column, crs_name: Column, levels: Column) -> Column:
    """Equal for sources on one grid: transform, coordinate system, widths and heights of the levels."""
    return F.concat_ws("|", *[F.format_string("%.10f", gt[f"gt{i}"]) for i in range(6)], F.coalesce(crs_name, F.lit("")), F.array_join(F.transform(levels, lambda x: x["width"].cast("string")), ","), F.array_join(F.transform(levels, lambda x: x["height"].cast("string")), ","))
