"""Map projections by parameters: from a proj string to column expressions, on any ellipsoid.

tmerc and utm (Krueger's series in the third flattening to the fourth order), merc, lcc, laea, aea, stere, eqc (on the
sphere of the semi-major axis), sinu, cea and longlat, by Snyder, Map Projections: A Working Manual (1987), and the series of
Karney, On Auxiliary Latitudes (2022). Every parameter may also be a column, so that each row has a projection of its own:
what is known before the job is computed then. Datums are taken as equal; a string that asks for a shift is refused. Points
without an image are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGREE = math.pi / 180
Number = float | Column

# Ellipsoids (semi-major axis, inverse flattening; 0: a sphere), meridians in degrees, units in metres.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "WGS72": (6378135.0, 298.26), "airy": (6377563.396, 299.3249646), "mod_airy": (6377340.189, 299.3249646), "aust_SA": (6378160.0, 298.25),
    "bessel": (6377397.155, 299.1528128), "clrk66": (6378206.4, 294.9786982), "clrk80": (6378249.145, 293.4663), "intl": (6378388.0, 297.0), "krass": (6378245.0, 298.3), "sphere": (6370997.0, 0.0),
}
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80", "NAD27": "clrk66"}
MERIDIANS = {"greenwich": 0.0, "lisbon": -9.131906111111, "paris": 2.337229166667, "bogota": -74.080916666667, "madrid": -3.687375, "rome": 12.452333333333, "bern": 7.439583333333, "jakarta": 106.807719444444, "ferro": -17.666666666667, "brussels": 4.367975, "stockholm": 18.058277777778, "athens": 23.7163375, "oslo": 10.722916666667}
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}

KINDS = ("longlat", "tmerc", "merc", "lcc", "laea", "aea", "stere", "eqc", "sinu", "cea")
#: Kinds whose x is in proportion to the longitude: they repeat with every turn.
CYLINDRICAL = ("longlat", "merc", "eqc", "cea")
#: What a string may hold that changes nothing here.
IGNORED = {"no_defs", "wktext", "type", "nadgrids", "over", "vunits", "axis"}


@dataclass(frozen=True)
class Projection:
    """a and rf are the ellipsoid (rf 0: a sphere); k the scale at the origin; ts a latitude of true scale, if it has one."""

    kind: str
    lon0: Number = 0.0
    lat0: Number = 0.0
    lat1: Number = 0.0
    lat2: Number = 0.0
    k: Number = 1.0
    x0: Number = 0.0
    y0: Number = 0.0
    a: Number = 6378137.0
    rf: Number = 298.257223563
    unit: float = 1.0
    ts: Number | None = None

    def name(self) -> str:
        """The same text for the same parameters."""
        if self.kind == "longlat":
            return f"+proj=longlat +lon_0={self.lon0!r} +a={self.a!r} +rf={self.rf!r}"
        said = {"lat_1": self.lat1, "lat_2": self.lat2} if self.kind in ("lcc", "aea") else {}
        said |= {"lat_ts": self.ts} if self.ts is not None else {}
        plain = {"lon_0": self.lon0, "lat_0": self.lat0, **said, "k_0": self.k, "x_0": self.x0, "y_0": self.y0, "a": self.a, "rf": self.rf, "to_meter": self.unit}
        return f"+proj={self.kind} " + " ".join(f"+{n}={float(v)!r}" for n, v in plain.items())


def parse(text: str) -> Projection:
    """A proj string's parameters, none of which is left aside in silence."""
    said: dict[str, str] = {}
    for part in text.split():
        name, _, value = part.removeprefix("+").partition("=")
        said[name] = value
    take = lambda *names: next((said.pop(n) for n in names if n in said), None)
    number = lambda *names: None if (v := take(*names)) is None else _number(v, text)
    kind, south = take("proj"), "south" in said and said.pop("south") is not None
    ellps = take("ellps") or DATUMS.get(take("datum") or "", None)
    said.pop("datum", None)
    if ellps is not None and ellps not in ELLIPSOIDS:
        raise ValueError(f"unknown ellipsoid {ellps!r}")
    a, rf = ELLIPSOIDS[ellps or "WGS84"]
    own_a, own_b, own_rf, own_f, radius = number("a"), number("b"), number("rf"), number("f"), number("R")
    if radius is not None:
        a, rf = radius, 0.0
    elif own_a is not None:
        a = own_a
        rf = own_rf if own_rf is not None else 0.0 if own_f == 0 or own_b == own_a or (own_b is None and own_f is None) else 1 / own_f if own_f is not None else own_a / (own_a - own_b)
    meridian = take("pm")
    pm = 0.0 if meridian is None else MERIDIANS[meridian] if meridian in MERIDIANS else _number(meridian, text)
    units, metres = take("units"), number("to_meter")
    if units is not None and units not in UNITS:
        raise ValueError(f"unknown unit {units!r} in {text!r}")
    shift = take("towgs84")
    if shift is not None and any(float(v) != 0 for v in shift.split(",")):
        raise ValueError(f"{text!r} asks for a datum shift")
    lon0, lat0, lat1, lat2, ts, k, x0, y0 = (number(*n) for n in (("lon_0",), ("lat_0",), ("lat_1",), ("lat_2",), ("lat_ts",), ("k_0", "k"), ("x_0",), ("y_0",)))
    common = {"a": a, "rf": rf, "unit": metres if metres is not None else UNITS[units or "m"]}
    if kind == "utm":
        zone = int(_number(take("zone") or "", text))
        if not 1 <= zone <= 60:
            raise ValueError(f"no zone in {text!r}")
        kind, lon0, lat0, k, x0, y0 = "tmerc", zone * 6 - 183.0, 0.0, 0.9996, 500_000.0, 10_000_000.0 if south else 0.0
    kind = {"latlong": "longlat", "latlon": "longlat", "lonlat": "longlat"}.get(kind, kind)
    if kind not in KINDS:
        raise ValueError(f"unsupported projection in {text!r}")
    if left := set(said) - IGNORED:
        raise ValueError(f"{text!r}: {', '.join(sorted(left))} isn't supported")
    if kind == "longlat":
        return Projection(kind, (lon0 or 0.0) + pm, a=a, rf=rf)
    lat0 = 0.0 if lat0 is None else lat0
    if kind in ("lcc", "aea"):
        lat1 = lat0 if lat1 is None else lat1
        lat2 = lat1 if lat2 is None else lat2
        if abs(lat1 + lat2) < 1e-10:
            raise ValueError(f"the parallels of {text!r} make no cone")
    if kind == "stere" and abs(lat0) < 90:
        ts = None
    return Projection(kind, (lon0 or 0.0) + pm, lat0, lat1 or 0.0, lat2 or 0.0, 1.0 if k is None else k, x0 or 0.0, y0 or 0.0, ts=ts, **common)


def _number(text: str, where: str) -> float:
    try:
        value = float(text)
    except ValueError:
        raise ValueError(f"{text!r} in {where!r} isn't a number") from None
    if not math.isfinite(value):
        raise ValueError(f"{text!r} in {where!r} isn't finite")
    return value


def _either(name: str) -> Callable:
    """A function of numbers, or of columns as soon as one is."""
    return lambda *x: getattr(F, name)(*x) if any(isinstance(v, Column) for v in x) else getattr(math, name)(*x)


sin, cos, tan, asin, atan, atan2, sinh, cosh, atanh, exp, sqrt = (_either(n) for n in ("sin", "cos", "tan", "asin", "atan", "atan2", "sinh", "cosh", "atanh", "exp", "sqrt"))


def asinh(x: Number) -> Number:
    """Spark's own loses the digits of large negative numbers, and is infinite below -1e8: those are taken from the other side."""
    return F.signum(x) * F.asinh(F.abs(x)) if isinstance(x, Column) else math.asinh(x)


def log(x: Number) -> Number:
    return F.log(x) if isinstance(x, Column) else math.log(x)


def pick(test: Column | bool, a: Number, b: Number) -> Number:
    """a if test, else b; of numbers only the one that is taken must be defined."""
    if isinstance(test, Column):
        return F.when(test, a).otherwise(b)
    return a if test else b


def let(x: Number, body: Callable[[Number], Number]) -> Number:
    """body of x, which is computed once however often body reads it."""
    return F.get(F.transform(F.array(x), body), F.lit(0)) if isinstance(x, Column) else body(x)


def series(x: Number, terms: tuple) -> Number:
    return let(x, lambda v: v + sum(sin(v * (2.0 * k)) * c for k, c in enumerate(terms, 1)))


class Ellipsoid:
    def __init__(self, p: Projection) -> None:
        f = pick(p.rf == 0, 0.0, 1 / p.rf if isinstance(p.rf, Column) or p.rf else 0.0)
        self.a, self.e2 = p.a, f * (2.0 - f)
        self.e, self.n = sqrt(self.e2), f / (2.0 - f)
        n = self.n
        self.rectifying = self.a / (n + 1.0) * (1.0 + n**2 / 4 + n**4 / 64)
        self.qp = self.q(1.0)

    def m(self, phi: Number) -> Number:
        """Radius of a parallel over the semi-major axis."""
        s = sin(phi)
        return cos(phi) / sqrt(1.0 - s * s * self.e2)

    def q(self, s: Number) -> Number:
        """Of the sine of a latitude: in proportion to the area up to there."""
        if not isinstance(self.e, Column) and self.e == 0:
            return s * 2.0
        flat = atanh(s * self.e) / pick(self.e == 0, 1.0, self.e)
        return (s / (1.0 - s * s * self.e2) + pick(self.e == 0, s, flat)) * (1.0 - self.e2)

    def isometric(self, phi: Number) -> Number:
        return asinh(tan(phi)) - atanh(sin(phi) * self.e) * self.e

    def from_isometric(self, up: Number) -> Number:
        e2 = self.e2
        terms = (e2 / 2 + e2**2 * 5 / 24 + e2**3 / 12 + e2**4 * 13 / 360, e2**2 * 7 / 48 + e2**3 * 29 / 240 + e2**4 * 811 / 11520, e2**3 * 7 / 120 + e2**4 * 81 / 1120, e2**4 * 4279 / 161280)
        return series(atan(sinh(up)), terms)

    def from_authalic(self, sine: Number) -> Number:
        """Latitude of the sine of an authalic latitude; null beyond the poles."""
        n = self.n
        terms = (n * 4 / 3 + n**2 * 4 / 45 - n**3 * 16 / 35 - n**4 * 2582 / 14175, n**2 * 46 / 45 + n**3 * 152 / 945 - n**4 * 11966 / 14175, n**3 * 3044 / 2835 + n**4 * 3802 / 14175, n**4 * 6059 / 4725)
        inside = F.when(F.abs(sine) <= 1 + 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))
        return series(F.asin(inside), terms)

    def meridian(self, phi: Number) -> Number:
        """Distance from the equator along a meridian."""
        n = self.n
        return series(phi, (n * -3 / 2 + n**3 * 9 / 16, n**2 * 15 / 16 - n**4 * 15 / 32, n**3 * -35 / 48, n**4 * 315 / 512)) * self.rectifying

    def from_meridian(self, distance: Number) -> Number:
        n = self.n
        return series(distance / self.rectifying, (n * 3 / 2 - n**3 * 27 / 32, n**2 * 21 / 16 - n**4 * 55 / 32, n**3 * 151 / 96, n**4 * 1097 / 512))

    def alpha(self) -> tuple:
        n = self.n
        return (n / 2 - n**2 * 2 / 3 + n**3 * 5 / 16 + n**4 * 41 / 180, n**2 * 13 / 48 - n**3 * 3 / 5 + n**4 * 557 / 1440, n**3 * 61 / 240 - n**4 * 103 / 140, n**4 * 49561 / 161280)

    def beta(self) -> tuple:
        n = self.n
        return (n / 2 - n**2 * 2 / 3 + n**3 * 37 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - n**4 * 437 / 1440, n**3 * 17 / 480 - n**4 * 37 / 840, n**4 * 4397 / 161280)


def turned(degrees: Number) -> Number:
    """The same direction from -180 up to 180."""
    return degrees - F.floor((degrees + 180.0) / 360.0) * 360.0 if isinstance(degrees, Column) else degrees - math.floor((degrees + 180.0) / 360.0) * 360.0


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _together(values: dict[str, Column], body: Callable[[Column], Column]) -> tuple[Column, Column]:
    """The two numbers that body makes of values, each of which is computed once."""
    both = F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), F.lit(0))
    return both["x"], both["y"]


def _cone(e: Ellipsoid, p: Projection) -> tuple[Number, Number, Number]:
    """The constant of a cone, that of its radii, and the radius of the origin's parallel."""
    p1, p2, p0 = p.lat1 * DEGREE, p.lat2 * DEGREE, p.lat0 * DEGREE
    near = F.abs(p1 - p2) < 1e-10 if isinstance(p1, Column) or isinstance(p2, Column) else abs(p1 - p2) < 1e-10
    if p.kind == "aea":
        q1, q2 = e.q(sin(p1)), e.q(sin(p2))
        n = sin(p1) if near is True else pick(near, sin(p1), (e.m(p1) ** 2 - e.m(p2) ** 2) / (q2 - q1))
        c = e.m(p1) ** 2 + n * q1
        return n, c, sqrt(c - n * e.q(sin(p0))) * e.a / n
    n = sin(p1) if near is True else pick(near, sin(p1), log(e.m(p1) / e.m(p2)) / (e.isometric(p2) - e.isometric(p1)))
    c = e.m(p1) * exp(n * e.isometric(p1)) / n * p.k
    pole = F.abs(p0) > math.pi / 2 - 1e-12 if isinstance(p0, Column) else abs(p0) > math.pi / 2 - 1e-12
    return n, c, 0.0 if pole is True else pick(pole, 0.0, exp(-n * e.isometric(p0)) * e.a * c)


def _polar(p: Projection) -> tuple[Column | bool, Number]:
    """Whether the origin is a pole, and 1 in the north, -1 in the south."""
    if isinstance(p.lat0, Column):
        return F.abs(p.lat0) > 90 - 1e-10, F.signum(p.lat0)
    return abs(p.lat0) > 90 - 1e-10, math.copysign(1.0, p.lat0)


def _polar_scale(e: Ellipsoid, p: Projection) -> Number:
    """Radius of the parallel whose isometric latitude is 0, in a polar stereographic projection."""
    if p.ts is not None:
        phi = (F.abs(p.ts) if isinstance(p.ts, Column) else abs(p.ts)) * DEGREE
        full = F.abs(phi) > math.pi / 2 - 1e-12 if isinstance(phi, Column) else phi > math.pi / 2 - 1e-12
        if full is not True:
            return e.m(phi) * exp(e.isometric(phi)) * e.a
    plus, minus = e.e + 1.0, 1.0 - e.e
    return e.a * p.k * 2.0 / sqrt(exp(log(plus) * plus + log(minus) * minus))


def _oblique(e: Ellipsoid, p: Projection) -> tuple[Number, Number, Number]:
    """Sine and cosine of the origin's conformal latitude, and the scale of an oblique stereographic projection."""
    chi = atan(sinh(e.isometric(p.lat0 * DEGREE)))
    return sin(chi), cos(chi), e.a * p.k * 2.0 * e.m(p.lat0 * DEGREE) / cos(chi)


def forward(p: Projection, lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y of degrees, in the projection's unit."""
    if p.kind == "longlat":
        return lon - p.lon0, lat
    e, phi = Ellipsoid(p), lat * DEGREE
    if p.kind in CYLINDRICAL:
        lam = (lon - p.lon0) * DEGREE
        scale = p.k if p.ts is None else e.m(p.ts * DEGREE)
        if p.kind == "merc":
            x, y = lam * scale * e.a, e.isometric(F.when(F.abs(lat) < 90, phi)) * scale * e.a
        elif p.kind == "cea":
            x, y = lam * scale * e.a, e.q(F.sin(phi)) * e.a / (scale * 2.0)
        else:
            x, y = lam * (1.0 if p.ts is None else cos(p.ts * DEGREE)) * e.a, (phi - p.lat0 * DEGREE) * e.a
    else:
        x, y = _together({"l": turned(lon - p.lon0) * DEGREE, "p": phi}, lambda v: _pair(*_projected(e, p, v["l"], v["p"])))
    return (x + p.x0) / p.unit, (y + p.y0) / p.unit


def _projected(e: Ellipsoid, p: Projection, lam: Column, phi: Column) -> tuple[Column, Column]:
    """Metres from the false origin."""
    if p.kind == "tmerc":
        at = e.meridian(p.lat0 * DEGREE)
        t = let(F.sin(phi), lambda s: F.sinh(F.atanh(s) - F.atanh(s * e.e) * e.e))
        xi, eta = _together({"t": t, "l": lam}, lambda v: _pair(F.atan2(v["t"], F.cos(v["l"])), F.atanh(F.sin(v["l"]) / F.sqrt(v["t"] * v["t"] + 1.0))))
        x, y = _together({"xi": xi, "eta": eta}, lambda v: _pair(v["eta"] + sum(F.cos(v["xi"] * (2.0 * j)) * F.sinh(v["eta"] * (2.0 * j)) * c for j, c in enumerate(e.alpha(), 1)), v["xi"] + sum(F.sin(v["xi"] * (2.0 * j)) * F.cosh(v["eta"] * (2.0 * j)) * c for j, c in enumerate(e.alpha(), 1))))
        return x * p.k * e.rectifying, y * p.k * e.rectifying - at * p.k
    if p.kind == "sinu":
        return lam * e.m(phi) * e.a, e.meridian(phi)
    if p.kind in ("lcc", "aea"):
        n, c, origin = _cone(e, p)
        if p.kind == "aea":
            rho = F.sqrt(F.greatest(F.lit(0.0), F.lit(c) - e.q(F.sin(phi)) * n)) * e.a / n
        else:
            rho = F.exp(e.isometric(F.when(F.abs(phi) < math.pi / 2 - 1e-12, phi)) * -n) * e.a * c
            rho = F.coalesce(rho, F.when(phi * n > 0, 0.0))  # the cone's own pole is its apex
        return _together({"r": rho, "t": lam * n}, lambda v: _pair(v["r"] * F.sin(v["t"]), F.lit(origin) - v["r"] * F.cos(v["t"])))
    polar, side = _polar(p)
    if p.kind == "laea":
        q = e.q(F.sin(phi))
        if polar is not False:
            rho = F.sqrt(F.greatest(F.lit(0.0), F.lit(e.qp) - q * side)) * e.a
            at_pole = rho * F.sin(lam), rho * F.cos(lam) * -side
            if polar is True:
                return at_pole
        s0, c0, radius, d = _azimuthal(e, p)

        def oblique(v: Column) -> Column:
            c = F.sqrt(F.greatest(F.lit(0.0), 1.0 - v["s"] * v["s"]))
            facing = v["s"] * s0 + c * F.cos(v["l"]) * c0 + 1.0
            b = F.sqrt(F.lit(2.0) / F.when(facing > 1e-12, facing)) * radius  # the antipode has no image
            return _pair(b * c * F.sin(v["l"]) * d, b / d * (v["s"] * c0 - c * F.cos(v["l"]) * s0))

        tilted = _together({"s": q / e.qp, "l": lam}, oblique)
        return tilted if polar is False else (pick(polar, at_pole[0], tilted[0]), pick(polar, at_pole[1], tilted[1]))
    if polar is not False:
        up = e.isometric(F.when(F.abs(phi) < math.pi / 2 - 1e-12, phi)) * side
        rho = F.coalesce(F.exp(-up) * _polar_scale(e, p), F.when(phi * side > 0, 0.0))
        at_pole = rho * F.sin(lam), rho * F.cos(lam) * -side
        if polar is True:
            return at_pole
    s0, c0, scale = _oblique(e, p)

    def tilted_stere(v: Column) -> Column:
        facing = F.sin(v["c"]) * s0 + F.cos(v["c"]) * F.cos(v["l"]) * c0 + 1.0
        b = F.lit(scale) / F.when(facing > 1e-12, facing)
        return _pair(b * F.cos(v["c"]) * F.sin(v["l"]), b * (F.sin(v["c"]) * c0 - F.cos(v["c"]) * F.cos(v["l"]) * s0))

    chi = F.when(F.abs(phi) > math.pi / 2 - 1e-12, phi).otherwise(F.atan(F.sinh(e.isometric(F.when(F.abs(phi) < math.pi / 2 - 1e-12, phi)))))
    tilted = _together({"c": chi, "l": lam}, tilted_stere)
    return tilted if polar is False else (pick(polar, at_pole[0], tilted[0]), pick(polar, at_pole[1], tilted[1]))


def _azimuthal(e: Ellipsoid, p: Projection) -> tuple[Number, Number, Number, Number]:
    """Sine and cosine of the origin's authalic latitude, radius of the authalic sphere, scale of the axes."""
    sine = e.q(sin(p.lat0 * DEGREE)) / e.qp
    cosine, radius = sqrt(1.0 - sine * sine), e.a * sqrt(e.qp / 2.0)
    return sine, cosine, radius, e.a * e.m(p.lat0 * DEGREE) / (radius * cosine)


def backward(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of x and y; longitudes go on beyond 180 where x does."""
    if p.kind == "longlat":
        return x + p.lon0, y
    e, u, v = Ellipsoid(p), x * p.unit - p.x0, y * p.unit - p.y0
    if p.kind in CYLINDRICAL:
        scale = p.k if p.ts is None else e.m(p.ts * DEGREE)
        if p.kind == "merc":
            lam, phi = u / (e.a * scale), e.from_isometric(v / (e.a * scale))
        elif p.kind == "cea":
            lam, phi = u / (e.a * scale), e.from_authalic(v * scale * 2.0 / (e.a * e.qp))
        else:
            lam, phi = u / (e.a * (1.0 if p.ts is None else cos(p.ts * DEGREE))), v / e.a + p.lat0 * DEGREE
    else:
        lam, phi = _together({"u": u, "v": v}, lambda w: _pair(*_unprojected(e, p, w["u"], w["v"])))
    return lam / DEGREE + p.lon0, phi / DEGREE


def _unprojected(e: Ellipsoid, p: Projection, u: Column, v: Column) -> tuple[Column, Column]:
    """Radians of longitude from the origin's meridian, and of latitude."""
    if p.kind == "tmerc":
        scale = e.rectifying * p.k
        xi, eta = (v + e.meridian(p.lat0 * DEGREE) * p.k) / scale, u / scale
        both = _together({"xi": xi, "eta": eta}, lambda w: _pair(w["xi"] - sum(F.sin(w["xi"] * (2.0 * j)) * F.cosh(w["eta"] * (2.0 * j)) * b for j, b in enumerate(e.beta(), 1)), w["eta"] - sum(F.cos(w["xi"] * (2.0 * j)) * F.sinh(w["eta"] * (2.0 * j)) * b for j, b in enumerate(e.beta(), 1))))
        lam, up = _together({"xi": both[0], "eta": both[1]}, lambda w: _pair(F.atan2(F.sinh(w["eta"]), F.cos(w["xi"])), F.atanh(F.sin(w["xi"]) / F.cosh(w["eta"]))))
        return lam, e.from_isometric(up)
    if p.kind == "sinu":
        phi = e.from_meridian(v)
        return let(phi, lambda f: F.when(F.abs(f) < math.pi / 2 - 1e-12, u / (e.m(f) * e.a)).when(F.abs(f) <= math.pi / 2 + 1e-12, 0.0)), phi
    if p.kind in ("lcc", "aea"):
        n, c, origin = _cone(e, p)
        side, down = (F.signum(n) if isinstance(n, Column) else math.copysign(1.0, n)), F.lit(origin) - v
        rho = F.sqrt(u * u + down * down)
        lam = F.atan2(u * side, down * side) / n
        if p.kind == "aea":
            return lam, e.from_authalic((F.lit(c) - rho * rho * (n / e.a) ** 2) / (e.qp * n))
        reach = F.abs(c) if isinstance(c, Column) else abs(c)
        return lam, F.when(rho == 0, F.lit(side) * (math.pi / 2)).otherwise(e.from_isometric(F.log(F.when(rho > 0, rho) / (e.a * reach)) / -n))
    polar, side = _polar(p)
    rho2 = u * u + v * v
    if p.kind == "laea":
        if polar is not False:
            at_pole = F.atan2(u, v * -side), e.from_authalic((F.lit(1.0) - rho2 / (e.a * e.a * e.qp)) * side)
            if polar is True:
                return at_pole
        s0, c0, radius, d = _azimuthal(e, p)
        rho = F.sqrt(u * u / (d * d) + v * v * (d * d))
        half = F.when(rho <= radius * 2.0, rho / (radius * 2.0))
        # sin(ce) / rho, which is 1 / radius at the origin, and cos(ce), where sin(ce / 2) is half.
        slope, cosine = F.sqrt(1.0 - half * half) / radius, 1.0 - half * half * 2.0
        tilted = F.atan2(u * slope / d, cosine * c0 - v * slope * (d * s0)), e.from_authalic(cosine * s0 + v * slope * (d * c0))
    else:
        if polar is not False:
            # The least positive double keeps the pole itself defined.
            up = F.log(F.greatest(F.sqrt(rho2), F.lit(1e-300)) / _polar_scale(e, p)) * -side
            at_pole = F.atan2(u, v * -side), e.from_isometric(up)
            if polar is True:
                return at_pole
        s0, c0, scale = _oblique(e, p)
        half = F.atan(F.sqrt(rho2) / scale)
        sine_by_rho = F.cos(half) ** 2 * (2.0 / scale)  # sin(ce) / rho, where tan(ce / 2) is rho / scale
        cosine = F.cos(half * 2.0)
        chi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine * s0 + v * sine_by_rho * c0)))
        tilted = F.atan2(u * sine_by_rho, cosine * c0 - v * sine_by_rho * s0), e.from_isometric(let(chi, lambda c: F.asinh(F.tan(c))))
    return tilted if polar is False else (pick(polar, at_pole[0], tilted[0]), pick(polar, at_pole[1], tilted[1]))


def turn(p: Projection) -> float | None:
    """By how much x grows in a full turn, if it does so in proportion."""
    if p.kind == "longlat":
        return 360.0
    if p.kind not in CYLINDRICAL:
        return None
    e = Ellipsoid(p)
    scale = cos((p.ts or 0.0) * DEGREE) if p.kind == "eqc" else p.k if p.ts is None else e.m(p.ts * DEGREE)
    return 2 * math.pi * e.a * scale / p.unit


def same(a: Projection, b: Projection) -> bool:
    """Equal parameters, ellipsoids of a tenth of a millimetre alike."""
    if a.kind != b.kind or (a.ts is None) != (b.ts is None):
        return False
    axes = [(x.a, x.a * (1 - (1 / x.rf if x.rf else 0.0))) for x in (a, b)]
    if any(abs(u - v) > 1e-4 for u, v in zip(*axes, strict=True)):
        return False
    names = ("lon0",) if a.kind == "longlat" else [f.name for f in fields(a) if f.name not in ("kind", "a", "rf")]
    return all(abs((getattr(a, n) or 0.0) - (getattr(b, n) or 0.0)) < 1e-9 for n in names)
