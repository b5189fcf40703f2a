"""Equal-area and conic systems on the GRS80 ellipsoid as column expressions: azimuthal equal-area, Albers and Lambert
conformal conic (Snyder, Map Projections: A Working Manual, 1987, chapters 3, 14, 15 and 24).

Datums are taken as equal to WGS84, from which they differ by a metre or two. Points without an image are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.projections import asinh

# EPSG parameters. Kind, latitude and longitude of the origin, standard parallels, false easting and northing.
SYSTEMS = {
    "3034": ("lcc", 52.0, 10.0, (35.0, 65.0), 4_000_000.0, 2_800_000.0),
    "3035": ("laea", 52.0, 10.0, (), 4_321_000.0, 3_210_000.0),
    "3347": ("lcc", 63.390675, -91.86666666666666, (49.0, 77.0), 6_200_000.0, 3_000_000.0),
    "3577": ("aea", 0.0, 132.0, (-18.0, -36.0), 0.0, 0.0),
    "5070": ("aea", 23.0, -96.0, (29.5, 45.5), 0.0, 0.0),
}
RADIUS = 6378137.0
FLATTENING = 1 / 298.257222101
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
DEGREE = math.pi / 180
_N = FLATTENING / (2 - FLATTENING)
#: Latitude from authalic latitude: coefficients of sin 2b, sin 4b, sin 6b, sin 8b (Karney, On Auxiliary Latitudes, 2022).
FROM_AUTHALIC = (4 * _N / 3 + 4 * _N**2 / 45 - 16 * _N**3 / 35 - 2582 * _N**4 / 14175, 46 * _N**2 / 45 + 152 * _N**3 / 945 - 11966 * _N**4 / 14175, 3044 * _N**3 / 2835 + 3802 * _N**4 / 14175, 6059 * _N**4 / 4725)
#: Latitude from conformal latitude: coefficients of sin 2c, sin 4c, sin 6c, sin 8c.
FROM_CONFORMAL = (E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360, 7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520, 7 * E2**3 / 120 + 81 * E2**4 / 1120, 4279 * E2**4 / 161280)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


def _q(s: float) -> float:
    return (1 - E2) * (s / (1 - E2 * s * s) + math.atanh(E * s) / E)


def _isometric(phi: float) -> float:
    return math.asinh(math.tan(phi)) - E * math.atanh(E * math.sin(phi))


QP = _q(1.0)


def _authalic(phi: Column) -> Column:
    """Sine of the authalic latitude."""
    s = F.sin(phi)
    return (s / (1 - s * s * E2) + F.atanh(s * E) / E) * ((1 - E2) / QP)


def _series(angle: Column, terms: tuple[float, ...]) -> Column:
    return angle + sum(c * F.sin(angle * (2 * k)) for k, c in enumerate(terms, 1))


def _latitude(sine: Column) -> Column:
    """Latitude of a sine of authalic latitude; null beyond the poles."""
    inside = F.when(F.abs(sine) <= 1 + 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))
    return F.get(F.transform(F.array(F.asin(inside)), lambda b: _series(b, FROM_AUTHALIC)), F.lit(0))


def _east_of(lon: Column, lon0: float) -> Column:
    """Radians east of a meridian, from -pi up."""
    d = lon - lon0
    return (d - F.floor((d + 180) / 360) * 360.0) * DEGREE


def _cone(kind: str, parallels: tuple[float, float]) -> tuple[float, float]:
    """The cone's constant and the constant of its radii."""
    p1, p2 = (p * DEGREE for p in parallels)
    if kind == "aea":
        n = (_m(p1) ** 2 - _m(p2) ** 2) / (_q(math.sin(p2)) - _q(math.sin(p1)))
        return n, _m(p1) ** 2 + n * _q(math.sin(p1))
    n = math.log(_m(p1) / _m(p2)) / (_isometric(p2) - _isometric(p1))
    return n, _m(p1) * math.exp(n * _isometric(p1)) / n


def _origin_radius(kind: str, lat0: float, n: float, c: float) -> float:
    phi = lat0 * DEGREE
    return RADIUS * math.sqrt(c - n * _q(math.sin(phi))) / n if kind == "aea" else RADIUS * c * math.exp(-n * _isometric(phi))


def _azimuthal(lat0: float) -> tuple[float, float, float, float]:
    """Sine and cosine of the origin's authalic latitude, radius of the authalic sphere, scale of the axes."""
    sine = _q(math.sin(lat0 * DEGREE)) / QP
    cosine, radius = math.sqrt(1 - sine * sine), RADIUS * math.sqrt(QP / 2)
    return sine, cosine, radius, RADIUS * _m(lat0 * DEGREE) / (radius * cosine)


def from_degrees(code: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    kind, lat0, lon0, parallels, east, north = SYSTEMS[code]
    phi, lam = lat * DEGREE, _east_of(lon, lon0)
    if kind == "laea":
        s0, c0, radius, d = _azimuthal(lat0)
        s = _authalic(phi)
        c = F.sqrt(F.greatest(F.lit(0.0), 1 - s * s))
        facing = 1 + s * s0 + c * F.cos(lam) * c0
        b = F.sqrt(F.lit(2.0) / F.when(facing > 1e-12, facing)) * radius  # the antipode has no image
        return b * c * F.sin(lam) * d + east, b / d * (s * c0 - c * F.cos(lam) * s0) + north
    n, k = _cone(kind, parallels)
    if kind == "aea":
        rho = F.sqrt(F.greatest(F.lit(0.0), k - _authalic(phi) * (n * QP))) * (RADIUS / n)
    else:
        up = F.when(F.abs(lat) < 90, asinh(F.tan(phi)) - F.atanh(F.sin(phi) * E) * E)
        rho = F.exp(up * -n) * (RADIUS * k)
    return rho * F.sin(lam * n) + east, F.lit(_origin_radius(kind, lat0, n, k) + north) - rho * F.cos(lam * n)


def to_degrees(code: str, x: Column, y: Column) -> tuple[Column, Column]:
    kind, lat0, lon0, parallels, east, north = SYSTEMS[code]
    u, v = x - east, y - north
    if kind == "laea":
        s0, c0, radius, d = _azimuthal(lat0)
        rho = F.sqrt(u * u / (d * d) + v * v * (d * d))
        half = F.when(rho <= 2 * radius, rho / (2 * radius))
        # sin(ce) / rho, which is 1 / radius at the origin, and cos(ce), where sin(ce / 2) is half.
        slope, cosine = F.sqrt(1 - half * half) / radius, 1 - half * half * 2
        lam = F.atan2(u * slope / d, cosine * c0 - v * slope * (d * s0))
        return lam / DEGREE + lon0, _latitude(cosine * s0 + v * slope * (d * c0)) / DEGREE
    n, k = _cone(kind, parallels)
    sign, down = math.copysign(1.0, n), F.lit(_origin_radius(kind, lat0, n, k)) - v
    rho = F.sqrt(u * u + down * down)
    theta = F.atan2(u * sign, down * sign)
    lon = theta / (n * DEGREE) + lon0
    if kind == "aea":
        return lon, _latitude((F.lit(k) - rho * rho * (n / RADIUS) ** 2) / (n * QP)) / DEGREE
    up = F.log(F.when(rho > 0, rho) / abs(RADIUS * k)) / -n
    return lon, _series(F.atan(F.sinh(up)), FROM_CONFORMAL) / DEGREE
