"""What a warp asks for, checked before any Spark job starts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from gridloom.functions.crs import normalise

METHODS = ("near", "bilinear", "cubic", "cubicspline", "lanczos", "average", "rms", "mode", "max", "min", "med", "q1", "q3", "sum")


@dataclass(frozen=True)
class OutGrid:
    """A north-up grid: the outer corner, cell sizes and counts."""

    xmin: float
    ymax: float
    xres: float
    yres: float
    width: int
    height: int
    crs: str | None = None


@dataclass(frozen=True)
class WarpSpec:
    """te is (xmin, ymin, xmax, ymax) in te_srs, else in t_srs; tr a cell size and ts a cell count, x before y."""

    te: tuple[float, float, float, float] | None = None
    t_srs: str | None = None
    te_srs: str | None = None
    tr: tuple[float, float] | None = None
    ts: tuple[int, int] | None = None
    tap: bool = True
    method: str = "near"
    bands: tuple[int, ...] = ()
    overview: int | None = None
    margin: int = 8
    max_bytes: float = 4e9

    def __post_init__(self):
        for name in (self.t_srs, self.te_srs):
            if name is not None:
                normalise(name)
        if self.te is not None and (len(self.te) != 4 or not all(map(math.isfinite, self.te)) or self.te[0] >= self.te[2] or self.te[1] >= self.te[3]):
            raise ValueError("te must be xmin, ymin, xmax, ymax, in this order")
        if self.tr is not None and self.ts is not None:
            raise ValueError("give a cell size or a cell count, not both")
        for pair in (self.tr, self.ts):
            if pair is not None and (len(pair) != 2 or min(pair) <= 0):
                raise ValueError("cell sizes and counts are two positive numbers")
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; there are {', '.join(METHODS)}")
        if any(b < 1 for b in self.bands):
            raise ValueError("bands are numbered from 1")
        if self.margin < 0 or self.max_bytes <= 0 or (self.overview is not None and self.overview < 1):
            raise ValueError("margin, max_bytes and overview must not be negative")

    def grid(self) -> OutGrid:
        """The output grid of an explicit extent: tr rounds the cell count, tap first moves the extent out to multiples
        of tr, ts is taken as it is."""
        if self.te is None or (self.tr is None and self.ts is None):
            raise ValueError("an output grid needs te and one of tr and ts; windows.output_grid finds them from a catalog")
        if self.te_srs is not None and (self.t_srs is None or normalise(self.te_srs) != normalise(self.t_srs)):
            raise ValueError("te is in another system; windows.output_grid transforms it")
        xmin, ymin, xmax, ymax = self.te
        if self.ts is not None:
            width, height = self.ts
            xres, yres = (xmax - xmin) / width, (ymax - ymin) / height
        else:
            xres, yres = self.tr
            if self.tap:
                xmin, xmax = math.floor(xmin / xres) * xres, math.ceil(xmax / xres) * xres
                ymin, ymax = math.floor(ymin / yres) * yres, math.ceil(ymax / yres) * yres
            width, height = round((xmax - xmin) / xres), round((ymax - ymin) / yres)
        if width < 1 or height < 1 or width * height >= 2**31 - 1:
            raise ValueError("the output would be empty or too large")
        return OutGrid(xmin, ymax, xres, yres, width, height, self.t_srs and normalise(self.t_srs))


def methods_for(r: str | list[str] | None, n: int) -> list[str]:
    """A resampling method for each of n sources: none given is near, a single one holds for all."""
    given = ["near"] if r is None else [r] if isinstance(r, str) else list(r)
    given = given * n if len(given) == 1 else given
    if len(given) != n:
        raise ValueError(f"{len(given)} methods for {n} sources")
    for m in given:
        if m not in METHODS:
            raise ValueError(f"unknown method {m!r}")
    return given
