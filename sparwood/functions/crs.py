"""Map projections as Column arithmetic, each with its inverse: Lambert's conformal conic (EPSG:3301, and the weather model's on a
sphere), Lambert's azimuthal equal-area (the radar composite's) and Mercator's (web maps').

The formulas are Snyder's (USGS Professional Paper 1395) on an ellipsoid; on a sphere the flattening is 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Conic:
    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float
    y0: float
    a: float = 6378137.0
    f: float = 1 / 298.257222101

    @property
    def e(self) -> float:
        return math.sqrt(2 * self.f - self.f**2)

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.e * math.sin(lat)) ** 2)

    def _t(self, lat: float) -> float:
        s = self.e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def constants(self) -> tuple[float, float, float]:
        """n, a F, rho0."""
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        m1, m2, t1, t2 = self._m(p1), self._m(p2), self._t(p1), self._t(p2)
        n = (math.log(m1) - math.log(m2)) / (math.log(t1) - math.log(t2)) if p1 != p2 else math.sin(p1)
        af = self.a * m1 / (n * t1**n)
        return n, af, af * self._t(p0) ** n


@dataclass(frozen=True)
class Azimuthal:
    """Equal-area about a centre."""

    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def e(self) -> float:
        return math.sqrt(2 * self.f - self.f**2)


@dataclass(frozen=True)
class Mercator:
    """On a sphere, as web maps are."""

    a: float = 6378137.0


#: Estonian national grid, the Nordic weather model's cone on a sphere, the radar composite's plane, web maps.
ESTONIA = Conic(59 + 1 / 3, 58.0, 57.5175539305556, 24.0, 500000.0, 6375000.0)
NORDIC = Conic(63.0, 63.0, 63.0, 15.0, 0.0, 0.0, 6371000.0, 0.0)
RADAR = Azimuthal(55.0, 10.0, 1950000.0, -2100000.0)
WEB = Mercator()

Projection = Conic | Azimuthal | Mercator


def parse(definition: str) -> Projection:
    """The projection of a definition text as rasters carry it (+proj=laea, lcc or merc with their parameters); others are an error."""
    p = dict(w[1:].partition("=")[::2] for w in definition.split() if w.startswith("+"))
    num = lambda k, default=0.0: float(p.get(k) or default)
    flat = {"WGS84": 1 / 298.257223563, "GRS80": 1 / 298.257222101}.get(p.get("ellps") or p.get("datum") or "WGS84", 1 / 298.257223563)
    a, f = (num("R"), 0.0) if "R" in p else (num("a", 6378137.0), 1 - num("b") / num("a") if "a" in p and "b" in p else flat)
    if p.get("proj") == "laea":
        return Azimuthal(num("lat_0"), num("lon_0"), num("x_0"), num("y_0"), a, f)
    if p.get("proj") == "lcc":
        return Conic(num("lat_1"), num("lat_2", num("lat_1")), num("lat_0"), num("lon_0"), num("x_0"), num("y_0"), a, f)
    if p.get("proj") == "merc":
        return Mercator(a)
    raise ValueError(f"unknown projection: {definition}")


def _authalic(s: Column, e: float) -> Column:
    """Snyder's q of the sine of a latitude."""
    if not e:
        return 2 * s
    return (1 - e * e) * (s / (1 - (e * s) ** 2) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))


def _plane(c: Azimuthal) -> tuple[float, float, float, float]:
    """q at the pole, radius of the sphere of equal area, authalic latitude of the centre, scale."""
    q = lambda s: 2 * s if not c.e else (1 - c.e**2) * (s / (1 - (c.e * s) ** 2) - math.log((1 - c.e * s) / (1 + c.e * s)) / (2 * c.e))
    p0 = math.radians(c.lat0)
    qp = q(1.0)
    b0, rq = math.asin(q(math.sin(p0)) / qp), c.a * math.sqrt(qp / 2)
    m0 = math.cos(p0) / math.sqrt(1 - (c.e * math.sin(p0)) ** 2)
    return qp, rq, b0, c.a * m0 / (rq * math.cos(b0))


def forward(lon: Column, lat: Column, c: Projection = ESTONIA) -> tuple[Column, Column]:
    """Easting and northing of degrees."""
    if isinstance(c, Mercator):
        return c.a * F.radians(lon), c.a * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))
    if isinstance(c, Azimuthal):
        qp, rq, b0, d = _plane(c)
        beta, lam = F.asin(_authalic(F.sin(F.radians(lat)), c.e) / qp), F.radians(lon - c.lon0)
        b = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(lam)))
        return c.x0 + b * d * F.cos(beta) * F.sin(lam), c.y0 + b / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(lam))
    n, af, rho0 = c.constants()
    phi = F.radians(lat)
    s = c.e * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(c.e / 2))
    rho, theta = af * F.pow(t, F.lit(n)), n * F.radians(lon - c.lon0)
    return c.x0 + rho * F.sin(theta), c.y0 + rho0 - rho * F.cos(theta)


def inverse(x: Column, y: Column, c: Projection = ESTONIA) -> tuple[Column, Column]:
    """Degrees of easting and northing; eight rounds of the latitude's fixed point leave an error below 1e-15."""
    if isinstance(c, Mercator):
        return F.degrees(x / c.a), F.degrees(2 * F.atan(F.exp(y / c.a)) - math.pi / 2)
    if isinstance(c, Azimuthal):
        return _inverse_plane(x - c.x0, y - c.y0, c)
    n, af, rho0 = c.constants()
    dx, dy = x - c.x0, rho0 - (y - c.y0)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / af, F.lit(1 / n))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(8):
        s = c.e * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(c.e / 2)))
    return F.degrees(F.atan2(dx, dy) / n) + c.lon0, F.degrees(phi)


def _inverse_plane(dx: Column, dy: Column, c: Azimuthal) -> tuple[Column, Column]:
    qp, rq, b0, d = _plane(c)
    rho = F.sqrt((dx / d) ** 2 + (dy * d) ** 2)
    ce = 2 * F.asin(rho / (2 * rq))
    at = F.when(rho == 0, F.lit(b0)).otherwise(F.asin(F.cos(ce) * math.sin(b0) + dy * d * F.sin(ce) * math.cos(b0) / rho))
    lam = F.atan2(dx * F.sin(ce), d * rho * math.cos(b0) * F.cos(ce) - d * d * dy * math.sin(b0) * F.sin(ce))
    lon = F.when(rho == 0, F.lit(c.lon0)).otherwise(c.lon0 + F.degrees(lam))
    q, e2 = qp * F.sin(at), c.e**2
    # Authalic to geographic latitude by Newton's steps; near the poles the first guess is good enough.
    phi = at + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * at) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * at) + 761 * e2**3 / 45360 * F.sin(6 * at)
    s = F.sin(phi)
    step = (1 - e2 * s * s) ** 2 / (2 * F.cos(phi)) * (q - _authalic(s, c.e)) / (1 - e2)
    return lon, F.degrees(phi + F.when(F.abs(F.cos(phi)) > 1e-6, step).otherwise(0.0))


def reproject(x: Column, y: Column, source: Projection, target: Projection = ESTONIA) -> tuple[Column, Column]:
    return forward(*inverse(x, y, source), target)


def northing_first(x: Column, y: Column) -> Column:
    """A point as servers with northing-first axes want it in a filter."""
    return F.concat(F.lit("POINT("), y.cast("string"), F.lit(" "), x.cast("string"), F.lit(")"))


def annulus(x: Column, y: Column, cx: float, cy: float, outer: float, inner: float = 0.0) -> Column:
    """Within outer (inclusive) and beyond inner; without inner the whole disc."""
    if inner >= outer:
        raise ValueError("the inner radius must be smaller than the outer one")
    d = F.hypot(x - cx, y - cy)
    return (d <= outer) & (d > inner) if inner else d <= outer
