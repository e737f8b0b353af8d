"""Map projections and distances on the ellipsoid as Columns.

Every formula is a fixed number of steps: series in the ellipsoid's third flattening n up
to its fourth power (what is left out is under a micrometre on the earth), so there is no
loop, no Python worker and nothing that a row could keep from ending.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84, and the United States survey foot in metres.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
SURVEY_FOOT = 1200 / 3937


@dataclass(frozen=True)
class Projection:
    """A conic (two standard parallels) or transverse Mercator plane; angles in degrees, false origin in its own unit."""

    kind: str
    lat0: float
    lon0: float
    east: float
    north: float
    parallels: tuple[float, float] = (0.0, 0.0)
    scale: float = 1.0
    unit: float = 1.0
    a: float = 6_378_137.0
    f: float = 1 / 298.257222101

    def __post_init__(self):
        if self.kind not in ("conic", "transverse"):
            raise ValueError(f"no projection {self.kind}")


# The state's three zones in feet, by their register number.
ZONES = {
    2881: Projection("transverse", 24 + 1 / 3, -81.0, 200_000 / SURVEY_FOOT, 0.0, scale=1 - 1 / 17000, unit=SURVEY_FOOT),
    2882: Projection("transverse", 24 + 1 / 3, -82.0, 200_000 / SURVEY_FOOT, 0.0, scale=1 - 1 / 17000, unit=SURVEY_FOOT),
    2883: Projection("conic", 29.0, -84.5, 600_000 / SURVEY_FOOT, 0.0, parallels=(30.75, 29 + 7 / 12), unit=SURVEY_FOOT),
}
_PYTHON = SimpleNamespace(**{name: getattr(math, name) for name in ("sin", "cos", "tan", "asin", "atan", "atan2", "sinh", "cosh", "exp", "log", "sqrt")})
_COLUMNS = SimpleNamespace(**{name: getattr(F, name) for name in ("sin", "cos", "tan", "asin", "atan", "atan2", "sinh", "cosh", "exp", "log", "sqrt")})


def projection_of(text: str) -> Projection:
    """The plane that a projection file (well-known text) describes."""
    number = r"\s*,\s*(-?[\d.]+(?:[eE][+-]?\d+)?)"
    kind = re.search(r'PROJECTION\["([^"]+)"', text, re.I)
    if kind is None:
        raise ValueError("no plane: the text names no projection")
    name = kind[1].lower()
    told = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)"' + number, text, re.I)}
    spheroid = re.search(r'SPHEROID\["[^"]*"' + number + number, text, re.I)
    units = re.findall(r'UNIT\["[^"]*"' + number, text, re.I)
    unit = float(units[-1])
    a, inverse = float(spheroid[1]), float(spheroid[2])
    common = dict(lat0=told.get("latitude_of_origin", 0.0), lon0=told["central_meridian"], east=told.get("false_easting", 0.0), north=told.get("false_northing", 0.0), unit=unit, a=a, f=1 / inverse if inverse else 0.0)
    if name.startswith("lambert_conformal_conic"):
        first = told.get("standard_parallel_1", common["lat0"])
        return Projection("conic", parallels=(first, told.get("standard_parallel_2", first)), scale=told.get("scale_factor", 1.0), **common)
    if name in ("transverse_mercator", "gauss_kruger"):
        return Projection("transverse", scale=told.get("scale_factor", 1.0), **common)
    raise ValueError(f"no projection {kind[1]}")


def projection_text(p: Projection) -> str:
    """Well-known text of a plane, which ``projection_of`` reads."""
    kind = "Lambert_Conformal_Conic" if p.kind == "conic" else "Transverse_Mercator"
    values = {"False_Easting": p.east, "False_Northing": p.north, "Central_Meridian": p.lon0, "Scale_Factor": p.scale, "Latitude_Of_Origin": p.lat0}
    if p.kind == "conic":
        values |= {"Standard_Parallel_1": p.parallels[0], "Standard_Parallel_2": p.parallels[1]}
    listed = ",".join(f'PARAMETER["{k}",{v!r}]' for k, v in values.items())
    return f'PROJCS["plane",GEOGCS["geographic",DATUM["datum",SPHEROID["spheroid",{p.a!r},{1 / p.f if p.f else 0.0!r}]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["{kind}"],{listed},UNIT["unit",{p.unit!r}]]'


def _series(m, steps: list[float], angle, of=None):
    """Sum of steps[k] sin(2 (k + 1) angle)."""
    total = 0.0
    for k, step in enumerate(steps, 1):
        total = m.sin(angle * (2 * k)) * step + total
    return total


def _conformal(m, p: Projection, phi):
    """Isometric latitude of a latitude in radians."""
    e = math.sqrt(p.f * (2 - p.f))
    s = m.sin(phi)
    return 0.5 * m.log((1 + s) / (1 - s)) - (e / 2) * m.log((1 + e * s) / (1 - e * s))


def _latitude(m, p: Projection, chi):
    """Latitude of a conformal latitude, in radians."""
    n = p.f / (2 - p.f)
    return chi + _series(m, [2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4], chi)


def _cone(p: Projection) -> tuple[float, float, float]:
    """The cone's constant, its radius factor and the radius of the origin, in metres."""
    e2 = p.f * (2 - p.f)

    def width(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    first, second = map(math.radians, p.parallels)
    n = math.sin(first) if math.isclose(first, second) else math.log(width(first) / width(second)) / (_conformal(_PYTHON, p, second) - _conformal(_PYTHON, p, first))
    factor = p.a * p.scale * width(first) / n * math.exp(n * _conformal(_PYTHON, p, first))
    return n, factor, factor * math.exp(-n * _conformal(_PYTHON, p, math.radians(p.lat0)))


def _transverse(p: Projection) -> tuple[float, list[float], list[float]]:
    """Metres of a radian, and the series there and back."""
    n = p.f / (2 - p.f)
    there = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]
    back = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]
    return p.scale * p.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), there, back


def _plane(m, p: Projection, lon, lat):
    """x and y in the plane's unit, of degrees."""
    phi, turn = lat * (math.pi / 180), (lon - p.lon0) * (math.pi / 180)
    if p.kind == "conic":
        n, factor, origin = _cone(p)
        radius = factor * m.exp(-n * _conformal(m, p, phi))
        x, y = radius * m.sin(n * turn), origin - radius * m.cos(n * turn)
    else:
        size, there, _ = _transverse(p)
        q = _conformal(m, p, phi)
        t = m.sinh(q)
        xi, eta = m.atan2(t, m.cos(turn)), m.sin(turn) / m.sqrt(t * t + m.cos(turn) * m.cos(turn))
        eta = 0.5 * m.log((m.sqrt(1 + eta * eta) + eta) / (m.sqrt(1 + eta * eta) - eta))  # the inverse of sinh, odd in its sign
        x, y = eta, xi
        for k, step in enumerate(there, 1):
            x = x + step * m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k))
            y = y + step * m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k))
        x, y = x * size, y * size - _origin(p)
    return x / p.unit + p.east, y / p.unit + p.north


def _origin(p: Projection) -> float:
    """Metres from the equator to the origin's latitude on a transverse plane."""
    size, there, _ = _transverse(p)
    chi = math.atan(math.sinh(_conformal(_PYTHON, p, math.radians(p.lat0))))
    return size * (chi + _series(_PYTHON, there, chi))


def _degrees(m, p: Projection, x, y):
    """Longitude and latitude in degrees, of the plane's unit."""
    x, y = (x - p.east) * p.unit, (y - p.north) * p.unit
    if p.kind == "conic":
        n, factor, origin = _cone(p)
        side = 1.0 if n > 0 else -1.0
        down = origin - y
        radius = m.sqrt(x * x + down * down)
        turn = m.atan2(x * side, down * side) / n
        chi = math.pi / 2 - 2 * m.atan(m.exp(m.log(radius / abs(factor)) / n))
    else:
        size, _, back = _transverse(p)
        xi, eta = (y + _origin(p)) / size, x / size
        north, east = xi, eta
        for k, step in enumerate(back, 1):
            north = north - step * m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k))
            east = east - step * m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k))
        turn = m.atan2(m.sinh(east), m.cos(north))
        chi = m.asin(m.sin(north) / m.cosh(east))
    return turn * (180 / math.pi) + p.lon0, _latitude(m, p, chi) * (180 / math.pi)


def to_plane(p: Projection, lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y of a longitude and a latitude."""
    return _plane(_COLUMNS, p, lon, lat)


def to_degrees(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place in the plane."""
    return _degrees(_COLUMNS, p, x, y)


#: Steps of the inverse geodesic; each takes three digits off the error of the one before, more or less.
GEODESIC_STEPS = 5
#: The ellipsoid's distance differs from the mean sphere's by less than this share.
SPHERE_SHARE = 0.006


def _let(values: dict[str, Column], say) -> Column:
    """``say`` of a struct of values, which is worked out once however often it is named."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), say)[0]


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, steps: int = GEODESIC_STEPS) -> Column:
    """Metres between two places on the WGS 84 ellipsoid, by a fixed number of steps.

    Places that lie nearly opposite on the earth don't settle in a few steps and give null;
    up to 19,900 km all do. Values that a step needs more than once are bound in a struct,
    so the plan stays as long as its steps are few.
    """
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    reduced = lambda lat: F.atan(F.tan(F.radians(lat)) * (1 - f))
    ends = {"u": reduced(lat1), "v": reduced(lat2), "l": F.radians(lon2) - F.radians(lon1)}

    def with_sines(e: Column) -> Column:
        return _let({"su": F.sin(e["u"]), "cu": F.cos(e["u"]), "sv": F.sin(e["v"]), "cv": F.cos(e["v"]), "l": e["l"]}, settled)

    def angles(e: Column, turn: Column, say) -> Column:
        """The arc, the azimuth at the equator and the arc's middle for a turn on the sphere."""
        def first(t: Column) -> Column:
            cross = e["cu"] * e["sv"] - e["su"] * e["cv"] * t["ct"]
            return _let({"ss": F.sqrt(e["cv"] * t["st"] * e["cv"] * t["st"] + cross * cross), "cs": e["su"] * e["sv"] + e["cu"] * e["cv"] * t["ct"], "st": t["st"]}, second)

        def second(t: Column) -> Column:
            return _let({"ss": t["ss"], "cs": t["cs"], "s": F.atan2(t["ss"], t["cs"]), "sa": F.when(t["ss"] == 0, 0.0).otherwise(F.try_divide(e["cu"] * e["cv"] * t["st"], t["ss"]))}, third)

        def third(t: Column) -> Column:
            return _let({"ss": t["ss"], "cs": t["cs"], "s": t["s"], "sa": t["sa"], "ca": 1 - t["sa"] * t["sa"]}, fourth)

        def fourth(t: Column) -> Column:
            middle = F.when(t["ca"] < 1e-15, 0.0).otherwise(t["cs"] - 2 * e["su"] * e["sv"] / F.greatest(t["ca"], F.lit(1e-15)))
            return _let({"ss": t["ss"], "cs": t["cs"], "s": t["s"], "sa": t["sa"], "ca": t["ca"], "cm": middle, "c": f / 16 * t["ca"] * (4 + f * (4 - 3 * t["ca"]))}, say)

        return _let({"st": F.sin(turn), "ct": F.cos(turn)}, first)

    def settled(e: Column) -> Column:
        def step(now: Column, _: Column) -> Column:
            further = lambda t: e["l"] + (1 - t["c"]) * f * t["sa"] * (t["s"] + t["c"] * t["ss"] * (t["cm"] + t["c"] * t["cs"] * (2 * t["cm"] * t["cm"] - 1)))
            return F.struct(now["turn"].alias("before"), angles(e, now["turn"], further).alias("turn"))

        start = F.struct(F.lit(100.0).alias("before"), e["l"].alias("turn"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda now: F.when(F.abs(now["turn"] - now["before"]) < 1e-11, angles(e, now["turn"], length)))

    def length(t: Column) -> Column:
        u2 = t["ca"] * ((a * a - b * b) / (b * b))
        return _let({"t": t, "u2": u2}, lambda w: _let({"t": w["t"], "k1": 1 + w["u2"] / 16384 * (4096 + w["u2"] * (-768 + w["u2"] * (320 - 175 * w["u2"]))), "k": w["u2"] / 1024 * (256 + w["u2"] * (-128 + w["u2"] * (74 - 47 * w["u2"])))}, metres))

    def metres(w: Column) -> Column:
        t, k = w["t"], w["k"]
        m = t["cm"]
        off = k * t["ss"] * (m + k / 4 * (t["cs"] * (2 * m * m - 1) - k / 6 * m * (4 * t["ss"] * t["ss"] - 3) * (4 * m * m - 3)))
        return b * w["k1"] * (t["s"] - off)

    return _let(ends, with_sines)
