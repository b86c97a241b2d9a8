"""Column builders: bands, clips, units, indices, projected geometry. All stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: square feet in a square metre of international feet.
SQFT_PER_SQM = 1 / 0.3048**2
#: WGS84.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def step_down(x: Column, steps: list, otherwise: Column | float) -> Column:
    """Value of the first (threshold, value) with x >= threshold; otherwise for a null x or one below all."""
    out = None
    for threshold, value in steps:
        out = F.when(x >= threshold, F.lit(float(value))) if out is None else out.when(x >= threshold, F.lit(float(value)))
    return out.otherwise(otherwise)


def step_up(x: Column, steps: list, otherwise: Column | float) -> Column:
    """Value of the first (limit, value) with x <= limit."""
    out = None
    for limit, value in steps:
        out = F.when(x <= limit, F.lit(float(value))) if out is None else out.when(x <= limit, F.lit(float(value)))
    return out.otherwise(otherwise)


def digitize(x: Column, bounds: list) -> Column:
    """Number of bounds at or below x."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(v) for k, x in table.items() for v in (k, float(x))])[key]


def gated_band(distance: Column, bands: list, gate: Column) -> Column:
    """Weight of the first (limit, weight, gated) band that holds the distance; gated bands need the gate; else 0."""
    out = None
    for limit, weight, gated in bands:
        inside = (distance <= limit) & gate if gated else distance <= limit
        out = F.when(inside, F.lit(float(weight))) if out is None else out.when(inside, F.lit(float(weight)))
    return out.otherwise(F.lit(0.0))


def field_decay(kind: str, magnitude: Column, distance: Column, max_m: float, rate: float = 3.0) -> Column:
    """Effect at a distance: constant inside, falling linearly to 0 at max_m, or falling by exp(-rate d / max_m) inside."""
    if kind == "step":
        return F.when(distance <= max_m, magnitude).otherwise(0.0)
    if kind == "linear":
        return magnitude * F.greatest(F.lit(0.0), 1 - distance / max_m)
    return F.when(distance <= max_m, magnitude * F.exp(-rate * distance / max_m)).otherwise(0.0)


def wedge(ox: Column, oy: Column, x: Column, y: Column, cx: Column, cy: Column, strength: float) -> Column:
    """strength * (1 + cos of the angle between target and centre, seen from the origin); on the origin 2 * strength."""
    dx, dy, ex, ey = x - ox, y - oy, cx - ox, cy - oy
    size = F.sqrt(dx * dx + dy * dy) * F.sqrt(ex * ex + ey * ey)
    return strength * (1 + F.when(size > 0, (dx * ex + dy * ey) / F.when(size > 0, size)).otherwise(1.0))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return F.when(a + b != 0, (a - b) / F.when(a + b != 0, a + b))


def bare_soil(b02: Column, b04: Column, b08: Column, b11: Column) -> Column:
    return normalized_difference(b11 + b04, b08 + b02)


def gross_yield(monthly_rent: Column, price: Column) -> Column:
    return F.when(price > 0, monthly_rent * 12 / F.when(price > 0, price))


def per_sqm(per_sqft: Column) -> Column:
    return per_sqft * SQFT_PER_SQM


def quarter_end(label: Column) -> Column:
    """Last month of a quarter named like '2024-Q3' or 'FY2024 Q3', as its first day; null for other text."""
    year, quarter = F.regexp_extract(label, r"(\d{4}).*?Q([1-4])", 1), F.regexp_extract(label, r"(\d{4}).*?Q([1-4])", 2)
    return F.when(quarter != "", F.make_date(year.try_cast("int"), quarter.try_cast("int") * 3, F.lit(1)))


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of structs (x, y) in metres."""
    n = F.size(ring)
    cross = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by the parity of edges that a ray crosses."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        split = (p["y"] > y) != (q["y"] > y)
        return F.when(split & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(split, q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def segment_distance(x: Column, y: Column, line: Column) -> Column:
    """Distance from a point to a line of points (x, y)."""

    def to(p: Column, i: Column) -> Column:
        q = F.get(line, i + 1)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p["x"]) * dx + (y - p["y"]) * dy) / F.when(length > 0, length)))).otherwise(0.0)
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    return F.array_min(F.transform(F.slice(line, 1, F.size(line) - 1), to))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in a northern UTM zone, in metres, by the transverse Mercator series."""
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    phi, dlam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183))
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = F.lit(WGS84_A) / F.sqrt(1 - e2 * s * s)
    tt, cc, a = t * t, ep2 * c * c, dlam * c
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = nu * (a + (1 - tt + cc) * a**3 / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * ep2) * a**5 / 120)
    y = m + nu * t * (a * a / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * a**4 / 24 + (61 - 58 * tt + tt * tt + 600 * cc - 330 * ep2) * a**6 / 720)
    return 0.9996 * x + 500000, 0.9996 * y


def from_utm(x: Column, y: Column, zone: int, rounds: int = 6) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a northern UTM zone: steps by the projection's own differences, towards the
    place whose projection it is."""
    lat = F.degrees(y / 0.9996 / WGS84_A)
    lon = F.lit(6.0 * zone - 183) + F.degrees((x - 500000) / 0.9996 / WGS84_A) / F.cos(F.radians(lat))
    place = F.struct(lon.alias("lon"), lat.alias("lat"))

    def step(at: Column, _: Column) -> Column:
        gx, gy = utm(at["lon"], at["lat"], zone)
        better_lat = at["lat"] + F.degrees((y - gy) / 0.9996 / WGS84_A)
        return F.struct((at["lon"] + F.degrees((x - gx) / 0.9996 / WGS84_A) / F.cos(F.radians(at["lat"]))).alias("lon"), better_lat.alias("lat"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place, step)
    return found["lon"], found["lat"]


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))
