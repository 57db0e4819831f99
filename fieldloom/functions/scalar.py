"""Column functions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable(x: Column | str, places: int = 6) -> Column:
    """Round with a small offset, so that exact halves do not depend on the order of a sum."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, places)


def null_if_nan(x: Column) -> Column:
    """NaN counts as null everywhere in this package."""
    return F.when(~F.isnan(x), x)


def row_sum(*columns: Column | str) -> Column:
    """Sum over columns where null counts as zero."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in columns))


def iou(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def argmax(values: Column) -> Column:
    """Zero-based place of the maximum, the first on a tie."""
    return F.array_position(values, F.array_max(values)) - 1


def argmin(values: Column) -> Column:
    return F.array_position(values, F.array_min(values)) - 1


def lag_differences(values: Column, lag: int = 2, size: int = 6) -> Column:
    """x[t] - x[t - lag] for t = lag .. size - 1."""
    return F.transform(F.sequence(F.lit(lag), F.lit(size - 1)), lambda t: F.get(values, t) - F.get(values, t - lag))


def box_overlap(a: str, b: str) -> Column:
    """Shared area of two boxes given as structs of x0, y0, w, h."""
    width = F.least(F.col(f"{a}.x0") + F.col(f"{a}.w"), F.col(f"{b}.x0") + F.col(f"{b}.w")) - F.greatest(f"{a}.x0", f"{b}.x0")
    height = F.least(F.col(f"{a}.y0") + F.col(f"{a}.h"), F.col(f"{b}.y0") + F.col(f"{b}.h")) - F.greatest(f"{a}.y0", f"{b}.y0")
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def country_uid(code: Column, number: Column) -> Column:
    """Code and zero-padded number as one integer."""
    return F.format_string("%d%07d", code, number).cast("long")


def kelvin_to_celsius(x: Column) -> Column:
    return x - 273.15


def daily_metres_to_yearly_mm(x: Column) -> Column:
    return 365 * x * 1000


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P^2, null without a perimeter."""
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter))


def reflectance(x: Column) -> Column:
    """Scaled integers to [.., 1]; null counts as zero."""
    return F.coalesce(F.least(x / 10000, F.lit(1.0)), F.lit(0.0))


def position_similarity(distance: Column, a: Column, b: Column) -> Column:
    return 1 - distance / (2 * F.sqrt((a + b) / F.pi()))


def laea_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of European equal-area coordinates (easting x, northing y in metres).

    Inverse of the ellipsoidal Lambert azimuthal equal-area projection, by the published series
    for the authalic latitude."""
    # fixed values: GRS 80 and the European grid's origin (52 N, 10 E, false easting and northing)
    a, e2, lat0, lon0, x0, y0 = 6378137.0, 0.006694380022900787, math.radians(52), math.radians(10), 4321000.0, 3210000.0
    e = math.sqrt(e2)

    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    qp = q(math.pi / 2)
    beta0, rq = math.asin(q(lat0) / qp), a * math.sqrt(qp / 2)
    d = a * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
    east, north = (x - x0) / d, (y - y0) * d
    rho = F.hypot(east, north)
    c = 2 * F.asin(rho / (2 * rq))
    ratio = F.when(rho > 0, north * F.sin(c) / rho).otherwise(0.0)
    beta = F.asin(F.cos(c) * math.sin(beta0) + ratio * math.cos(beta0))
    lon = lon0 + F.atan2((x - x0) * F.sin(c), d * rho * math.cos(beta0) * F.cos(c) - d * d * (y - y0) * math.sin(beta0) * F.sin(c))
    e4, e6 = e2 * e2, e2**3
    lat = (
        beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    return F.degrees(F.when(rho > 0, lon).otherwise(lon0)), F.degrees(lat)


def hyperbolised(x: Column, low: Column, high: Column, power: float = 0.8) -> Column:
    """Fuzzy histogram hyperbolisation of a value between bounds, to [0, 1]."""
    grey = F.pow((x - low) / (high - low), power)
    return F.when(high > low, (F.exp(-grey) - 1) / (math.exp(-1) - 1))
