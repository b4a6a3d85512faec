"""Vector, geographic, rounding and identifier scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def dot(a: Column, b: Column) -> Column:
    """Inner product accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / n)


def vector_is_valid(a: Column, dimension: int, tolerance: float = 1e-3) -> Column:
    """Right dimension, finite, of unit length."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimension) & finite & (F.abs(norm(a) - 1) <= tolerance), F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def recentred(lat: Column, lon: Column, origin: tuple[float, float], new_origin: tuple[float, float]) -> tuple[Column, Column]:
    """Coordinates with their metre offsets from one origin kept at another."""
    east = (lon - origin[1]) * METRES_PER_DEGREE * F.cos(F.radians(F.lit(origin[0])))
    north = (lat - origin[0]) * METRES_PER_DEGREE
    return new_origin[0] + north / METRES_PER_DEGREE, new_origin[1] + east / (METRES_PER_DEGREE * F.cos(F.radians(F.lit(new_origin[0]))))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(x, digits)


def risk_level(score: Column) -> Column:
    return F.when(score >= 12, "high").when(score >= 6, "medium").otherwise("low")


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.90, "high").when(x >= 0.82, "medium").otherwise("low")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fields_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by a unit separator."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def short_id(prefix: str, text: Column, size: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, size))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUID, version 5: SHA-1 of namespace and name with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
