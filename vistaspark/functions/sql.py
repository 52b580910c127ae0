"""The functions for SQL (survey 2.14): ``register(spark)``, then ``spark.sql`` can use them.

Scalar functions are SQL functions, which Spark puts into the plan as expressions. Those that
give rows are table functions for a LATERAL join with the rows they depend on; what they make
of a row is made at once in numpy and goes back in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vistaspark.functions.geo import DEGREE_M, EARTH_M, REFRACTION
from vistaspark.operators.horizon import march_steps

_SHORT = "d - 2 * pi() * ceil((d - pi()) / (2 * pi()))"
_BEARING = "atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))"
#: name, arguments, expression; all numbers are doubles.
SCALARS = {
    "drop_m": ("d DOUBLE", f"d * d * {(1 - REFRACTION) / (2 * EARTH_M)!r}"),
    "distance_m": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        f"2 * {EARTH_M}D * asin(least(1D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "azimuth": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        f"CASE WHEN {_BEARING} < 0 THEN {_BEARING} + 2 * pi() ELSE {_BEARING} END",
    ),
    "normalize_lon": ("lon DOUBLE", "pmod(lon + 180D, 360D) - 180D"),
    "wrap_angle": ("d DOUBLE", _SHORT),
    "elevation_angle": ("h_from DOUBLE, h_to DOUBLE, d DOUBLE", f"atan2(h_to - h_from - d * d * {(1 - REFRACTION) / (2 * EARTH_M)!r}, d)"),
    "isolation_weight": ("iso_m DOUBLE", f"CASE WHEN iso_m IS NULL THEN 1D ELSE 0.55D + 0.45D * least(1D, greatest(0D, ln(greatest(iso_m, 1D) / 300D) / {math.log(100.0)!r}D)) END"),
    "label_score": ("ele DOUBLE, d DOUBLE, iso_m DOUBLE", f"coalesce(ele, 0D) * (1D + 0.4D * exp(-d / 40000D)) * CASE WHEN iso_m IS NULL THEN 1D ELSE 0.55D + 0.45D * least(1D, greatest(0D, ln(greatest(iso_m, 1D) / 300D) / {math.log(100.0)!r}D)) END"),
    "planar_km": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", f"sqrt(power((lat2 - lat1) * {DEGREE_M / 1000!r}D, 2) + power((lon2 - lon1) * {DEGREE_M / 1000!r}D * cos(radians(lat1)), 2))"),
}


def _said(*values: float | None) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


@udtf(returnType="step int, d double, lat double, lon double", useArrow=True)
class RaySteps:
    """The samples of a ray: ``ray_steps(lat, lon, azimuth, start, reach)``; nothing for a null argument."""

    def eval(self, lat: float, lon: float, azimuth: float, start: float, reach: float):
        if not _said(lat, lon, azimuth, start, reach):
            return
        d = np.array(march_steps(float(start), float(reach)), float)
        p, w, z = math.radians(lat), d / EARTH_M, float(azimuth)
        sine = np.clip(math.sin(p) * np.cos(w) + math.cos(p) * np.sin(w) * math.cos(z), -1, 1)
        to = np.degrees(math.radians(lon) + np.arctan2(math.sin(z) * np.sin(w) * math.cos(p), np.cos(w) - math.sin(p) * sine))
        yield from zip(range(len(d)), d.tolist(), np.degrees(np.arcsin(sine)).tolist(), ((to + 180) % 360 - 180).tolist(), strict=True)


@udtf(returnType="tx bigint, ty bigint", useArrow=True)
class TileKeysInBbox:
    """The tiles of a grid from (-180, 90) that a box touches: ``tile_keys_in_bbox(min_lat, min_lon, max_lat, max_lon, degrees)``; a box whose west lies east of its east crosses the antimeridian."""

    def eval(self, min_lat: float, min_lon: float, max_lat: float, max_lon: float, degrees: float):
        if not _said(min_lat, min_lon, max_lat, max_lon, degrees) or degrees <= 0:
            return
        south, west, north, east, step = map(float, (min_lat, min_lon, max_lat, max_lon, degrees))
        parts = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
        across = sorted({x for a, b in parts for x in range(math.floor((a + 180) / step), math.ceil((b + 180) / step))})
        down = range(math.floor((90 - north) / step), math.ceil((90 - south) / step))
        yield from ((x, y) for x in across for y in down)


TABLES = {"ray_steps": RaySteps, "tile_keys_in_bbox": TileKeysInBbox}


def register(spark: SparkSession) -> None:
    """Make all functions known to the session's SQL."""
    for name, (arguments, expression) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {expression}")
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
