"""Magnetic declination by a spherical-harmonic model (survey G24, S15)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ellipsoid and the model's sphere in kilometres, the years about the epoch for which it is extended.
SEMI_MAJOR, ECCENTRICITY2, SPHERE, YEARS = 6378.137, 0.00669437999014, 6371.2, (-1.0, 6.0)


def field_angle(lat: np.ndarray, lon: np.ndarray, years: np.ndarray, rows: list[tuple]) -> np.ndarray:
    """Degrees east of north of the field at sea level; ``rows``: n, m, g, h, gt, ht."""
    phi, lam = np.radians(lat), np.radians(lon)
    normal = SEMI_MAJOR / np.sqrt(1 - ECCENTRICITY2 * np.sin(phi) ** 2)
    p, z = normal * np.cos(phi), normal * (1 - ECCENTRICITY2) * np.sin(phi)
    r = np.hypot(p, z)
    geocentric = np.arcsin(z / r)
    cos, sin = np.sin(geocentric), np.maximum(np.cos(geocentric), 1e-10)  # of the colatitude
    legendre, slope = {(0, 0): np.ones_like(phi)}, {(0, 0): np.zeros_like(phi)}
    zero = np.zeros_like(phi)
    north, east, down = zero.copy(), zero.copy(), zero.copy()
    dt = np.clip(years, *YEARS)
    model = {(int(n), int(m)): (g + dt * gt, h + dt * ht) for n, m, g, h, gt, ht in rows}
    for n in range(1, max((n for n, _ in model), default=0) + 1):
        for m in range(n + 1):
            if m == n:
                k = 1.0 if n == 1 else np.sqrt(1 - 0.5 / n)
                legendre[n, m] = k * sin * legendre[n - 1, n - 1]
                slope[n, m] = k * (sin * slope[n - 1, n - 1] + cos * legendre[n - 1, n - 1])
            else:
                a, b, c = 2 * n - 1, np.sqrt((n - 1) ** 2 - m * m) if n - 1 > m else 0.0, np.sqrt(n * n - m * m)
                legendre[n, m] = (a * cos * legendre[n - 1, m] - b * legendre.get((n - 2, m), zero)) / c
                slope[n, m] = (a * (cos * slope[n - 1, m] - sin * legendre[n - 1, m]) - b * slope.get((n - 2, m), zero)) / c
            if (n, m) in model:
                g, h = model[n, m]
                wave, turned = g * np.cos(m * lam) + h * np.sin(m * lam), g * np.sin(m * lam) - h * np.cos(m * lam)
                near = (SPHERE / r) ** (n + 2)
                north += near * wave * slope[n, m]
                east += near * m * turned * legendre[n, m] / sin
                down -= near * (n + 1) * wave * legendre[n, m]
    tilt = geocentric - phi
    return np.degrees(np.arctan2(east, north * np.cos(tilt) - down * np.sin(tilt)))


def declination(coefficients: DataFrame, epoch: float):
    """A function of latitude, longitude and decimal year, as Columns, to the declination in degrees.

    ``coefficients`` (n, m, g, h, gt, ht): some ninety rows of a model, see ``read_coefficients``.
    """
    rows = [tuple(r) for r in coefficients.select("n", "m", "g", "h", "gt", "ht").collect()]

    @F.pandas_udf("double")
    def angle(lat: pd.Series, lon: pd.Series, year: pd.Series) -> pd.Series:
        return pd.Series(field_angle(lat.to_numpy(), lon.to_numpy(), year.to_numpy() - epoch, rows))

    def at(lat: Column, lon: Column, year: Column) -> Column:
        return angle(lat.cast("double"), lon.cast("double"), year.cast("double"))

    return at
