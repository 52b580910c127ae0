"""Geodesy on a sphere as Column expressions (survey F13, F20, G1-G12, G14-G20, G23, G25)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius and refraction of the terrain model, metres per degree.
EARTH_M, REFRACTION, DEGREE_M = 6371000.0, 0.13, 111320.0
MERCATOR_LIMIT, SLIPPY_LIMIT = 85.0511, 85.05112878


def drop_m(d: Column) -> Column:
    """How far curvature less refraction sinks a point at ``d`` metres."""
    return d * d * ((1 - REFRACTION) / (2 * EARTH_M))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 2 pi)."""
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    a = F.atan2(y, x)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def normalize_lon(lon: Column) -> Column:
    """Longitude in [-180, 180); one that lies there stays as it is, to the last bit, so that it does not cross a cell's edge."""
    return F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)


def destination(lat: Column, lon: Column, az: Column, d: Column) -> tuple[Column, Column]:
    """The point ``d`` metres along a bearing."""
    r, p = d / EARTH_M, F.radians(lat)
    s = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p) * F.cos(r) + F.cos(p) * F.sin(r) * F.cos(az)))
    to = F.degrees(F.radians(lon) + F.atan2(F.sin(az) * F.sin(r) * F.cos(p), F.cos(r) - F.sin(p) * s))
    return F.degrees(F.asin(s)), normalize_lon(to)


def destination_tabled(lat: Column, lon: Column, az: Column, sin_r: Column, cos_r: Column) -> tuple[Column, Column]:
    """As ``destination``, with the sine and cosine of the way's angle out of a table of steps."""
    p = F.radians(lat)
    s = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p) * cos_r + F.cos(p) * sin_r * F.cos(az)))
    to = F.degrees(F.radians(lon) + F.atan2(F.sin(az) * sin_r * F.cos(p), cos_r - F.sin(p) * s))
    return F.degrees(F.asin(s)), normalize_lon(to)


def elevation_angle(h_from: Column, h_to: Column, d: Column) -> Column:
    """Angle above the horizontal under which a height is seen."""
    return F.atan2(h_to - h_from - drop_m(d), d)


def in_bbox(lat: Column, lon: Column, box: str = "") -> Column:
    """Inclusive, and across the antimeridian where min_lon > max_lon."""
    lo, hi = F.col(f"{box}min_lon"), F.col(f"{box}max_lon")
    return lat.between(F.col(f"{box}min_lat"), F.col(f"{box}max_lat")) & F.when(lo <= hi, lon.between(lo, hi)).otherwise((lon >= lo) | (lon <= hi))


def wrap_angle(a: Column) -> Column:
    """Into (-pi, pi]."""
    m = a % (2 * math.pi)
    return F.when(m > math.pi, m - 2 * math.pi).when(m <= -math.pi, m + 2 * math.pi).otherwise(m)


def valid(lat: Column, lon: Column) -> Column:
    """Finite and in range."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def bbox_distance_m(lat: Column, lon: Column, box: str = "") -> Column:
    """Planar distance to a box, 0 inside, by the shorter way round."""
    lo, hi = F.col(f"{box}min_lon"), F.col(f"{box}max_lon")
    dlat = F.greatest(F.lit(0.0), F.col(f"{box}min_lat") - lat, lat - F.col(f"{box}max_lat"))
    gap = lambda a, b: F.pmod(a - b, F.lit(360.0))
    inside = F.when(lo <= hi, lon.between(lo, hi)).otherwise((lon >= lo) | (lon <= hi))
    dlon = F.when(inside, F.lit(0.0)).otherwise(F.least(gap(lo, lon), gap(lon, hi)))
    return F.hypot(dlat * DEGREE_M, dlon * DEGREE_M * F.cos(F.radians(lat)))


def mercator(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """World pixels of 256-pixel tiles."""
    size = 256.0 * (1 << zoom)
    s = F.sin(F.radians(F.least(F.lit(MERCATOR_LIMIT), F.greatest(F.lit(-MERCATOR_LIMIT), lat))))
    return (lon + 180) / 360 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * size


def slippy_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Tile numbers; longitude wraps and latitude clamps."""
    n = 1 << zoom
    x, y = mercator(lat, lon, zoom)
    tx = F.pmod(F.floor(x / 256).cast("long"), F.lit(n))
    return tx, F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(y / 256).cast("long")))


def normalize_azimuth(a: Column) -> Column:
    """Into [0, 2 pi)."""
    return F.pmod(a, F.lit(2 * math.pi))


def bbox_centre(box: str = "") -> tuple[Column, Column]:
    """Centre of a box, taken along the way that it covers."""
    lo, hi = F.col(f"{box}min_lon"), F.col(f"{box}max_lon")
    east = F.when(hi < lo, hi + 360).otherwise(hi)
    return (F.col(f"{box}min_lat") + F.col(f"{box}max_lat")) / 2, normalize_lon((lo + east) / 2)


def unproject(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Latitude and longitude of world pixels."""
    size = 256.0 * (1 << zoom)
    return F.degrees(F.atan(F.sinh(math.pi - 2 * math.pi * y / size))), x / size * 360 - 180


def slippy_pixel(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Place within the tile, in [0, 256)."""
    x, y = mercator(lat, normalize_lon(lon), zoom)
    return F.pmod(x, F.lit(256.0)), F.pmod(y, F.lit(256.0))


def slippy_bbox(tx: Column, ty: Column, zoom: int) -> dict[str, Column]:
    """The box of a tile, held to the limits of the projection."""
    n = float(1 << zoom)
    lat = lambda y: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))
    return {
        "min_lon": tx / n * 360 - 180,
        "min_lat": F.greatest(F.lit(-SLIPPY_LIMIT), lat(ty + 1)),
        "max_lon": (tx + 1) / n * 360 - 180,
        "max_lat": F.least(F.lit(SLIPPY_LIMIT), lat(ty)),
    }


def pyramid_bbox(min_lon: Column, max_lat: Column, side: Column, tx: Column, ty: Column) -> dict[str, Column]:
    """The box of a tile of ``side`` degrees in a grid from the north-western corner."""
    west, north = min_lon + tx * side, max_lat - ty * side
    return {"min_lon": west, "min_lat": north - side, "max_lon": west + side, "max_lat": north}


def is_regional(box: str = "") -> Column:
    """a box that does not span the globe."""
    return (F.col(f"{box}max_lon") - F.col(f"{box}min_lon") < 180) | (F.col(f"{box}max_lat") - F.col(f"{box}min_lat") < 120)


# Fixed value: names of the eight winds, from north on.
WINDS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def cardinal(degrees: Column) -> Column:
    """G23: 'NE 45°' for a multiple of 45 degrees."""
    name = F.element_at(F.array(*[F.lit(x) for x in WINDS]), (F.pmod(degrees, F.lit(360)) / 45).cast("int") + 1)
    return F.concat(name, F.lit(" "), degrees.cast("int").cast("string"), F.lit("°"))


def format_azimuth(a: Column) -> Column:
    """Whole degrees in [0, 360], halves up."""
    return F.concat(F.floor(F.pmod(F.degrees(a), F.lit(360.0)) + 0.5).cast("int").cast("string"), F.lit("°"))


def decimal_year(ts: Column) -> Column:
    """The year and the part of it that has passed, in UTC."""
    start, end = F.date_trunc("year", ts), F.date_trunc("year", ts) + F.expr("INTERVAL 1 YEAR")
    micros = F.unix_micros
    return F.year(ts) + (micros(ts) - micros(start)) / (micros(end) - micros(start))


def in_sector(a: Column, centre: Column, fov: Column) -> Column:
    """an azimuth at most half the field of view from the centre."""
    return F.abs(wrap_angle(a - centre)) <= fov / 2


#: G32, fixed values: metres that an observer goes forward and is lifted at a time.
FORWARD_M, LIFT_M = 500.0, 100.0


def forward(lat: Column, lon: Column, centre: Column, fov: Column, x: Column, width: Column) -> tuple[Column, Column]:
    """The point ``FORWARD_M`` metres on in the direction of a column ``x`` of the picture; null: of its middle."""
    off = F.when(x.isNotNull() & (width > 0), (x - width / 2) / width * fov).otherwise(0.0)
    return destination(lat, lon, centre + off, F.lit(FORWARD_M))


def lifted(override: Column, ground: Column, steps: Column) -> Column:
    """The observer's height after some steps up (or down, below 0), from the one set before or else the ground's."""
    return F.coalesce(override, ground) + steps * LIFT_M
