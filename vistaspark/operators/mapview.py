"""What a map or a panorama shows (survey A18, A23, F9, F10, F12, F15, L4, T4, W16)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.functions import geo

# Pixels beyond the frame, letters' room at a label's side, the steepest line, limits of a calibration.
MARGIN_PX, LABEL_PX, STEEPEST, WIDEST_GAP = 80.0, 400.0, 15.0, 0.25
TILT_DEG, FOV_DEG = 15.0, (20.0, 100.0)


def in_viewport(lat: float, lon: float, zoom: int, width: int, height: int) -> Column:
    """a place (lat, lon) within the frame of a map and its margin, also across the antimeridian."""
    world = 256.0 * (1 << zoom)
    s = math.sin(math.radians(max(-geo.MERCATOR_LIMIT, min(geo.MERCATOR_LIMIT, lat))))
    x, y = (lon + 180) / 360 * world, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * world
    left, right = (v / world * 360 - 180 for v in (x - width / 2 - MARGIN_PX, x + width / 2 + MARGIN_PX))
    north, south = (math.degrees(math.atan(math.sinh(math.pi - 2 * math.pi * v / world))) for v in (max(0.0, y - height / 2 - MARGIN_PX), min(world, y + height / 2 + MARGIN_PX)))
    at = F.col("lon")
    if left < -180:
        at = F.when(at > 0, at - 360).otherwise(at)
    elif right > 180:
        at = F.when(at < 0, at + 360).otherwise(at)
    return F.col("lat").between(south, north) & at.between(left, right)


def on_screen(places: DataFrame, lat: float, lon: float, zoom: int, width: int, height: int) -> DataFrame:
    """places (lat, lon) with their pixels x and y in the frame, the shorter way round; without those off the screen."""
    world = 256.0 * (1 << zoom)
    cx, cy = geo.mercator(F.lit(lat), F.lit(lon), zoom)
    px, py = geo.mercator(F.col("lat"), F.col("lon"), zoom)
    off = px - cx
    x = F.when(off > world / 2, px - world).when(off < -world / 2, px + world).otherwise(px) - (cx - width / 2)
    rows = places.withColumn("x", x).withColumn("y", py - (cy - height / 2))
    return rows.filter(F.col("x").between(-MARGIN_PX, width + MARGIN_PX) & F.col("y").between(-MARGIN_PX, height + MARGIN_PX))


def azimuth_near_view(az: Column, centre: float, fov: float, width: float, margin: float, scale: float = 1.0) -> Column:
    """an azimuth whose label can reach into the frame."""
    x = width / 2 + geo.wrap_angle(az - centre) / fov * width
    pad = margin + LABEL_PX * scale
    return x.between(-pad, width + pad)


def calibration(raw: DataFrame) -> DataFrame:
    """stored corrections (azimuth, tilt, fov: text, auto: text) brought into range; what is no number as none."""
    number = lambda c: F.when(F.abs(F.col(c).try_cast("double")) < float("inf"), F.col(c).try_cast("double"))
    held = lambda v, low, high: F.least(F.lit(high), F.greatest(F.lit(low), v))
    az = F.pmod(number("azimuth") + 180, F.lit(360.0)) - 180
    return raw.select(
        "*",
        F.coalesce(az, F.lit(0.0)).alias("azimuth_deg"),
        F.coalesce(F.when(number("tilt").isNotNull(), held(number("tilt"), -TILT_DEG, TILT_DEG)), F.lit(0.0)).alias("tilt_deg"),
        F.when(number("fov").isNotNull(), held(number("fov"), *FOV_DEG)).alias("fov_deg"),
        F.coalesce(F.col("auto") != "false", F.lit(True)).alias("auto_calibrate"),
    )


def ridge_lines(profiles: DataFrame, fov: float, rays: int, margin: float = 20.0) -> DataFrame:
    """Points (frame, line, ray, x, angle) of ridges (frame, centre, width, ray, angle) on the screen, in pieces of two points at least.

    A piece ends at a hole, off the screen, at a wide gap, and where the angle jumps. Rays are
    taken from the left side of the view, so a view across north is one run of them.
    """
    step, width = 2 * math.pi / rays, F.col("width")
    off = geo.wrap_angle(F.col("ray") * step - F.col("centre"))
    rows = profiles.withColumn("x", width / 2 + off / fov * width).filter(F.col("x").between(-margin, width + margin) & F.col("angle").isNotNull())
    along = Window.partitionBy("frame").orderBy("x")
    last = lambda c: F.lag(c).over(along)
    gap = F.pmod(F.col("ray") - last("ray"), F.lit(rays)) > 1
    breaks = gap | (F.abs(F.col("x") - last("x")) > width * WIDEST_GAP) | (F.abs(F.col("angle") - last("angle")) > STEEPEST * step)
    rows = rows.withColumn("line", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(along))
    size = F.count(F.lit(1)).over(Window.partitionBy("frame", "line"))
    return rows.withColumn("n", size).filter("n > 1").select("frame", "line", "ray", "x", "angle")


def phases(timings: DataFrame) -> DataFrame:
    """Of each phase the number, sum and highest of its times (phase, ms)."""
    return timings.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total"), F.max("ms").alias("longest"))


def report(cells: DataFrame) -> DataFrame:
    """Cells and their bytes by level and priority, by level, and in all."""
    return cells.rollup("lod", "priority").agg(F.count(F.lit(1)).alias("cells"), F.sum("bytes").alias("bytes"))
