"""Camera frames and device poses as Column expressions (survey G22, G27-G29, G33)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistaspark.functions.geo import normalize_azimuth


def fov_for_frame(base: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Horizontal and vertical field of view; the longer side has the base angle."""
    other = lambda short, long: 2 * F.atan(F.tan(base / 2) * short / long)
    blank = (width <= 0) | (height <= 0)
    return (
        F.when(blank | (width >= height), base).otherwise(other(width, height)),
        F.when(blank | (width < height), base).otherwise(other(height, width)),
    )


def apply_zoom(angle: Column, zoom: Column) -> Column:
    """The field of view at a zoom; one that is no positive number counts as 1."""
    z = F.when(zoom.isNotNull() & ~F.isnan(zoom) & (zoom > 0) & (zoom < float("inf")), zoom).otherwise(1.0)
    return 2 * F.atan(F.tan(angle / 2) / z)


def _cover(frame_w: Column, frame_h: Column, view_w: Column, view_h: Column) -> tuple[Column, Column]:
    """Whether all sizes are positive, and the scale at which the frame covers the view."""
    return F.least(frame_w, frame_h, view_w, view_h) > 0, F.greatest(view_w / frame_w, view_h / frame_h)


def apply_cover_crop(h: Column, v: Column, frame_w: Column, frame_h: Column, view_w: Column, view_h: Column) -> tuple[Column, Column]:
    """What of the field of view stays when the frame is cropped to cover the view."""
    there, scale = _cover(frame_w, frame_h, view_w, view_h)
    cut = lambda a, view, frame: F.when(there, 2 * F.atan(F.tan(a / 2) * F.least(F.lit(1.0), view / (frame * scale)))).otherwise(a)
    return cut(h, view_w, frame_w), cut(v, view_h, frame_h)


def horizon_row_in_frame(share: Column, frame_w: Column, frame_h: Column, view_w: Column, view_h: Column) -> Column:
    """The horizon's row as a share of the whole frame, from its share of the view."""
    there, scale = _cover(frame_w, frame_h, view_w, view_h)
    drawn = frame_h * scale
    return F.when(there, (share * view_h - (view_h - drawn) / 2) / drawn).otherwise(share)


def look(alpha: Column, beta: Column, gamma: Column) -> dict[str, Column]:
    """Where a device looks (the axis from its screen away from the face), from its Euler angles in degrees."""
    a, b, g = F.radians(alpha), F.radians(beta), F.radians(gamma)
    east = -(F.cos(a) * F.sin(g) + F.sin(a) * F.sin(b) * F.cos(g))
    north = -(F.sin(a) * F.sin(g) - F.cos(a) * F.sin(b) * F.cos(g))
    up = -F.cos(b) * F.cos(g)
    return {
        "azimuth": normalize_azimuth(F.atan2(east, north)),
        "elevation": F.atan2(up, F.hypot(east, north)),
        "roll": F.atan2(-F.cos(b) * F.sin(g), F.sin(b)),
    }


def vertical_rate(beta: Column, gamma: Column, rate_alpha: Column, rate_beta: Column, rate_gamma: Column) -> Column:
    """Radians a second that the look turns to the right, from a gyroscope's degrees a second."""
    b, g = F.radians(beta), F.radians(gamma)
    return F.cos(b) * F.sin(g) * F.radians(rate_beta) - F.sin(b) * F.radians(rate_gamma) - F.cos(b) * F.cos(g) * F.radians(rate_alpha)


def overlay_roll(roll: Column, soft_degrees: Column, window_degrees: Column, device_referenced: Column) -> Column:
    """The roll seen in the picture: less the turn of the interface, and less the window's where events are in the device's axes."""
    window = F.when(device_referenced & (window_degrees == 90), 90.0).when(device_referenced & (window_degrees == 270), -90.0).otherwise(0.0)
    return roll - (soft_degrees + window) * (math.pi / 180)


def frame_rotation(css_degrees: Column) -> Column:
    """Clockwise turn of the frame, in [0, 360)."""
    return F.pmod(-css_degrees, F.lit(360))


def rotated_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """The frame's sides change places at a quarter turn."""
    turned = rotation.isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
