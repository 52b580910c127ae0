"""Screen geometry as Column expressions (survey G30, G31, L3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in units of the interface's scale: offset and width of a ridge line, padding,
# least margin, half the height of a label, width of a letter.
RIDGE_CSS, PAD, LEAST_MARGIN, HALF_LABEL = 2 * (1.1 + 1.4), 8.0, 20.0, 9.0
LETTER, LABEL_PAD, LABEL_MOST = 6.5, 8.0, 148.0


def roll_edge_margin(width: Column, height: Column, roll: Column, scale: Column, ridge_css: float = RIDGE_CSS) -> Column:
    """How far beyond the sides lines are drawn when the picture is turned by a roll."""
    return F.greatest(F.lit(LEAST_MARGIN), (width * (1 - F.cos(roll)) + height * F.abs(F.sin(roll))) / 2 + ridge_css * scale + PAD)


def _corners_inside(x: Column, y: Column, length: Column, ux: Column, uy: Column, roll: Column, width: Column, height: Column, scale: Column) -> Column:
    """For each corner of a label's box, whether it is on the screen after the turn about the centre."""
    half = HALF_LABEL * scale
    cx, cy = width / 2, height / 2

    def corner(u, v):
        px, py = x + u * ux - v * uy - cx, y + u * uy + v * ux - cy
        sx, sy = cx + px * F.cos(roll) - py * F.sin(roll), cy + px * F.sin(roll) + py * F.cos(roll)
        return sx.between(F.lit(0), width) & sy.between(F.lit(0), height)

    return F.array(*[corner(u, v) for u in (F.lit(0.0), length) for v in (-half, half)])


def label_fully_on_screen(*label: Column) -> Column:
    """All corners of a label (x, y, length, ux, uy, roll, width, height, scale) are on the screen."""
    return F.forall(_corners_inside(*label), lambda c: c)


def label_partly_on_screen(*label: Column) -> Column:
    """Some corner is."""
    return F.exists(_corners_inside(*label), lambda c: c)


def segment_meets_box(x1: Column, y1: Column, x2: Column, y2: Column, x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    """A segment touches a box: the parts of it within both slabs overlap."""

    def slab(a, b, low, high):
        """(from, to, possible): the share of the segment between two lines."""
        d = b - a
        t, s = F.try_divide(low - a, d), F.try_divide(high - a, d)
        flat = d == 0
        return F.when(flat, 0.0).otherwise(F.least(t, s)), F.when(flat, 1.0).otherwise(F.greatest(t, s)), ~flat | a.between(low, high)

    fx, tx, px = slab(x1, x2, x_min, x_max)
    fy, ty, py = slab(y1, y2, y_min, y_max)
    return px & py & (F.greatest(F.lit(0.0), fx, fy) <= F.least(F.lit(1.0), tx, ty))


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Two segments cross within both, without touching only."""
    side = lambda p, q, r: (r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])
    apart = lambda s, t: F.signum(s) * F.signum(t) < 0
    return apart(side(a, b, c), side(a, b, d)) & apart(side(c, d, a), side(c, d, b))


def label_width(text: Column) -> Column:
    """L3: width of a label by its letters."""
    return F.least(F.lit(LABEL_MOST), LETTER * F.length(text) + LABEL_PAD)
