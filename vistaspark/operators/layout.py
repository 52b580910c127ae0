"""Labels and lines of one frame (survey L1, L4, M25, M27): small sequential steps, a frame at a time.

A frame holds some hundreds of labels or columns, so a frame is one group; frames are many.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Height and gaps of a label, how far it is lifted beside its point, the width of a letter; the costs of a skyline.
HEIGHT, GAP, SIDE_GAP, LIFT, LETTER, PAD, MOST = 16.0, 2.0, 10.0, 14.0, 6.5, 8.0, 148.0
NONE_COST, ENTER_COST, STEP_COST, MOST_STEP = 0.04, 0.25, 0.02, 6


def place_labels(labels: DataFrame) -> DataFrame:
    """L1: labels (frame, key, text, x, y, rank, shown: the anchor it had, null if none) without overlaps: key, anchor, shift.

    Those that were shown come first, on their anchor if it is free; then by rank; over the
    point, right of it or left of it. Labels without room are left out.
    """

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = np.empty((0, 4)), []
        rows = frame.assign(new=frame["shown"].isna()).sort_values(["new", "rank"])
        for r in rows.itertuples():
            wide = min(MOST, LETTER * len(r.text) + PAD)
            shifts = (0.0, wide / 2 + SIDE_GAP, -(wide / 2 + SIDE_GAP))
            first = [] if r.new else [int(r.shown)]
            for anchor in [*first, *(a for a in range(3) if a not in first)]:
                x, lift = r.x + shifts[anchor], LIFT if anchor else 0.0
                box = np.array([x - wide / 2 - GAP, r.y - HEIGHT - lift - GAP, x + wide / 2 + GAP, r.y + GAP])
                if not ((box[0] < taken[:, 2]) & (box[2] > taken[:, 0]) & (box[1] < taken[:, 3]) & (box[3] > taken[:, 1])).any():
                    taken = np.vstack([taken, box])
                    out.append((r.frame, r.key, anchor, shifts[anchor]))
                    break
        return pd.DataFrame(out, columns=["frame", "key", "anchor", "shift"])

    return labels.groupBy("frame").applyInPandas(place, "frame long, key string, anchor int, shift double")


def visible_parts(widths: list[float], fits) -> tuple[int, int] | None:
    """L4: first and last of the parts of a label that stay when those that don't fit are cut from its ends; None if none does."""
    return parts_between(np.concatenate([[0.0], np.cumsum(widths)]), fits)


def parts_between(edge: Sequence[float], fits) -> tuple[int, int] | None:
    """``visible_parts`` of parts that lie between the edges."""
    first, last = 0, len(edge) - 2
    while first <= last and not fits(edge[first], edge[last + 1]):
        short, late = fits(edge[first], edge[last]), fits(edge[first + 1], edge[last + 1])
        first, last = first + late, last - (short or not late)
    return (first, last) if first <= last else None


def likeliest_line(strength: np.ndarray) -> np.ndarray:
    """Of each column (strength: rows x columns) the row of the skyline, NaN where there is none: the cheapest path.

    A column costs a little less its strength; steps between rows cost by their size to the
    power of 1.5, at most ``MOST_STEP`` rows; entering after a gap costs, a gap is free.
    """
    return likeliest_lines(strength[None])[0]


def likeliest_lines(strengths: np.ndarray) -> np.ndarray:
    """``likeliest_line`` of several pictures of one size (strengths: pictures x rows x columns), column by column together.

    Only costs are kept on the way; which step was the cheapest is asked again along the path.
    """
    n, rows, columns = strengths.shape
    offsets, each = np.arange(-MOST_STEP, MOST_STEP + 1), np.arange(n)
    price = STEP_COST * np.abs(offsets) ** 1.5
    by_column = np.ascontiguousarray(strengths.transpose(2, 0, 1))
    padded, nones = np.full((columns, n, rows + 2 * MOST_STEP), np.inf), np.zeros((columns, n))
    gaps, within = np.zeros((columns, n), int), slice(MOST_STEP, MOST_STEP + rows)
    step, moved = np.empty((n, rows)), np.empty((n, rows))
    np.subtract(NONE_COST, by_column[0], out=padded[0, :, within])
    for x in range(columns):
        cost = padded[x, :, within]
        gaps[x] = cost.argmin(1)
        if x + 1 == columns:
            break
        np.add(padded[x, :, :rows], price[0], out=step)
        for k in range(1, len(offsets)):
            np.add(padded[x, :, k : k + rows], price[k], out=moved)
            np.minimum(step, moved, out=step)
        np.minimum(step, (nones[x] + ENTER_COST)[:, None], out=step)
        step += NONE_COST
        np.subtract(step, by_column[x + 1], out=padded[x + 1, :, within])
        lowest = cost[each, gaps[x]]
        nones[x + 1] = np.where(lowest < nones[x], lowest, nones[x])
    out, at = np.full((n, columns), np.nan), None
    for x in range(columns - 1, -1, -1):
        gap = np.where(padded[x, each, gaps[x] + MOST_STEP] < nones[x], gaps[x], -1)
        if at is None:
            at = gap
        else:
            there = padded[x][each[:, None], np.maximum(at, 0)[:, None] + offsets + MOST_STEP] + price
            best = there.argmin(1)
            stepped = np.where(there[each, best] < nones[x] + ENTER_COST, at + offsets[best], -1)
            at = np.where(at >= 0, stepped, gap)
        out[:, x] = np.where(at >= 0, at, np.nan)
    return out


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points of a line that stay when none left out lies farther than the tolerance from the chord over it."""
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        way, off = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*way)
        away = np.abs(way[0] * off[:, 1] - way[1] * off[:, 0]) / size if size else np.hypot(*off.T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep.add(a + 1 + k)
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(keep))


def simplify_lines(lines: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """The points (line, seq, x, y) that each line needs."""

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        return frame.iloc[simplified(frame[["x", "y"]].to_numpy(), tolerance)]

    return lines.select("line", "seq", "x", "y").groupBy("line").applyInPandas(cut, "line long, seq long, x double, y double")
