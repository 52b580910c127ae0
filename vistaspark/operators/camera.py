"""Skylines out of camera pixels, and where the camera looked (survey A21, M22-M25, T6).

A picture goes to a coarse grid of features, those to the strength of a border between sky and
land in every cell, and the cheapest line through the strengths is the skyline. Its angles are
then compared with the ring of the horizon over a grid of turns and tilts, whose best cell is
the middle of the next, finer grid. A picture is a row and needs no other, so all of it runs
where the rows lie, without an exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaspark.operators import skyline
from vistaspark.operators.layout import likeliest_lines

# The grid; the weight, floor and cap of a jump in texture and the rows it looks at; the most texture and
# spread of brightness of a sky, and from which row on they count; reach, share and least size of a step back; the least
# step and share above which a border higher up counts; the brightness step that is looked at for pulses.
GRID = (160, 120)
JUMP_WEIGHT, JUMP_LEAST, JUMP_MOST, JUMP_ROWS = 5.0, 0.004, 0.06, 4
SKY_TEXTURE, SKY_SPREAD, SKY_ROWS = 0.015, 0.12, 8
PULSE_REACH, PULSE_SHARE, PULSE_LEAST, PULSE_FROM = 20, 0.7, 0.05, 0.02
ABOVE_LEAST, ABOVE_SHARE = 0.1, 0.5
FIRST_ROW, LAST_ROW = 3, GRID[1] - JUMP_ROWS - 2
#: Pictures, or rings, that a task holds as Python values at a time.
TOGETHER = 16

# Fixed values, in degrees: reach and step of the first grid about the compass, reach about another start, what a step
# is divided by from grid to grid, the grids; the step of the shifts that tell the usual difference; the least share of
# columns that are known and that lie over the ring; how near a start the answer is its own.
AZIMUTHS, TILTS, NEAR_AZIMUTHS, NEAR_TILTS, FINER, GRIDS = (25.0, 2.0), (12.0, 1.0), (3.0, 2.0), (1.5, 1.0), 5, 3
USUAL_STEP, LEAST_KNOWN, LEAST_OVER, LEAST_COLUMNS, OWN_START = 3.0, 0.35, 0.5, 8, 1.0


def cell_features(rgba: bytes, width: int, height: int, grid: tuple[int, int] = GRID) -> np.ndarray:
    """Brightness, blue less red and saturation, each a grid of the means of its cells; of a picture smaller than the grid each pixel counts for several."""
    wide, high = grid
    if (width, height) == grid:  # a cell a pixel
        r, g, b = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[..., :3].transpose(2, 0, 1).astype(np.float64, order="C")
        return np.stack([(0.299 * r + 0.587 * g + 0.114 * b) / 255, (b - r) / 255, (np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)) / 255])
    pixels = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[..., :3].astype(np.float64)
    pixels = pixels.repeat(-(-high // height), axis=0).repeat(-(-wide // width), axis=1)
    height, width = pixels.shape[:2]
    gx = np.minimum(wide - 1, np.arange(width) * wide // width)
    gy = np.minimum(high - 1, np.arange(height) * high // height)
    cell = (gy[:, None] * wide + gx).ravel()
    r, g, b = (pixels[..., k].ravel() for k in range(3))
    features = (0.299 * r + 0.587 * g + 0.114 * b) / 255, (b - r) / 255, (pixels.max(axis=2) - pixels.min(axis=2)).ravel() / 255
    counts = np.bincount(cell, minlength=wide * high)
    return np.stack([(np.bincount(cell, f, minlength=wide * high) / counts).reshape(high, wide) for f in features])


def _inner(grid: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``grid`` with its inner cells replaced."""
    out = grid.copy()
    out[1:-1, 1:-1] = of
    return out


def _before(grid: np.ndarray) -> np.ndarray:
    """Of each row the sum of the rows over it; one row more than the grid."""
    return np.vstack([np.zeros((1, grid.shape[1])), np.cumsum(grid, axis=0)])


def _about(grid: np.ndarray, better: np.ufunc, none: float) -> np.ndarray:
    """Of each row the ``better`` of those from 2 to ``PULSE_REACH`` rows over and under it, ``none`` beyond the grid."""
    rows, wanted, width = len(grid), PULSE_REACH - 1, 1
    run = np.pad(grid, ((PULSE_REACH, PULSE_REACH), (0, 0)), constant_values=none)
    while width < wanted:
        more = min(width, wanted - width)
        run, width = better(run[:-more], run[more:]), width + more
    return better(run[:rows], run[PULSE_REACH + 2 : PULSE_REACH + 2 + rows])


def _steps(grid: np.ndarray) -> np.ndarray:
    """Half the difference of the rows under and over each; 0 at the first and the last."""
    out = np.zeros_like(grid)
    out[1:-1] = (grid[2:] - grid[:-2]) / 2
    return out


def border_strength(light: np.ndarray, blue: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """How strong a border of the sky each cell is; 0 where it can't be one.

    A border is a step of brightness, colour and saturation, and of texture under it. It is
    none if the brightness steps back nearby, if a strong border lies over it, or if what is
    over it is rough or uneven.
    """
    high, wide = light.shape
    smooth = _inner(light, sum(light[1 + a : high - 1 + a, 1 + b : wide - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9)
    around = smooth[:-2, 1:-1] + smooth[2:, 1:-1] + smooth[1:-1, :-2] + smooth[1:-1, 2:]
    texture = _inner(np.zeros_like(light), np.abs(4 * smooth[1:-1, 1:-1] - around) / 4)
    step = _steps(light)
    edge = np.abs(step) + np.abs(_steps(blue)) + np.abs(_steps(colour)) / 2
    size = np.abs(step)
    back = np.where(step > 0, -_about(step, np.minimum, np.inf), _about(step, np.maximum, -np.inf))
    pulse = (size > PULSE_FROM) & (back > np.maximum(PULSE_SHARE * size, PULSE_LEAST))
    highest = np.vstack([np.zeros((2, wide)), np.maximum.accumulate(edge, axis=0)[:-2]])
    under = highest > np.maximum(ABOVE_LEAST, ABOVE_SHARE * edge)
    rows = np.arange(high, dtype=float)[:, None]
    over = np.maximum(rows, 1)
    rough, mean = _before(texture), _before(light)[:-1] / over
    spread = _before(light**2)[:-1] / over - mean**2
    uneven = (rows >= SKY_ROWS) & ((rough[:-1] / over > SKY_TEXTURE) | (spread > SKY_SPREAD**2))
    y = np.arange(FIRST_ROW, LAST_ROW + 1)
    first = np.maximum(0, y - JUMP_ROWS)
    jump = (rough[y + 1 + JUMP_ROWS] - rough[y + 1]) / JUMP_ROWS - (rough[y] - rough[first]) / (y - first)[:, None]
    out = np.zeros_like(light)
    out[y] = edge[y] + JUMP_WEIGHT * np.clip(jump - JUMP_LEAST, 0, JUMP_MOST)
    out[pulse | under | uneven] = 0
    return out


def skyline_rows(rgba: bytes, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of the grid the skyline's share of the height from the top, NaN where there is none, and its strength."""
    return skylines_of([(rgba, width, height)])[0]


def skylines_of(pictures: list[tuple[bytes, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``skyline_rows`` of some pictures, whose lines are found together."""
    if not pictures:
        return []
    strengths = np.stack([border_strength(*cell_features(*p)) for p in pictures])
    rows = likeliest_lines(strengths[:, FIRST_ROW : LAST_ROW + 1]) + FIRST_ROW
    known = np.isfinite(rows)
    found = np.take_along_axis(strengths, np.where(known, rows, 0).astype(int)[:, None], axis=1)[:, 0]
    return list(zip(rows / GRID[1], np.where(known, found, np.nan), strict=True))


def slices(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time: a batch has as many as Spark likes, whatever a row weighs."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def skylines(frames: DataFrame, keep: dict[str, str] | None = None, source: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Frame, ys, strengths (arrays of a value a column, null where no border is) of pictures (frame, width, height, rgba).

    Pictures without pixels, or with others than ``4 * width * height`` bytes, have no row.
    ``keep``: further columns to pass on, with their types. ``source`` makes or reads the
    pictures, as Arrow batches out of those of ``frames``: their pixels then never leave the task.
    """
    kind, keep = frames.schema["frame"].dataType.simpleString(), keep or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source(batches) if source else batches):
            rows = [(r["rgba"], r["width"], r["height"]) for r in batch.select(["width", "height", "rgba"]).to_pylist()]
            there = [i for i, (rgba, width, height) in enumerate(rows) if rgba and width and height and len(rgba) == 4 * width * height]
            found = skylines_of([rows[i] for i in there])
            ys, strengths = ([pa.array(f[k], from_pandas=True) for f in found] for k in range(2))
            passed, numbers = batch.select(["frame", *keep]).take(pa.array(there, pa.int64())), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*passed.columns, pa.array(ys, numbers), pa.array(strengths, numbers)], ["frame", *keep, "ys", "strengths"])

    rows = frames if source else frames.select("frame", "width", "height", "rgba", *keep)
    return rows.mapInArrow(run, ", ".join([f"frame {kind}", *[f"{k} {v}" for k, v in keep.items()], "ys array<double>", "strengths array<double>"]))


def skyline_points(frames: DataFrame, source: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """frame, col, y, strength of the columns that have a skyline."""
    points = F.posexplode(F.arrays_zip("ys", "strengths"))
    return skylines(frames, source=source).select("frame", points.alias("col", "p")).filter("p.ys IS NOT NULL").select("frame", "col", F.col("p.ys").alias("y"), F.col("p.strengths").alias("strength"))


def level_angles(ys: Column, tilt: Column, horizon: Column, fov_v: Column) -> Column:
    """The elevation of each share of the height, for a camera whose horizon lies at the share ``horizon``."""
    return F.transform(ys, lambda y: tilt + (horizon - y) * fov_v)


def ring_angle(ring: np.ndarray, azimuths: np.ndarray) -> np.ndarray:
    """The ring between its rays, NaN beside a ray that has nothing."""
    at = azimuths / (2 * math.pi / len(ring))
    low = np.floor(at)
    i = low.astype(np.int64) % len(ring)
    a, b = ring[i], np.append(ring[1:], ring[:1])[i]
    if np.isfinite(ring).all():
        return a + (b - a) * (at - low)
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(a) & np.isfinite(b), a + (b - a) * (at - low), np.nan)


def median_differences(columns: np.ndarray, angles: np.ndarray, centre: float, ring: np.ndarray, azimuths: np.ndarray, tilts: np.ndarray) -> np.ndarray:
    """For each turn and tilt the upper median of the differences to the ring; infinite where too few columns lie over it."""
    there = ring_angle(ring, (centre + azimuths)[:, None] + columns)
    errors = np.subtract((angles + tilts[:, None])[None], there[:, None])
    np.abs(errors, out=errors)
    errors.sort(axis=2)
    if np.isfinite(errors[..., -1]).all():  # what is not comes last
        n = errors.shape[2]
        return errors[..., n // 2] if n >= LEAST_COLUMNS else np.full(errors.shape[:2], np.inf)
    n = np.isfinite(errors).sum(axis=2)
    middle = np.take_along_axis(errors, np.minimum(n // 2, errors.shape[2] - 1)[..., None], axis=2)[..., 0]
    return np.where(n >= max(LEAST_COLUMNS, math.floor(len(columns) * LEAST_OVER + 0.5)), middle, np.inf)


def _around(middle: float, reach: float, step: float) -> np.ndarray:
    n = math.floor(2 * reach / step + 1e-6) + 1
    return middle + np.radians(np.arange(n) * step - reach)


def refined(columns: np.ndarray, angles: np.ndarray, centre: float, ring: np.ndarray, start: float, first: bool) -> tuple[float, float, float]:
    """Turn, tilt and difference of the best cell of the last of ``GRIDS`` grids; the middle stays where no cell is better, then the first of equal ones."""
    (reach_a, step_a), (reach_t, step_t) = (AZIMUTHS, TILTS) if first else (NEAR_AZIMUTHS, NEAR_TILTS)
    best = (start, 0.0, math.inf)
    for _ in range(GRIDS):
        azimuths, tilts = _around(best[0], reach_a, step_a), _around(best[1], reach_t, step_t)
        found = median_differences(columns, angles, centre, ring, azimuths, tilts)
        a, t = np.unravel_index(found.argmin(), found.shape)
        if found[a, t] < best[2]:
            best = (float(azimuths[a]), float(tilts[t]), float(found[a, t]))
        reach_a, step_a, reach_t, step_t = step_a, step_a / FINER, step_t, step_t / FINER
    return best


def match(angles: np.ndarray, centre: float, fov: float, ring: np.ndarray, starts: list[float]) -> tuple[float, float, float | None, float | None, int]:
    """Turn, tilt, difference, usual difference and known columns of a skyline (angles, NaN unknown)."""
    known = np.isfinite(angles)
    columns = (((np.arange(len(angles)) + 0.5) / max(1, len(angles)) - 0.5) * fov)[known]
    n = len(columns)
    if n < len(angles) * LEAST_KNOWN or not n or not len(ring):
        return 0.0, 0.0, None, None, n
    tried = [refined(columns, angles[known], centre, ring, s, k == 0) for k, s in enumerate([0.0, *starts])]
    turn, tilt, error = min(tried, key=lambda b: b[2])
    if not math.isfinite(error):
        return 0.0, 0.0, None, None, n
    usual = median_differences(columns, angles[known], centre, ring, _around(0.0, AZIMUTHS[0], USUAL_STEP), np.array([tilt]))[:, 0]
    usual = np.sort(usual[np.isfinite(usual)])
    return turn, tilt, error, float(usual[len(usual) // 2]) if len(usual) else 0.0, n


def numbers(lists: pa.Array) -> list[np.ndarray]:
    """Of each row its numbers, NaN for null ones; none where the list is null."""
    ends = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return [values[a:b] for a, b in pairwise(ends)]


def matches(frames: DataFrame) -> DataFrame:
    """Frame, azimuth, tilt (corrections), residual, baseline, columns of skylines (frame, angles, centre, fov, ring, starts).

    Three grids, each about the best cell of the one before, from the compass (0) and from
    each of ``starts``, which may be null; every start is refined on its own and the least
    difference stays. Skylines with too few columns, or none over the ring, have no residual.
    """
    kind = frames.schema["frame"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [
                (r["frame"], *match(angles, r["centre"], r["fov"], ring, [s for s in r["starts"] or [] if s is not None]))
                for r, angles, ring in zip(batch.select(["frame", "centre", "fov", "starts"]).to_pylist(), numbers(batch["angles"]), numbers(batch["ring"]), strict=True)
            ]
            kinds = [batch.schema.field("frame").type, *[pa.float64()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], ["frame", "azimuth", "tilt", "residual", "baseline", "columns"])

    return frames.select("frame", "angles", "centre", "fov", "ring", "starts").mapInArrow(run, f"frame {kind}, azimuth double, tilt double, residual double, baseline double, columns int")


def located(frames: DataFrame, fov: float) -> DataFrame:
    """As ``matches`` of (frame, angles, centre, ring), from the places on the ring where the skyline correlates best.

    ``guess`` and ``uniqueness`` are those of the first place. A frame needs its own ring
    alone, so it goes through both searches where it lies and the ring is moved once.
    """
    kind = frames.schema["frame"].dataType.simpleString()
    turned = lambda to, centre: (to - centre + math.pi) % (2 * math.pi) - math.pi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for r, angles, ring in zip(batch.select(["frame", "centre"]).to_pylist(), numbers(batch["angles"]), numbers(batch["ring"]), strict=True):
                columns = round(fov / (2 * math.pi / len(ring))) if len(ring) else 0
                on_ring = angles[np.floor((np.arange(columns) + 0.5) * len(angles) / columns).astype(int)] if len(angles) and columns else angles
                guesses = skyline.frame_hypotheses(ring, on_ring, math.nan if r["centre"] is None else r["centre"], fov) if len(on_ring) and len(ring) else []
                found = match(angles, r["centre"], fov, ring, [turned(g[1], r["centre"]) for g in guesses])
                rows.append((r["frame"], *found, *((guesses[0][1], guesses[0][3]) if guesses else (None, None))))
            kinds = [batch.schema.field("frame").type, *[pa.float64()] * 4, pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], ["frame", "azimuth", "tilt", "residual", "baseline", "columns", "guess", "uniqueness"])

    return frames.select("frame", "angles", "centre", "ring").mapInArrow(run, f"frame {kind}, azimuth double, tilt double, residual double, baseline double, columns int, guess double, uniqueness double")


def confidence(error: Column, baseline: Column, own: Column, uniqueness: Column, anchors: Column) -> Column:
    """How much less than usual a match differs.

    Where it is the best hypothesis's own answer (``own``), its uniqueness counts, and whether
    peaks stand where they should: ``anchors`` is the share of them, negative if it isn't known.
    """
    base = F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(error, baseline)), F.lit(0.0))
    unique = base * F.least(F.lit(1.0), uniqueness / 1.5)
    told = F.when(anchors >= 0.6, F.least(F.lit(1.0), unique + 0.2)).when(anchors == 0, unique * 0.5).otherwise(unique)
    return F.when(F.coalesce(own, F.lit(False)), told).otherwise(base)
