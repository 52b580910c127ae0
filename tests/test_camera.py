"""Skylines out of pixels, and the search for where the camera looked, against plain loops and known views."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaspark.operators import camera, skyline
from vistaspark.plans import camera as queries

SF = "/root/testdata/sf0.001"


def plain_features(rgba, width, height, wide, high):
    sums = [[[0.0, 0.0, 0.0, 0] for _ in range(wide)] for _ in range(high)]
    for y in range(height):
        for x in range(width):
            r, g, b = rgba[4 * (y * width + x) : 4 * (y * width + x) + 3]
            cell = sums[min(high - 1, int(y / height * high))][min(wide - 1, int(x / width * wide))]
            for k, v in enumerate(((0.299 * r + 0.587 * g + 0.114 * b) / 255, (b - r) / 255, (max(r, g, b) - min(r, g, b)) / 255, 1)):
                cell[k] += v
    return np.array([[[c[k] / c[3] if c[3] else math.nan for c in row] for row in sums] for k in range(3)])


def plain_strength(light, blue, colour):
    """Cell by cell, as the rules say it."""
    high, wide = light.shape
    inner = lambda y, x: 0 < y < high - 1 and 0 < x < wide - 1
    smooth = [[np.mean([light[y + a, x + b] for a in (-1, 0, 1) for b in (-1, 0, 1)]) if inner(y, x) else light[y, x] for x in range(wide)] for y in range(high)]
    texture = [[abs(4 * smooth[y][x] - smooth[y - 1][x] - smooth[y + 1][x] - smooth[y][x - 1] - smooth[y][x + 1]) / 4 if inner(y, x) else 0.0 for x in range(wide)] for y in range(high)]
    out = np.zeros((high, wide))
    for x in range(wide):
        slope = lambda grid, y: (grid[y + 1, x] - grid[y - 1, x]) / 2 if 0 < y < high - 1 else 0.0  # noqa: E731, B023
        edge = [abs(slope(light, y)) + abs(slope(blue, y)) + abs(slope(colour, y)) / 2 for y in range(high)]
        column = [texture[y][x] for y in range(high)]
        for y in range(3, high - 5):
            step = slope(light, y)
            if abs(step) > 0.02 and any(-math.copysign(1, step) * slope(light, z) > max(0.7 * abs(step), 0.05) for z in range(max(1, y - 20), min(high - 2, y + 20) + 1) if abs(z - y) >= 2):
                continue
            if max(edge[: y - 1]) > max(0.1, 0.5 * edge[y]):
                continue
            if y >= 8 and (np.mean(column[:y]) > 0.015 or np.mean(light[:y, x] ** 2) - np.mean(light[:y, x]) ** 2 > 0.12**2):
                continue
            jump = max(0, np.mean(column[y + 1 : y + 5]) - np.mean(column[max(0, y - 4) : y]) - 0.004)
            out[y, x] = edge[y] + 5 * min(jump, 0.06)
    return out


def view(frame=7, seed=1):
    ring = queries.made_ring(np.random.default_rng(seed).normal(size=64))
    return ring, queries.made_picture(frame, ring)


def test_features_are_the_means_of_cells():
    rng = np.random.default_rng(0)
    for width, height in ((50, 37), (16, 12)):
        rgba = rng.integers(0, 256, width * height * 4, np.uint8).tobytes()
        assert camera.cell_features(rgba, width, height, (16, 12)) == pytest.approx(plain_features(rgba, width, height, 16, 12))
    small = rng.integers(0, 256, (6, 8, 4), np.uint8)
    twice = small.repeat(2, axis=0).repeat(2, axis=1)
    assert (camera.cell_features(small.tobytes(), 8, 6, (16, 12)) == camera.cell_features(twice.tobytes(), 16, 12, (16, 12))).all()


def test_strength_is_that_of_a_plain_loop():
    rng = np.random.default_rng(3)
    for frame in (3, 5):
        grids = camera.cell_features(view(frame)[1], *queries.SIZE)[:, :, :24]
        if frame == 5:
            grids[0, 40:44] += 0.3  # a lamp
            grids[0] += rng.normal(0, 0.01, grids[0].shape)
        got = camera.border_strength(*grids)
        assert got == pytest.approx(plain_strength(*grids), abs=1e-9) and (got > 0).any()


def test_the_line_is_the_ridge_that_was_drawn():
    for frame in range(12):
        ring, rgba = view(frame, frame)
        centre, turn, tilt = queries.truth(frame)
        at = centre + turn + ((np.arange(160) + 0.5) / 160 - 0.5) * queries.FOV
        ridge = queries.HORIZON - (camera.ring_angle(ring, at) - tilt) / queries.FOV_V
        ys, strengths = camera.skyline_rows(rgba, *queries.SIZE)
        known = np.isfinite(ys)
        assert known.mean() > 0.9 and (np.isfinite(strengths) == known).all()
        assert np.median(np.abs(ys - ridge)[known]) < 1.5 / 120


def test_pictures_without_a_skyline(spark):
    plain = bytes([120, 150, 200, 255]) * (40 * 30)
    rows = [(1, 40, 30, plain), (2, 40, 30, plain[:-4]), (3, 40, 30, None), (4, 40, 30, b""), (5, None, 30, plain), (1, 40, 30, plain)]
    frames = spark.createDataFrame(rows, "frame long, width int, height int, rgba binary")
    got = camera.skylines(frames).collect()
    assert [r["frame"] for r in got] == [1, 1] and all(set(r["ys"]) == {None} and len(r["ys"]) == 160 for r in got)
    assert camera.skyline_points(frames).count() == 0


def plain_residual(columns, angles, centre, ring, turn, tilt):
    errors = []
    for c, a in zip(columns, angles, strict=True):
        at = (centre + turn + c) / (2 * math.pi / len(ring))
        i, share = math.floor(at), at - math.floor(at)
        lo, hi = ring[i % len(ring)], ring[(i + 1) % len(ring)]
        if math.isfinite(lo) and math.isfinite(hi):
            errors.append(abs(a + tilt - (lo + (hi - lo) * share)))
    return statistics.median_high(errors) if len(errors) >= max(8, math.floor(len(columns) * 0.5 + 0.5)) else math.inf


def test_grids_around_the_best_cell():
    rng = np.random.default_rng(4)
    ring = 0.05 * rng.normal(size=72)
    ring[[5, 6]] = np.nan, -np.inf
    columns = np.sort(rng.uniform(-0.5, 0.5, 30))
    angles = camera.ring_angle(ring, 1.0 + 0.2 + columns) - 0.05
    angles[~np.isfinite(angles)] = 0.0
    best, (ra, sa, rt, st) = (0.0, 0.0, math.inf), (25, 2, 12, 1)
    for _ in range(3):
        cells = [(best[0] + math.radians(i * sa - ra), best[1] + math.radians(j * st - rt)) for i in range(math.floor(2 * ra / sa + 1e-6) + 1) for j in range(math.floor(2 * rt / st + 1e-6) + 1)]
        tried = [(plain_residual(columns, angles, 1.0, ring, a, t), a, t) for a, t in cells]
        least = min(t[0] for t in tried)
        if least < best[2]:
            best = next((a, t, e) for e, a, t in tried if e == least)
        ra, sa, rt, st = sa, sa / 5, st, st / 5
    assert camera.refined(columns, angles, 1.0, ring, 0.0, True) == pytest.approx(best)
    # truth within the finest steps
    assert best[0] == pytest.approx(0.2, abs=math.radians(0.5)) and best[1] == pytest.approx(0.05, abs=math.radians(0.1))


def test_matches_of_awkward_frames(spark):
    ring = [0.05 * math.sin(k / 5) + 0.02 * math.sin(k * 1.3) for k in range(360)]
    few = [0.1] * 20 + [None] * 80
    schema = "frame long, angles array<double>, centre double, fov double, ring array<double>, starts array<double>"
    off = math.radians(100)
    far = [camera.ring_angle(np.array(ring), np.array([0.3 + off + ((k + 0.5) / 100 - 0.5) * 1.2]))[0] for k in range(100)]
    rows = [(1, few, 0.0, 1.2, ring, None), (2, None, 0.0, 1.2, ring, None), (3, [], 0.0, 1.2, ring, []), (4, [0.1] * 100, 0.0, 1.2, [], [None]), (5, far, 0.3, 1.2, ring, [off + 0.01]), (6, far, 0.3, 1.2, ring, None), (7, far, 0.3, 1.2, [math.nan] * 360, None)]
    got = {r["frame"]: r for r in camera.matches(spark.createDataFrame([(i, None if a is None else [None if v is None else float(v) for v in a], *r) for i, a, *r in rows], schema)).collect()}
    assert [(got[i]["residual"], got[i]["azimuth"], got[i]["columns"]) for i in (1, 2, 3, 4, 7)] == [(None, 0, 20), (None, 0, 0), (None, 0, 0), (None, 0, 100), (None, 0, 100)]
    assert got[5]["azimuth"] == pytest.approx(off, abs=0.002) and got[5]["residual"] < 0.001 < got[6]["residual"]


def test_confidence(spark):
    rows = [(0.01, 0.1, True, 1.2, -1.0), (0.01, 0.1, True, 2.0, 0.7), (0.01, 0.1, True, 2.0, 0.0), (0.01, 0.1, False, 1.0, 0.0), (0.2, 0.1, True, 2.0, 0.3), (None, None, None, None, None), (0.0, 0.0, False, 1.0, -1.0)]
    got = spark.createDataFrame(rows, "e double, b double, own boolean, u double, a double").select(camera.confidence(*map(F.col, ("e", "b", "own", "u", "a"))).alias("c"))
    assert [r["c"] for r in got.collect()] == pytest.approx([0.72, 1.0, 0.45, 0.9, 0.0, 0.0, 0.0])


def test_calibrations_find_the_truth(spark):
    got = {r["frame"]: r for r in queries.camera_calibrations(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    off = {f: (abs(math.remainder(r["azimuth"] - queries.truth(f)[1], 2 * math.pi)), abs(r["tilt"] - queries.truth(f)[2])) for f, r in got.items()}
    good = [f for f, (a, t) in off.items() if a < math.radians(1) and t < math.radians(0.7)]
    assert len(good) > 0.9 * len(got)
    assert statistics.median(got[f]["confidence"] for f in good) > 0.5


def test_the_compass_hint_and_uniqueness(spark):
    ring = [math.sin(k * 2 * math.pi / 36) + 0.001 * math.sin(k * 2 * math.pi / 360) for k in range(360)]
    frames = spark.createDataFrame([(1, ring, ring[40:90], 7 * 2 * math.pi / 36 + 0.4)], "frame long, ring array<double>, ys array<double>, hint double")
    rows = skyline.hypotheses(frames, 50 * 2 * math.pi / 360).orderBy("rank").collect()
    plain = skyline.hypotheses(frames.drop("hint"), 50 * 2 * math.pi / 360).orderBy("rank").collect()
    assert plain[0]["place"] == 40 and 1 <= plain[0]["uniqueness"] < 1.05 and [r["score"] for r in plain] == sorted((r["score"] for r in plain), reverse=True)
    assert len(rows) == 5
