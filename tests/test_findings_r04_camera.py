"""F3 (camera_calibrations): the lines of several pictures are found together, and are those of each alone."""

import numpy as np
import pytest

from vistaspark.operators import camera, layout
from vistaspark.plans import camera as queries


def plain_line(strength):
    """The cheapest path by a loop over rows, of a picture alone."""
    rows, columns = strength.shape
    reach = layout.MOST_STEP
    cost, none, back, back_none = layout.NONE_COST - strength[:, 0], 0.0, [], []
    for x in range(1, columns):
        best = [min(((cost[k] + layout.STEP_COST * abs(k - y) ** 1.5, k) for k in range(max(0, y - reach), min(rows, y + reach + 1)))) for y in range(rows)]
        gap = int(cost.argmin())
        back.append([k if c < none + layout.ENTER_COST else -1 for c, k in best])
        back_none.append(gap if cost[gap] < none else -1)
        entered = np.array([min(c, none + layout.ENTER_COST) for c, _ in best])
        none, cost = min(none, cost[gap]), entered + layout.NONE_COST - strength[:, x]
    at, out = int(cost.argmin()) if cost.min() < none else -1, []
    for x in range(columns - 1, -1, -1):
        out.append(np.nan if at < 0 else at)
        at = -1 if x == 0 else back[x - 1][at] if at >= 0 else back_none[x - 1]
    return np.array(out[::-1])


def test_lines_of_pictures_together_are_those_of_each():
    rng = np.random.default_rng(5)
    strengths = rng.random((9, 24, 40)) ** 6 * rng.choice([0.0, 0.2, 0.5], (9, 1, 40))
    strengths[3], strengths[4] = 0, 1
    found = layout.likeliest_lines(strengths)
    assert np.isnan(found).any() and np.isfinite(found).any()
    for strength, line in zip(strengths, found, strict=True):
        np.testing.assert_array_equal(line, plain_line(strength))
        np.testing.assert_array_equal(line, layout.likeliest_line(strength))


def test_a_batch_of_pictures_asks_for_its_lines_once(monkeypatch):
    frames = [(queries.made_picture(f, queries.made_ring(np.linspace(-1, 1, 64) * (f + 1))), *queries.SIZE) for f in range(5)]
    alone = [camera.skyline_rows(*p) for p in frames]
    asked, lines = [], layout.likeliest_lines
    monkeypatch.setattr(camera, "likeliest_lines", lambda s: asked.append(len(s)) or lines(s))
    for one, other in zip(alone, camera.skylines_of(frames), strict=True):
        np.testing.assert_array_equal(one, other)
    assert asked == [5] and camera.skylines_of([]) == []


def test_a_step_back_is_sought_within_its_reach():
    grid = np.random.default_rng(6).normal(size=(30, 7))
    for better, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
        found = camera._about(grid, better, none)
        for y in range(30):
            near = [k for k in range(30) if 2 <= abs(k - y) <= camera.PULSE_REACH]
            np.testing.assert_array_equal(found[y], better.reduce(grid[near]))


def test_a_ring_with_holes_is_read_as_one_without():
    ring, at = np.random.default_rng(7).normal(size=72), np.linspace(-7, 7, 500)
    holed = ring.copy()
    holed[5] = np.nan
    whole, some = camera.ring_angle(ring, at), camera.ring_angle(holed, at)
    i = np.floor(at / (2 * np.pi / 72)).astype(int) % 72
    assert whole == pytest.approx(np.interp(at % (2 * np.pi), np.arange(73) * 2 * np.pi / 72, np.append(ring, ring[0])))
    np.testing.assert_array_equal(np.isnan(some), (i == 5) | (i == 4))
    np.testing.assert_array_equal(some[~np.isnan(some)], whole[~np.isnan(some)])
