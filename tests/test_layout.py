"""Labels, lines and skylines of a frame, against plain rules."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaspark.operators import horizon, layout


def test_labels_keep_their_place_and_never_overlap(spark):
    rng = np.random.default_rng(3)
    rows = [(f, f"k{i}", f"Peak {i}", float(rng.integers(0, 400)), float(rng.integers(0, 200)), i, 1 if i == 39 else None) for f in range(2) for i in range(40)]
    placed = layout.place_labels(spark.createDataFrame(rows, "frame long, key string, text string, x double, y double, rank int, shown int")).collect()
    at = {(r[0], r[1]): r for r in rows}
    for f in range(2):
        boxes = []
        for p in placed:
            if p["frame"] == f:
                _, _, text, x, y, _, _ = at[f, p["key"]]
                half = (6.5 * len(text) + 8) / 2
                boxes.append((x + p["shift"] - half, y - 16 - 14 * (p["anchor"] > 0), x + p["shift"] + half, y))
        assert 5 < len(boxes) < 40
        assert not any(a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1] for a, b in itertools.combinations(boxes, 2))
    assert {p["anchor"] for p in placed if p["key"] == "k39"} == {1}


def test_parts_are_cut_from_the_ends():
    inside = lambda low, high: (lambda a, b: a >= low and b <= high)
    assert layout.visible_parts([10, 5, 5], inside(0, 20)) == (0, 2)
    assert layout.visible_parts([10, 5, 5], inside(0, 16)) == (0, 1)
    assert layout.visible_parts([10, 5, 5], inside(9, 16)) == (1, 1)
    assert layout.visible_parts([10], inside(0, 5)) is None


def cost_of(path, strength):
    total, past = 0.0, None
    for x, y in enumerate(path):
        if y is None:
            past = None
            continue
        total += layout.NONE_COST - strength[y, x]
        if x and past is None:
            total += layout.ENTER_COST
        elif x:
            total += layout.STEP_COST * abs(y - past) ** 1.5
        past = y
    return total


def test_the_likeliest_line_is_the_cheapest():
    rng = np.random.default_rng(7)
    for _ in range(30):
        strength = rng.random((3, 5)) * rng.choice([0.05, 0.5])
        paths = itertools.product([None, 0, 1, 2], repeat=5)
        best = min(cost_of(p, strength) for p in paths)
        got = [None if math.isnan(v) else int(v) for v in layout.likeliest_line(strength)]
        assert cost_of(got, strength) == pytest.approx(best)


def test_lines_are_simplified_within_the_tolerance(spark):
    x = np.arange(200.0)
    points = np.stack([x, 20 * np.sin(x / 15)], axis=1)
    kept = layout.simplified(points, 0.5)
    assert len(kept) < 60 and np.abs(np.interp(x, points[kept, 0], points[kept, 1]) - points[:, 1]).max() < 0.8
    rows = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(9)] + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 5.0), (2, 2, 2.0, 0.0)], "line long, seq long, x double, y double")
    assert sorted((r["line"], r["seq"]) for r in layout.simplify_lines(rows).collect()) == [(1, 0), (1, 8), (2, 0), (2, 1), (2, 2)]


def test_leaders_end_at_the_ridge(spark):
    ring = spark.range(360).select(F.col("id").alias("ray"), F.lit(0.1).alias("angle"))
    rows = spark.createDataFrame([(1, 1.0, 0.3, 1.2, 0.0), (2, 1.0, 0.3, 1.0, 0.2)], "id long, az0 double, e0 double, az1 double, e1 double")
    got = {r["id"]: (r["az"], r["elevation"]) for r in horizon.clipped_leaders(rows, ring, 360).collect()}
    assert got[1] == pytest.approx((1.0 + 0.2 * 2 / 3, 0.1)) and got[2] == pytest.approx((1.0, 0.2))
