"""The labels of a panorama against brute force and their own rules."""

import itertools
import math
import random

import numpy as np
import pytest

from vistaspark.operators import panorama_labels as pl
from vistaspark.plans import imaging

SF = "/root/testdata/sf0.001"


def test_the_least_lift_is_that_of_a_fine_grid():
    rng = random.Random(4)
    for _ in range(300):
        boxes = np.array([(rng.uniform(-60, 60), u := rng.uniform(-100, 100), u + rng.uniform(5, 60)) for _ in range(rng.randint(1, 12))])
        lines = np.array([(rng.uniform(-5, 5) - 15 * k, u := rng.uniform(-60, 60), u + rng.uniform(5, 60)) for k in range(rng.randint(1, 3))])
        for way in (pl.PLAIN, pl.MIRROR):
            found = pl.least_free(pl.forbidden_lifts(lines, boxes, way, 15.0, 8.0))

            def meets(lift, way=way, boxes=boxes, lines=lines):
                return any(
                    abs(v + lift * way[1] - b[0]) < 15 - 1e-7 and a + lift * way[0] < b[2] + 8 - 1e-7 and z + lift * way[0] > b[1] - 8 + 1e-7
                    for v, a, z in lines for b in boxes
                )

            assert not meets(found)
            assert all(meets(x) for x in np.arange(0.005, found - 0.005, 0.01)), (found, way)


def test_segments_and_boxes_by_sampling():
    rng = random.Random(8)
    for _ in range(500):
        s = np.array([rng.uniform(-10, 10) for _ in range(4)])
        if rng.random() < 0.3:
            s[2 + rng.randrange(2)] = s[0] if rng.random() < 0.5 else s[1]
        box = np.array([[rng.uniform(-8, 8), a := rng.uniform(-8, 8), a + rng.uniform(0.5, 6)]])
        at = s[:2] + np.linspace(0, 1, 4001)[:, None] * (s[2:] - s[:2])
        near = ((at[:, 0] >= box[0, 1] - 0.01) & (at[:, 0] <= box[0, 2] + 0.01) & (abs(at[:, 1] - box[0, 0]) <= 1.01)).any()
        deep = ((at[:, 0] >= box[0, 1] + 0.01) & (at[:, 0] <= box[0, 2] - 0.01) & (abs(at[:, 1] - box[0, 0]) <= 0.99)).any()
        if near == deep:
            assert pl.meet_boxes(s[None], box, 1.0) == deep
    assert pl.cross(np.array([0, 0, 2, 2.0]), np.array([[0, 2, 2, 0.0]])) and not pl.cross(np.array([0, 0, 2, 2.0]), np.array([[2, 2, 3, 0.0]]))


def checked(picture):
    """No box meets another, no leader a box of another label or another leader."""
    for a, b in itertools.combinations(picture.placed, 2):
        for x, y in itertools.product(a.drawn.boxes, b.drawn.boxes):
            assert abs(x[0] - y[0]) >= picture.lane - 1e-6 or x[1] >= y[2] + picture.gap - 1e-6 or y[1] >= x[2] + picture.gap - 1e-6
        assert not pl.cross(a.leader, b.leader[None])
        for one, other in ((a, b), (b, a)):
            assert not pl.meet_boxes(one.leader[None], other.drawn.boxes, pl.HALF_LETTER * picture.scale)
    for p in picture.placed:
        assert 0 <= p.lift <= picture.most
        assert 1 <= len(p.drawn.lines) <= pl.MOST_LINES


def test_nothing_overlaps_in_crowded_pictures():
    rng = random.Random(2)
    names = ["Ushba", "Gora Ushba South", "Pic-Ouest", "Dent du Géant de la Vanoise", "X"]
    seen = set()
    for f in range(25):
        ridge = [240 + 70 * math.sin(f * 0.37 + j * 0.4) if j % 9 else math.nan for j in range(33)]
        p = pl.Picture(700, 420, rng.choice([1.0, 1.25]), rng.uniform(-0.3, 0.3), ridge)
        tried = [p.place(i, rng.uniform(-80, 720), rng.uniform(60, 330), rng.choice(names), ["4127 m", "12 km"][: rng.randint(0, 2)], i % 4 == 0) for i in range(30)]
        assert 3 < sum(tried) == len(p.placed) < 30
        checked(p)
        for q in p.placed:
            seen.add((q.form, q.mirrored))
            if q.key % 4 == 0:
                assert all(p.over_ridge(b[1], b[0], b[2] - b[1]) for b in q.drawn.boxes)
    assert {form for form, _ in seen} == set("ABCD") and {True, False} == {m for _, m in seen}


def test_forms_where_they_are_due():
    p = pl.Picture(800, 480)
    assert p.place(1, 300, 300, "Ushba", ["4710 m", "12 km"], False)
    one = p.placed[0]
    assert (one.form, one.lift, one.drawn.lines) == ("A", 0.0, [("Ushba · 4710 m · 12 km", 0, 2)])
    # the foot is the lead away from the peak, along the text
    assert one.leader == pytest.approx([np.dot((300, 300), pl.U), np.dot((300, 300), pl.V), np.dot((300, 300), pl.U) + 7, np.dot((300, 300), pl.V)])
    # the same peak again is moved by just a lane, to the side that costs less
    assert p.place(2, 300, 300, "Ushba", ["4710 m", "12 km"], False) is False or p.placed[1].lift >= 15
    # close to the top nothing fits whole: less is shown, or more than fits hangs out
    top = pl.Picture(800, 480)
    assert top.place(1, 300, 70, "Mount Everest Sagarmatha", ["8848 m", "9 km"], False)
    assert top.placed[0].form in "BCD" and top.placed[0].drawn.lines[0][0].startswith("Mount")
    assert not top.place(2, 300, -1, "Over", [], False) and not top.place(3, 300, 500, "Under", [], False) and not top.place(4, 300, 10, "High", [], False)
    # a hidden peak's label stands over the ridge, its leader ends at it
    behind = pl.Picture(800, 480, ridge=[200.0, 200.0])
    assert behind.place(1, 300, 260, "Kazbek", [], True)
    box, leader = behind.placed[0].drawn.boxes[0], behind.placed[0].leader
    assert (box[1] * pl.U + box[0] * pl.V)[1] <= 200 - 5
    assert (leader[0] * pl.U + leader[1] * pl.V)[1] == pytest.approx(200)
    flat = pl.Picture(800, 480, ridge=[20.0, 20.0])
    assert not flat.place(1, 300, 400, "Kazbek", [], True)


def test_name_breaks():
    assert pl.name_breaks("Mont Blanc") == [(4, 5)]
    assert pl.name_breaks("Pic-Ouest") == [(4, 4)]
    assert pl.name_breaks("- a b c d e f g h i j") == [(3 + 2 * k, 4 + 2 * k) for k in range(-1, 6)]
    assert pl.name_breaks("") == pl.name_breaks("Ushba") == []


LABELS = "frame long, key long, x double, y double, name string, info array<string>, hidden boolean, rank double"
FRAMES = "frame long, width double, height double, scale double, roll double, ridge array<double>"


def test_pictures_by_rank_with_a_budget(spark):
    rows = [(1, k, 60.0 + 25 * k, 200.0 + k, f"Peak {k}", ["1 m"], k % 2 == 0, float(-k)) for k in range(20)]
    rows += [(2, k, 100.0 * k, 300.0, f"Hidden {k}", None, True, float(k)) for k in range(12)]
    rows += [(3, 1, None, 200.0, "a", [], False, 1.0), (3, 2, 100.0, 200.0, None, [], False, 1.0), (3, 3, 5e6, 200.0, "far", [], False, 1.0), (3, 4, 200.0, 200.0, "ok", [None], None, None), (3, 4, 200.0, 200.0, "ok", [None], None, None), (9, 1, 1.0, 200.0, "no picture", [], False, 1.0)]
    frames = [(1, 800.0, 480.0, 1.0, 0.1, None), (2, 1200.0, 480.0, 1.0, 0.0, [250.0, 250.0]), (3, 800.0, 480.0, 1.0, 0.0, None), (4, 800.0, 480.0, 1.0, 0.0, None)]
    got = pl.panorama_labels(spark.createDataFrame(rows, LABELS), spark.createDataFrame(frames, FRAMES)).collect()
    for f, width, height, scale, roll, ridge in frames:
        picture = pl.Picture(width, height, scale, roll, ridge)
        mine = [r for r in rows if r[0] == f and r[2] is not None and r[4] is not None and r[2] < 5000]
        key = lambda r: (r[7] is not None, r[7])
        for r in sorted((r for r in mine if not r[6]), key=key):
            picture.place(r[1], r[2], r[3], r[4], [i for i in r[5] or [] if i], False)
        budget = max(0, 6 - len(picture.placed))
        for r in sorted((r for r in mine if r[6]), key=key):
            if budget:
                budget -= picture.place(r[1], r[2], r[3], r[4], r[5] or [], True)
        want = [(p.key, p.form, k, text, *box) for p in picture.placed for k, ((text, _, _), box) in enumerate(zip(p.drawn.lines, p.drawn.boxes.tolist(), strict=True))]
        assert sorted((r["key"], r["form"], r["line"], r["text"], r["v"], r["u0"], r["u1"]) for r in got if r["frame"] == f) == sorted(want)
        checked(picture)
    assert {r["key"] for r in got if r["frame"] == 2} == set(range(6))
    assert len({r["key"] for r in got if r["frame"] == 1}) > 5
    none = spark.createDataFrame([], LABELS)
    assert pl.panorama_labels(none, spark.createDataFrame(frames, FRAMES)).count() == 0


def test_the_query_places_labels_without_overlaps(spark):
    rows = imaging.panorama_label_lines(spark, SF).collect()
    frames = {r["frame"]: r for r in imaging._label_frames(spark, SF).collect()}
    by_frame = {}
    for r in rows:
        by_frame.setdefault(r["frame"], []).append(r)
    assert len(by_frame) > 90
    for f, lines in by_frame.items():
        scale = frames[f]["scale"]
        for a, b in itertools.combinations(lines, 2):
            if a["key"] != b["key"]:
                assert abs(a["v"] - b["v"]) >= 15 * scale - 1e-3 or a["u0"] >= b["u1"] + 8 * scale - 1e-3 or b["u0"] >= a["u1"] + 8 * scale - 1e-3
