"""F2 (panorama_label_lines): forms and lifts that can't be better than the best so far aren't tried, and nothing changes by it."""

import math
import random

from pyspark.sql import functions as F

from vistaspark.operators import panorama_labels as pl


def test_a_label_that_stands_whole_is_tried_once(monkeypatch):
    tried, lowest = [], pl.Picture.lowest
    monkeypatch.setattr(pl.Picture, "lowest", lambda self, lines, *rest: tried.append(len(lines)) or lowest(self, lines, *rest))
    picture = pl.Picture(800, 480)
    assert picture.place(1, 200, 300, "Ushba", ["4710 m", "12 km"], False) and picture.place(2, 500, 300, "Shkhara", ["5193 m"], False)
    assert tried == [1, 1]


def _placed(seed):
    rng, out = random.Random(seed), []
    names = ["Ushba", "Gora Ushba South", "Pic-Ouest", "Dent du Géant de la Vanoise", "Mount Everest Sagarmatha Chomolungma", "X"]
    for f in range(12):
        ridge = [240 + 70 * math.sin(f * 0.37 + j * 0.4) if j % 9 else math.nan for j in range(33)]
        p = pl.Picture(rng.choice([500, 700]), 420, rng.choice([1.0, 1.25]), rng.uniform(-0.3, 0.3), ridge)
        for i in range(30):
            p.place(i, rng.uniform(-80, 720), rng.uniform(30, 330), rng.choice(names), ["4127 m", "12 km"][: rng.randint(0, 2)], i % 4 == 0)
        out += [(f, q.key, q.form, q.lift, q.mirrored, q.drawn.lines, q.drawn.boxes.tolist(), q.leader.tolist()) for q in p.placed]
    return out


def test_what_is_not_tried_would_not_be_better(monkeypatch):
    found = [_placed(seed) for seed in range(6)]
    assert {q[2] for some in found for q in some} == set("ABCD")
    monkeypatch.setattr(pl, "SLACK", 1e9)  # nothing is left out
    assert [_placed(seed) for seed in range(6)] == found


def test_a_picture_meets_its_labels_once(spark):
    frames = spark.range(9).select(F.col("id").alias("frame"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("roll"), F.array(F.lit(240.0), F.lit(250.0)).alias("ridge"))
    labels = spark.range(30).select((F.col("id") % 9).alias("frame"), F.col("id").alias("key"), (F.col("id") * 20.0).alias("x"), F.lit(200.0).alias("y"), F.lit("Peak").alias("name"), F.array(F.lit("1 m")).alias("info"), F.lit(False).alias("hidden"), F.col("id").alias("rank"))
    found = pl.panorama_labels(labels, frames)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin") == 2
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
