"""What the reviewer of round 3 found in the terrain queries."""

import math

import numpy as np
from pyspark.sql import functions as F

from vistaspark.functions import geo
from vistaspark.operators import horizon, skyline


def test_a_place_at_the_edge_of_the_compass_gains_nothing(spark):
    ring = np.sin(np.arange(64) * 0.7) + 0.3 * np.cos(np.arange(64) ** 2 * 0.11)
    fov = 16 * 2 * math.pi / 64
    # place 32 looks to 225 degrees; a hint at 205 is 20 degrees away, not less
    ys = ring[(32 + np.arange(16)) % 64]
    rows = spark.createDataFrame([(0, ring.tolist(), ys.tolist(), math.radians(205.0)), (1, ring.tolist(), ys.tolist(), math.radians(206.0))], "frame long, ring array<double>, ys array<double>, hint double")
    got = {(r.frame, r.place): r.score for r in skyline.hypotheses(rows, fov, least=-1.0).collect()}
    assert got[(0, 32)] == 1.0
    assert got[(1, 32)] == 1.08


def test_places_that_correlate_alike_keep_their_order(spark):
    # a ring of two equal halves: each place has a twin, of which the first counts
    half = np.sin(np.arange(32) * 1.3) + 0.2 * np.cos(np.arange(32) * 2.9)
    ring = np.concatenate([half, half])
    for at in range(32):
        ys = ring[(at + np.arange(16)) % 64]
        rows = spark.createDataFrame([(0, ring.tolist(), ys.tolist())], "frame long, ring array<double>, ys array<double>")
        best = skyline.hypotheses(rows, 1.0, least=-1.0).filter("rank <= 2").orderBy("rank").collect()
        assert [r.place for r in best] == [at, at + 32]
        assert best[0].score == best[1].score == 1.0


def test_a_point_due_north_keeps_its_longitude(spark):
    lons = [40.4371, 40.1871, 42.9371, -179.9999, 41.4371]
    rows = spark.createDataFrame([(x,) for x in lons], "lon double").select("lon", geo.normalize_lon(F.col("lon")).alias("same"), geo.normalize_lon(F.col("lon") + 360).alias("round"))
    for r in rows.collect():
        assert r.same == r.lon
        assert abs(r.round - r.lon) < 1e-9
    views = horizon.around(spark.createDataFrame([(1, 2000, 43.0, 40.4371)], "id long, ele int, lat double, lon double"), 6000.0)
    assert views.filter("view = 0").first().lon == math.degrees(math.radians(40.4371))
