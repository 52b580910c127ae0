"""The horizon around a point: ray march, layers, crests, fronts and visibility.

Survey A1-A6, A15, A16, G7, J12, J13, M5, M6, M8, M28, M29, ST14, T1, T7, T8, W1-W6, W15. A march is rows (ray, step, d, h); comparing slopes instead
of angles keeps arcs out of the windows, and every window is partitioned by the ray.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistaspark.functions import geo
from vistaspark.operators.dealing import spread

# Fixed values of the march: (up to, step) in metres, its reach, the layers' and the crests' bounds.
STEPS = ((5000, 90), (30000, 180), (100000, 350), (math.inf, 700))
REACH_M, EYE_M = 200000.0, 1.7
LAYERS = (0.0, 5000.0, 15000.0, 40000.0, 100000.0, 200000.0)
CREST_BOUNDS = (0.0, 800.0, 2000.0, 5000.0, 12000.0, 30000.0, 70000.0, 200001.0)
CREST_DROP, FRONT_START_M, FRONT_GAP_M = 0.0015, 500.0, 2000.0
PEAK_MARGIN_M, ANGLE_EPS, HIDDEN_DEPTH, HIDDEN_DEFICIT_M = 100.0, 0.0009, 0.052, 400.0


def march_steps(start: float = 150.0, reach: float = REACH_M) -> list[float]:
    """M5, M6: distances of the samples on a ray."""
    out, d = [], start
    while d <= reach:
        out.append(d)
        d += next(step for limit, step in STEPS if d < limit)
    return out


def steps_table(spark: SparkSession, start: float = 150.0, reach: float = REACH_M) -> DataFrame:
    rows = [(i, d, next(k for k in range(5) if d < LAYERS[k + 1] or k == 4), next(k for k in range(7) if d < CREST_BOUNDS[k + 1])) for i, d in enumerate(march_steps(start, reach))]
    return spark.createDataFrame(rows, "step int, d double, layer int, crest_bin int")


def march(spark: SparkSession, rays: int, height, eye: Column | float, start: float = 150.0) -> DataFrame:
    """Rows (ray, step, d, layer, crest_bin, slope); ``height(ray, d)`` is a Column, null for no data."""
    # a few hundred rows that depend on the reach alone
    rows = spark.range(rays).withColumnRenamed("id", "ray").crossJoin(F.broadcast(steps_table(spark, start)))
    seen = rows.withColumn("h", height(F.col("ray"), F.col("d"))).filter("h IS NOT NULL")
    return seen.withColumn("slope", (F.col("h") - eye - geo.drop_m(F.col("d"))) / F.col("d"))


def ray_points(spark: SparkSession, lat: float, lon: float, rays: int, start: float = 150.0, reach: float = REACH_M) -> DataFrame:
    """The places (lat, lon) of all samples of all rays, in the order of azimuth from north."""
    # a few hundred rows that depend on the reach alone
    steps = steps_table(spark, start, reach).withColumn("sin_r", F.sin(F.col("d") / geo.EARTH_M)).withColumn("cos_r", F.cos(F.col("d") / geo.EARTH_M))
    az = F.col("id") * (2 * math.pi / rays)
    to = geo.destination_tabled(F.lit(lat), F.lit(lon), az, F.col("sin_r"), F.col("cos_r"))
    rows = spark.range(rays).crossJoin(F.broadcast(steps))
    return rows.select(F.col("id").alias("ray"), "step", "d", "layer", "crest_bin", to[0].alias("lat"), to[1].alias("lon"))


def seen(points: DataFrame, eye: Column | float) -> DataFrame:
    """The march over sampled points (ray, step, d, h): those with a height, and the slope to each."""
    return points.filter("h IS NOT NULL").withColumn("slope", (F.col("h") - eye - geo.drop_m(F.col("d"))) / F.col("d"))


# Fixed values of the early exit: from where, how far below the layer's highest, how low that one lies.
EXIT_FROM_M, EXIT_DEPTH, EXIT_BELOW = 60_000.0, 0.02, -0.005


def early_exit(marched: DataFrame) -> DataFrame:
    """The march without what follows a ray's exit.

    A ray ends at the first far sample that lies well below the highest so far of its layer,
    once that one lies below the horizontal; the sample itself still counts.
    """
    so_far = Window.partitionBy("ray", "layer").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = marched.withColumn("layer_angle", F.atan(F.max("slope").over(so_far)))
    ends = (F.col("d") > EXIT_FROM_M) & (F.col("slope") < F.tan(F.col("layer_angle") - EXIT_DEPTH)) & (F.col("layer_angle") < EXIT_BELOW)
    cut = F.min(F.when(ends, F.col("step"))).over(Window.partitionBy("ray"))
    return rows.withColumn("cut", cut).filter("cut IS NULL OR step <= cut").drop("cut", "layer_angle")


def skyline(marched: DataFrame) -> DataFrame:
    """A2: of each ray the highest angle."""
    return marched.groupBy("ray").agg(F.atan(F.max("slope")).alias("angle"))


def horizon_distance(layered: DataFrame) -> DataFrame:
    """A3: the nearest of the distances at which the layers of a ray are highest."""
    return layered.groupBy("ray").agg(F.min("dist_m").alias("horizon_m"))


def smooth(layered: DataFrame, rays: int) -> DataFrame:
    """The layers' angles averaged over the neighbouring rays, by half a cell of the data at their distance, at most eight.

    ``layered``: ray, layer, slope, dist_m. The ring is closed; neighbours at another
    distance (by more than half) and holes don't count.
    """
    step = 2 * math.pi / rays
    half = F.least(F.lit(8.0), F.greatest(F.lit(0.0), F.floor(F.greatest(F.lit(90.0), F.col("dist_m") / 150) / 2 / F.col("dist_m") / step + 0.5)))
    own = layered.select("ray", "layer", F.atan("slope").alias("angle"), "dist_m", half.cast("int").alias("half"))
    wide = own.withColumn("other", F.explode(F.expr("sequence(-half, half)"))).withColumn("other", F.pmod(F.col("ray") + F.col("other"), F.lit(rays)))
    near = own.select(F.col("ray").alias("other"), "layer", F.col("angle").alias("near_angle"), F.col("dist_m").alias("near_m"))
    rows = wide.join(near, ["other", "layer"]).filter(F.abs(F.col("near_m") - F.col("dist_m")) / F.col("dist_m") <= 0.5)
    return rows.groupBy("ray", "layer").agg(F.avg("near_angle").alias("angle"), F.first("dist_m").alias("dist_m"))


def silhouette(*profiles: DataFrame) -> DataFrame:
    """Of each ray the highest angle of all profiles (ray, angle)."""
    rows = profiles[0].select("ray", "angle")
    for other in profiles[1:]:
        rows = rows.union(other.select("ray", "angle"))
    return rows.groupBy("ray").agg(F.max("angle").alias("angle"))


# Fixed value: a crest must stand out by this much over the nearer ones.
STANDS_OUT = 5e-4


def visible_crests(crested: DataFrame) -> DataFrame:
    """The crests (ray, crest_bin, slope) that rise above all nearer ones of their ray."""
    nearer = Window.partitionBy("ray").orderBy("crest_bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = crested.withColumn("angle", F.atan("slope"))
    return rows.withColumn("nearer", F.max("angle").over(nearer)).filter(F.col("nearer").isNull() | (F.col("angle") > F.col("nearer") + STANDS_OUT)).drop("nearer")


def angle_at(profile: DataFrame, at: DataFrame, rays: int) -> DataFrame:
    """The profile's angle at azimuths (id, az): between the two rays around, that of one where the other is a hole, null in a gap."""
    place = F.pmod(F.col("az"), F.lit(2 * math.pi)) / (2 * math.pi / rays)
    rows = at.withColumn("share", place - F.floor(place)).withColumn("r0", F.floor(place) % rays).withColumn("r1", (F.floor(place) + 1) % rays)
    ring = lambda r, a: F.broadcast(profile.select(F.col("ray").alias(r), F.col("angle").alias(a)))
    rows = rows.join(ring("r0", "a0"), "r0", "left").join(ring("r1", "a1"), "r1", "left")
    between = F.col("a0") + (F.col("a1") - F.col("a0")) * F.col("share")
    return rows.withColumn("angle", F.coalesce(between, "a0", "a1")).drop("r0", "r1", "a0", "a1", "share")


def auto_tilt(profile: DataFrame, centre: float, fov: float, rays: int) -> DataFrame:
    """Tilt of the view: the upper median of the silhouette within the sector, between 0 and 45 degrees; null for fewer than ten rays."""
    inside = profile.filter(geo.in_sector(F.col("ray") * (2 * math.pi / rays), F.lit(centre), F.lit(fov)))
    sorted_angles = F.sort_array(F.collect_list("angle"))  # at most a sector of one ring
    found = inside.agg(sorted_angles.alias("a"))
    return found.select(F.when(F.size("a") >= 10, F.least(F.lit(math.pi / 4), F.greatest(F.lit(0.0), F.get("a", F.floor(F.size("a") / 2).cast("int"))))).alias("tilt"))


def layers(marched: DataFrame) -> DataFrame:
    """A1-A3: of each ray and layer the highest slope and the first distance that has it."""
    top = F.max(F.struct(F.col("slope").alias("slope"), (-F.col("d")).alias("back")))
    return marched.groupBy("ray", "layer").agg(top.alias("top")).select("ray", "layer", F.col("top.slope").alias("slope"), (-F.col("top.back")).alias("dist_m"))


def records(marched: DataFrame) -> DataFrame:
    """The march with the highest slope before each sample."""
    before = Window.partitionBy("ray").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return marched.withColumn("before", F.max("slope").over(before))


def crests(marched: DataFrame) -> DataFrame:
    """Per ray and crest bin the highest ridge line.

    Each new highest slope opens a segment. It is a crest if the ground falls away from it
    later in its segment, or if it is the last of the ray.
    """
    along = Window.partitionBy("ray").orderBy("step")
    rows = records(marched).withColumn("segment", F.sum((F.col("before").isNull() | (F.col("slope") > F.col("before"))).cast("int")).over(along))
    head = F.min(F.struct("step", "slope", "crest_bin"))
    segments = rows.groupBy("ray", "segment").agg(head.alias("head"), F.min("slope").alias("low"))
    last = F.max("segment").over(Window.partitionBy("ray"))
    falls = F.col("low") < F.tan(F.atan("head.slope") - CREST_DROP)
    kept = segments.withColumn("last", last).filter(falls | (F.col("segment") == F.col("last")))
    return kept.groupBy("ray", F.col("head.crest_bin").alias("crest_bin")).agg(F.max("head.slope").alias("slope"))


def fronts(marched: DataFrame) -> DataFrame:
    """Rising visible ground as fronts, a gap of over 2 km between new heights opening one."""
    far = records(marched.filter(F.col("d") >= FRONT_START_M)).filter("before IS NULL OR slope > before")
    along = Window.partitionBy("ray").orderBy("step")
    opens = F.coalesce(F.col("d") - F.lag("d").over(along) > FRONT_GAP_M, F.lit(True)).cast("int")
    rows = far.withColumn("opens", opens).withColumn("front", F.sum("opens").over(along))
    return rows.groupBy("ray", "front").agg(F.min("d").alias("from_m"), F.max("d").alias("to_m"), F.min("slope").alias("slope_start"), F.max("slope").alias("slope_max"))


def peak_rays(peaks: DataFrame, lat: float, lon: float, reach: float = REACH_M) -> DataFrame:
    """Samples of the ray to each peak (id, lat, lon, ele) of a known height within reach, up to just before it."""
    spark = peaks.sparkSession
    here = (F.lit(lat), F.lit(lon))
    rows = peaks.filter("ele IS NOT NULL").withColumn("dist_m", geo.distance_m(*here, F.col("lat"), F.col("lon"))).filter(F.col("dist_m").between(1, reach))
    rows = spread(rows.withColumn("az", geo.azimuth(*here, F.col("lat"), F.col("lon"))).select("id", "ele", "dist_m", "az"), "id")
    steps = steps_table(spark, 100.0, reach).withColumn("sin_r", F.sin(F.col("d") / geo.EARTH_M)).withColumn("cos_r", F.cos(F.col("d") / geo.EARTH_M))
    # left, so that a peak nearer than the first sample stays
    along = rows.join(F.broadcast(steps), F.col("d") < F.col("dist_m") - PEAK_MARGIN_M, "left")
    to = geo.destination_tabled(*here, F.col("az"), F.col("sin_r"), F.col("cos_r"))
    return along.withColumn("lat", to[0]).withColumn("lon", to[1]).drop("sin_r", "cos_r", "layer", "crest_bin")


def visibility(rays: DataFrame, eye: float, horizon: DataFrame, ring: int) -> DataFrame:
    """What of each peak is seen: visible, onSlope, hidden by a little; what lies deeper is left out.

    ``rays``: ``peak_rays`` with heights; ``horizon``: ray, horizon_m of a ring of ``ring``
    rays, the nearest of which tells whether a covered peak stands before the horizon.
    """
    slope = (F.col("h") - eye - geo.drop_m(F.col("d"))) / F.col("d")
    rows = rays.groupBy("id").agg(*[F.first(c).alias(c) for c in ("ele", "dist_m", "az")], F.max(slope).alias("line"))
    rows = rows.withColumn("ray", F.floor(F.col("az") / (2 * math.pi / ring) + 0.5) % ring)
    rows = rows.join(F.broadcast(horizon), "ray", "left")  # a ring
    own = (F.col("ele") - eye - geo.drop_m(F.col("dist_m"))) / F.col("dist_m")
    rows = rows.withColumn("angle", F.atan(own)).withColumn("depth", F.atan("line") - F.col("angle")).withColumn("deficit", (F.col("line") - own) * F.col("dist_m"))
    covered = F.coalesce(F.col("depth") > ANGLE_EPS, F.lit(False))
    before = F.coalesce(F.col("dist_m") < F.col("horizon_m"), F.lit(True))
    little = (F.col("depth") <= HIDDEN_DEPTH) & (F.col("deficit") <= HIDDEN_DEFICIT_M)
    kind = F.when(~covered, "visible").when(before, "onSlope").when(little, "hidden")
    rows = rows.withColumn("visibility", kind).withColumn("deficit_m", F.when(F.col("visibility") == "hidden", F.col("deficit")))
    return rows.filter("visibility IS NOT NULL").select("id", "ele", "dist_m", "az", "angle", "visibility", "deficit_m")


def ranked(peaks: DataFrame, score: Column) -> DataFrame:
    """Visible, then on a slope, then hidden ones; the highest label score first in each."""
    order = F.when(F.col("visibility") == "visible", 0).when(F.col("visibility") == "onSlope", 1).otherwise(2)
    return peaks.withColumn("score", score).orderBy(order, F.desc("score"), "id")


def main_peak(peaks: DataFrame, centre: float, fov: float) -> DataFrame:
    """The highest peak in view that is not hidden, the first of equal ones."""
    inside = peaks.filter((F.col("visibility") != "hidden") & geo.in_sector(F.col("az"), F.lit(centre), F.lit(fov)))
    return inside.agg(F.max_by("id", F.struct("ele", -F.col("id"))).alias("id"))


def hidden_in_budget(peaks: DataFrame, placed: int, most: int = 6) -> DataFrame:
    """Hidden peaks that may still be named when so many labels are placed."""
    hidden, left = F.col("visibility") == "hidden", max(0, most - placed)
    # only hidden peaks compete: the best of each share of them, then the best of those; the others stay dealt by their id
    for share in (F.pmod(F.xxhash64("id"), F.lit(64)), F.when(hidden, 0).otherwise(F.xxhash64("id"))):
        first = Window.partitionBy(hidden, share).orderBy(F.desc("score"), "id")
        peaks = peaks.withColumn("n", F.row_number().over(first)).filter(~hidden | (F.col("n") <= left)).drop("n")
    return peaks


def preview(spark: SparkSession, lat: float, lon: float, rays: int = 720, reach: float = 12_000.0) -> DataFrame:
    """ST14: the places of a first look, few rays and near ones only; the whole march comes after it."""
    return ray_points(spark, lat, lon, rays, 150.0, reach)


# Fixed values of the match of peaks with fronts: the window of azimuth, the width of a peak, gaps of distance, weights.
WINDOW, PEAK_WIDE_M, LEAST_GAP_M, GAP_SHARE, WEIGHTS = (0.009, 0.052), 1500.0, 2000.0, 0.15, (0.4, 0.3, 0.3)


def markers(peaks: DataFrame, fronts_of: DataFrame, profile: DataFrame, rays: int) -> DataFrame:
    """Where each peak (id, az, dist_m, angle, visibility) is marked: on the front that fits its distance and azimuth best.

    A hidden peak is marked where it is; one without a front on the profile (ray, angle) at
    its azimuth. Peaks ask the few rays around theirs: an equi-join with the ring's fronts, which are as many for any number of peaks.
    """
    step = 2 * math.pi / rays
    window = F.greatest(F.lit(WINDOW[0]), F.least(F.lit(WINDOW[1]), F.atan2(F.lit(PEAK_WIDE_M), F.col("dist_m"))))
    middle, wide = F.floor(F.col("az") / step + 0.5), F.ceil(window / step)
    rows = peaks.filter("visibility <> 'hidden'").withColumn("window", window).withColumn("tolerance", F.greatest(F.lit(LEAST_GAP_M), F.col("dist_m") * GAP_SHARE))
    near = rows.withColumn("ray", F.explode(F.sequence(F.greatest(F.lit(0), middle - wide), F.least(F.lit(rays - 1), middle + wide))))
    near = near.join(F.broadcast(fronts_of), "ray").withColumn("gap", F.greatest(F.lit(0.0), F.col("from_m") - F.col("dist_m"), F.col("dist_m") - F.col("to_m"))).filter("gap <= tolerance")
    top = F.atan("slope_max")
    score = -(F.col("gap") / F.col("tolerance")) * WEIGHTS[0] - F.abs(geo.wrap_angle(F.col("ray") * step - F.col("az"))) / F.col("window") * WEIGHTS[1] + top / 0.3 * WEIGHTS[2]
    best = near.groupBy("id").agg(F.max(F.struct(F.round(score, 12).alias("score"), (-F.col("ray")).alias("ray"), (-F.col("front")).alias("front"), top.alias("top"))).alias("best"))
    line = angle_at(profile, peaks.select("id", "az"), rays).select("id", F.col("angle").alias("line"))
    found = peaks.join(best, "id", "left").join(line, "id")
    hidden = F.col("visibility") == "hidden"
    return found.select("id", F.when(hidden | F.col("best").isNull(), F.col("az")).otherwise(-F.col("best.ray") * step).alias("marker_az"), F.when(hidden, F.col("angle")).otherwise(F.coalesce("best.top", "line")).alias("marker_angle"))


def around(peaks: DataFrame, distance: float, views: int = 12) -> DataFrame:
    """Points (id, view, lat, lon) about each summit (id, lat, lon, ele), with the azimuth and distance back to it."""
    rows = peaks.select("id", "ele", F.col("lat").alias("top_lat"), F.col("lon").alias("top_lon"), F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view"))
    to = geo.destination(F.col("top_lat"), F.col("top_lon"), F.col("view") * (2 * math.pi) / views, F.lit(distance))
    rows = rows.withColumn("lat", to[0]).withColumn("lon", to[1])
    back = [F.col(c) for c in ("lat", "lon", "top_lat", "top_lon")]
    return rows.withColumn("az", geo.azimuth(*back)).withColumn("dist_m", geo.distance_m(*back))


def viewpoints(views: DataFrame, samples: DataFrame) -> DataFrame:
    """Of each summit the point to look at it from: one that sees it if there is one, the lowest, the first of equal ones.

    ``views``: ``around`` with the ground's height; ``samples``: id, view, d, h on the way.
    Points without ground don't count; with none the summit itself is given.
    """
    eye = F.col("ground") + EYE_M
    line = samples.join(views.select("id", "view", "ground"), ["id", "view"]).groupBy("id", "view").agg(F.max((F.col("h") - eye - geo.drop_m(F.col("d"))) / F.col("d")).alias("line"))
    own = F.atan((F.col("ele") - eye - geo.drop_m(F.col("dist_m"))) / F.col("dist_m"))
    rows = views.filter("ground IS NOT NULL").join(line, ["id", "view"], "left").withColumn("unseen", F.coalesce(F.atan("line") - own > ANGLE_EPS, F.lit(False)))
    best = rows.groupBy("id").agg(F.min(F.struct("unseen", F.round("ground", 6).alias("ground"), "view", "lat", "lon", "az")).alias("b"))
    summits = views.groupBy("id").agg(F.first("top_lat").alias("top_lat"), F.first("top_lon").alias("top_lon"))
    found = summits.join(best, "id", "left")
    return found.select("id", "b.view", F.coalesce("b.lat", "top_lat").alias("lat"), F.coalesce("b.lon", "top_lon").alias("lon"), F.coalesce("b.az", F.lit(0.0)).alias("az"), (~F.col("b.unseen")).alias("sees"))


def clipped_leaders(leaders: DataFrame, profile: DataFrame, rays: int, steps: int = 24) -> DataFrame:
    """Lines from labels to summits (id, az0, e0, az1, e1) cut where they go behind the profile (ray, angle): id, az, elevation.

    The cut lies on the straight line between the two steps about it.
    """
    share = F.col("step") / steps
    rows = leaders.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    rows = rows.select("id", "step", (F.col("az0") + (F.col("az1") - F.col("az0")) * share).alias("az"), (F.col("e0") + (F.col("e1") - F.col("e0")) * share).alias("e"))
    rows = angle_at(profile, rows, rays).withColumnRenamed("angle", "h")
    along = Window.partitionBy("id").orderBy("step")
    for c in ("az", "e", "h"):
        rows = rows.withColumn(f"last_{c}", F.lag(c).over(along))
    cut = F.min(F.when((F.col("step") > 0) & (F.col("e") < F.col("h")), F.col("step"))).over(Window.partitionBy("id"))
    ends = rows.withColumn("cut", cut).filter(F.col("step") == F.coalesce("cut", F.lit(steps)))
    tau = F.try_divide(F.col("last_e") - F.col("last_h"), (F.col("h") - F.col("last_h")) - (F.col("e") - F.col("last_e")))
    at = lambda c: F.when(F.col("cut").isNull(), F.col(c)).when(tau.between(0, 1), F.col(f"last_{c}") + (F.col(c) - F.col(f"last_{c}")) * tau).otherwise(F.col(f"last_{c}"))
    return ends.select("id", at("az").alias("az"), at("e").alias("elevation"))
