"""Skylines of camera frames against the horizon's ring (survey A11-A14, J19, M19-M21, M26, ST7, T6).

A profile is rows (frame, col, y), without a row where the border is unknown.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaspark.functions import geo

# Observations of a column, its jitter, columns that two profiles share, shifts, least share and spread
# of a profile, separation of hypotheses, least score, bonus near the compass, windows of an anchor.
LEAST_SEEN, JITTER, LEAST_COMMON, MOST_SHIFT, LEAST_VALID, LEAST_SPREAD = 3, 0.03, 20, 6, 0.4, 0.005
APART, LEAST_SCORE, BONUS, NEAR_COMPASS = math.radians(5), 0.6, 0.08, math.radians(20)
ANCHOR_WIDE, ANCHOR_HIGH = math.radians(0.6), math.radians(0.5)


def upper_median(values: Column) -> Column:
    """The middle of sorted values, the upper of two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def stabilised(profiles: DataFrame, jitter: float = JITTER) -> DataFrame:
    """Of each session and column (session, frame, col, y) the upper median over its frames and the spread about it.

    Columns seen too seldom or that move too much have no y. A session is a set of frames that
    belong together; over a film ``streaming.stateful`` tracks the last ones.
    """
    columns = profiles.groupBy("session", "col").agg(F.collect_list("y").alias("ys")).withColumn("median", upper_median(F.col("ys")))
    spread = F.aggregate("ys", F.lit(0.0), lambda s, y: s + (y - F.col("median")) * (y - F.col("median"))) / F.size("ys")
    rows = columns.filter(F.size("ys") >= LEAST_SEEN).withColumn("variance", spread)
    return rows.select("session", "col", F.when(F.sqrt("variance") <= jitter, F.col("median")).alias("y"), "variance")


def best_shift(raw: DataFrame, reference: DataFrame, most: int = MOST_SHIFT) -> DataFrame:
    """Of each frame the shift of columns at which it differs least, in the mean square, from its reference (frame, col, y).

    Shifts with few columns in common don't count; the first of equal ones; 0 if none is left.
    """
    shifted = raw.select("frame", "col", "y", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("col", F.col("col") - F.col("shift"))
    both = shifted.join(reference.select("frame", "col", F.col("y").alias("ref")), ["frame", "col"])
    errors = both.groupBy("frame", "shift").agg(F.avg((F.col("y") - F.col("ref")) * (F.col("y") - F.col("ref"))).alias("error"), F.count(F.lit(1)).alias("n"))
    best = errors.filter(F.col("n") >= LEAST_COMMON).groupBy("frame").agg(F.min(F.struct(F.round("error", 12).alias("error"), "shift")).alias("best"))
    return raw.select("frame").distinct().join(best, "frame", "left").select("frame", F.coalesce("best.shift", F.lit(0)).alias("shift"), "best.error")


def residuals(profiles: DataFrame, rings: DataFrame, rays: int, shifts: DataFrame) -> DataFrame:
    """Of each frame the upper median of the differences between its profile and its ring, for each shift (shift, tilt).

    ``profiles``: frame, col (a ray's offset), y; ``rings``: frame, ray, angle; ``shifts`` is a
    grid and broadcast. Shifts with too few columns over the ring have no median.
    """
    seen = profiles.groupBy("frame").agg(F.collect_list(F.struct("col", "y")).alias("seen"))
    held = rings.groupBy("frame").agg(F.collect_list(F.struct("ray", "angle")).alias("held"))
    # a frame's profile and ring are exchanged once; the grid opens within the row
    by_ray = F.transform(F.sequence(F.lit(0), F.lit(rays - 1)), lambda slot: F.transform(F.filter("held", lambda h: h["ray"] == slot), lambda h: h["angle"]))
    rows = seen.join(held, "frame").select("frame", "seen", by_ray.alias("ring")).join(F.broadcast(shifts))
    ray = lambda p: F.pmod(p["col"] + F.col("shift"), F.lit(rays)).cast("int")
    met = F.transform("seen", lambda p: F.transform(F.get("ring", ray(p)), lambda angle: F.abs(p["y"] + F.col("tilt") - angle)))
    rows = rows.select("frame", "shift", "tilt", F.size("seen").alias("known"), F.flatten(F.filter(met, lambda e: e.isNotNull())).alias("errors")).filter(F.size("errors") > 0)
    rows = rows.withColumn("errors", F.filter("errors", lambda e: e.isNotNull()))
    enough = F.size("errors") >= F.greatest(F.lit(8), F.round(F.col("known") * 0.5))
    return rows.select("frame", "shift", "tilt", F.when(enough, upper_median(F.col("errors"))).alias("residual"))


def is_telling(ys: Column, columns: int) -> Column:
    """Enough columns of a profile are known, and they are not flat."""
    mean = lambda f: F.aggregate(F.transform(ys, f), F.lit(0.0), lambda s, v: s + v) / F.size(ys)
    spread = F.sqrt(F.greatest(F.lit(0.0), mean(lambda v: v * v) - mean(lambda v: v) * mean(lambda v: v)))
    return (F.size(ys) >= columns * LEAST_VALID) & (spread >= LEAST_SPREAD)


def ring_scores(ring: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """The correlation of a frame (NaN: unknown) with the ring at each shift, over the pairs that both have; -1 where those are few."""
    n = len(ring)
    known_r, known_f = np.isfinite(ring).astype(float), np.zeros(n)
    known_f[: len(frame)] = np.isfinite(frame)
    r, f = np.nan_to_num(ring), np.zeros(n)
    f[: len(frame)] = np.nan_to_num(frame)
    of_known_r, of_r, of_r2 = (np.fft.rfft(x) for x in (known_r, r, r * r))
    of_known_f, of_f, of_f2 = (np.conj(np.fft.rfft(x)) for x in (known_f, f, f * f))
    over = lambda a, b: np.fft.irfft(a * b, n)
    pairs, both = over(of_known_r, of_known_f), over(of_r, of_f)
    sum_r, sum_r2, sum_f, sum_f2 = over(of_r, of_known_f), over(of_r2, of_known_f), over(of_known_r, of_f), over(of_known_r, of_f2)
    m = np.maximum(pairs, 1e-9)
    spread = (sum_r2 - sum_r**2 / m) * (sum_f2 - sum_f**2 / m)
    score = np.where(spread > 1e-12, (both - sum_r * sum_f / m) / np.sqrt(np.maximum(spread, 1e-12)), -1.0)
    return np.where(pairs < known_f.sum() * LEAST_VALID - 1e-6, -1.0, score)


def apart_peaks(scores: np.ndarray, separation: int, most: int = 5) -> list[int]:
    """The places of the highest positive scores, none within ``separation`` of a higher one on the ring."""
    n, taken, out = len(scores), np.zeros(len(scores), bool), []
    for s in np.argsort(-scores, kind="stable"):
        if scores[s] <= 0 or len(out) == most:
            break
        if not taken[s]:
            taken[(s + np.arange(-separation, separation + 1)) % n] = True
            out.append(int(s))
    return out


def frame_hypotheses(ring: np.ndarray, ys: np.ndarray, hint: float, fov: float, most: int = 5, least: float = LEAST_SCORE) -> list[tuple[int, float, float, float, int]]:
    """M20, M21, T6 of one frame: (place, centre, score, uniqueness, rank), best first; ``hint`` is NaN if there is none."""
    step = 2 * math.pi / len(ring)
    scores = np.round(ring_scores(ring, ys), 9)
    found = apart_peaks(scores, round(APART / step), most)
    if not found:
        return []
    unique = scores[found[0]] / scores[found[1]] if len(found) > 1 else 2.0
    rows = []
    for s in found:
        centre = math.remainder(s * step + fov / 2, 2 * math.pi)
        off = s * step + fov / 2 - hint
        near = np.isfinite(off) and abs(off - 2 * math.pi * round(off / (2 * math.pi))) < NEAR_COMPASS
        rows.append((s, centre, scores[s] + (scores[found[0]] * BONUS if near else 0.0), unique))
    rows = sorted((r for r in rows if r[2] >= least), key=lambda r: -r[2])
    return [(*r, k + 1) for k, r in enumerate(rows)]


def hypotheses(frames: DataFrame, fov: float, most: int = 5, least: float = LEAST_SCORE) -> DataFrame:
    """Where on its ring a frame (frame, ring, ys) may look: rank, place of its left edge, centre, score, uniqueness.

    ``uniqueness``: the best score over that of the next place apart, 2 if there is none;
    places near the compass (a column ``hint``, if there is one) gain a little. Scores count to
    nine decimals, so that places that correlate alike are equal and the first is taken.
    """
    frames = frames if "hint" in frames.columns else frames.withColumn("hint", F.lit(None).cast("double"))

    def run(batches):
        for batch in batches:
            out = []
            for frame, ring, ys, hint in zip(batch["frame"], batch["ring"], batch["ys"], batch["hint"], strict=True):
                out += [(frame, *r) for r in frame_hypotheses(np.asarray(ring, float), np.asarray(ys, float), hint, fov, most, least)]
            yield pd.DataFrame(out, columns=["frame", "place", "centre", "score", "uniqueness", "rank"])

    return frames.select("frame", "ring", "ys", "hint").mapInPandas(run, "frame long, place int, centre double, score double, uniqueness double, rank int")


def anchor_scores(frames: DataFrame, profile: DataFrame, peaks: DataFrame, columns: int, fov: float) -> DataFrame:
    """Of each frame (frame, place, centre) the share of the peaks visible from its place (place, az, elevation) and in view that its profile has a top for; -1 for fewer than two.

    Frames meet the peaks of their own place, and of the profile only the columns near a peak.
    """
    off = geo.wrap_angle(F.col("az") - F.col("centre"))
    seen = frames.join(peaks, "place").filter(F.abs(off) < fov / 2).withColumn("left", geo.wrap_angle(F.col("centre") - fov / 2))
    middle = F.floor(geo.wrap_angle(F.col("az") - F.col("left")) / fov * columns + 0.5)
    wide = max(1, math.floor(ANCHOR_WIDE / fov * columns + 0.5))
    near = seen.withColumn("col", F.explode(F.sequence(middle - wide, middle + wide))).withColumn("col", F.pmod(F.col("col"), F.lit(columns)))
    tops = near.join(profile, ["frame", "col"], "left").groupBy("frame", "az", "elevation").agg(F.max("y").alias("top"))
    agreed = F.coalesce(F.abs(F.col("top") - F.col("elevation")) < ANCHOR_HIGH, F.lit(False))
    counts = tops.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.avg(agreed.cast("int")).alias("share"))
    return frames.join(counts, "frame", "left").select("frame", F.when(F.col("n") >= 2, F.col("share")).otherwise(-1.0).alias("anchors"))


def sector_bounds(tiles: DataFrame, lat: float, lon: float, sectors: int, from_m: float = 20_000.0) -> DataFrame:
    """Of each sector about a point the highest tile (box, h) whose circle reaches into it, 0 if none does.

    Tiles wholly nearer than ``from_m`` are left out; a tile about the point is in all sectors.
    """
    part = 2 * math.pi / sectors
    mid_lat, mid_lon = geo.bbox_centre()
    rows = tiles.withColumn("mid_lat", mid_lat).withColumn("mid_lon", mid_lon)
    away = geo.distance_m(F.lit(lat), F.lit(lon), F.col("mid_lat"), F.col("mid_lon"))
    wide = F.abs(F.col("max_lon") - F.col("min_lon"))
    wide = F.when(wide > 180, 360 - wide).otherwise(wide) * geo.DEGREE_M * F.cos(F.radians("mid_lat"))
    rows = rows.withColumn("away", away).withColumn("r", F.hypot(wide, (F.col("max_lat") - F.col("min_lat")) * geo.DEGREE_M) / 2).filter(F.col("away") + F.col("r") >= from_m)
    az = geo.azimuth(F.lit(lat), F.lit(lon), F.col("mid_lat"), F.col("mid_lon"))
    half = F.atan2("r", "away") + part
    s0, s1 = F.floor((az - half) / part), F.ceil((az + half) / part) - 1
    every = (F.col("away") <= F.col("r")) | (s1 - s0 + 1 >= sectors)
    spread = rows.withColumn("s", F.explode(F.sequence(F.when(every, 0).otherwise(s0), F.when(every, sectors - 1).otherwise(s1))))
    best = spread.groupBy(F.pmod(F.col("s"), F.lit(sectors)).alias("sector")).agg(F.max("h").alias("h"))
    return tiles.sparkSession.range(sectors).withColumnRenamed("id", "sector").join(best, "sector", "left").withColumn("h", F.coalesce("h", F.lit(0)))
