"""Panoramas over a raster: samples, horizons, crests, fronts and peaks, each query with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.functions import geo, scores
from vistaspark.operators import horizon, sampling
from vistaspark.plans import fixtures as fx
from vistaspark.plans.registry import query

LAT, LON = 43.35, 42.44
EYE = 5701.7
RAYS = 3600
TURN = repr(2 * math.pi)
DROP = "d * d * ((1 - 0.13e0) / (2 * 6371000e0))"
#: Steps of the march as a recursion of their own, from ``start`` on.
STEPS = """{name}(step, d) AS (SELECT CAST(0 AS INT), {start}e0 UNION ALL
  SELECT step + 1, d + CASE WHEN d < 5000 THEN 90 WHEN d < 30000 THEN 180 WHEN d < 100000 THEN 350 ELSE 700 END FROM {name}
  WHERE d + CASE WHEN d < 5000 THEN 90 WHEN d < 30000 THEN 180 WHEN d < 100000 THEN 350 ELSE 700 END <= 200000)"""
TO = "asin(least(1e0, greatest(-1e0, sin(radians(43.35e0)) * cos(d / 6371000e0) + cos(radians(43.35e0)) * sin(d / 6371000e0) * cos(az))))"
PLACE = f"""degrees({TO}) AS lat, degrees(radians(42.44e0) + atan2(sin(az) * sin(d / 6371000e0) * cos(radians(43.35e0)), cos(d / 6371000e0) - sin(radians(43.35e0)) * sin({TO}))) AS lon"""
MARCH = f"""{STEPS.format(name="st", start=150)}, {fx.RASTER},
bins AS (SELECT step, d, CASE WHEN d < 5000 THEN 0 WHEN d < 15000 THEN 1 WHEN d < 40000 THEN 2 WHEN d < 100000 THEN 3 ELSE 4 END AS layer,
  CASE WHEN d < 800 THEN 0 WHEN d < 2000 THEN 1 WHEN d < 5000 THEN 2 WHEN d < 12000 THEN 3 WHEN d < 30000 THEN 4 WHEN d < 70000 THEN 5 ELSE 6 END AS crest_bin FROM st),
rays AS (SELECT range AS ray, range * ({TURN} / 3600) AS az FROM range(3600)),
pts AS (SELECT ray, step, d, layer, crest_bin, {PLACE} FROM rays, bins),
{fx.sampled_sql("sampled", "pts")},
march AS (SELECT ray, step, d, layer, crest_bin, (h - {EYE}e0 - {DROP}) / d AS slope FROM sampled WHERE h IS NOT NULL)"""
RECORDS = f"{MARCH}, rec AS (SELECT *, max(slope) OVER (PARTITION BY ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM march)"
LAYERS = f"{MARCH}, layered AS (SELECT ray, layer, max(slope) AS slope, arg_max(d, (round(slope, 15), -d)) AS dist_m FROM march GROUP BY ray, layer)"


def march(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = horizon.ray_points(spark, LAT, LON, RAYS)
    return horizon.seen(sampling.sample(points, fx.pyramid(spark, sf_dir)), EYE)


@query(f"WITH RECURSIVE {LAYERS} SELECT ray, CAST(layer AS INT) AS layer, round(slope, 9) AS slope, dist_m FROM layered")
def horizon_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest ground of each ray and distance layer."""
    return horizon.layers(march(spark, sf_dir)).withColumn("slope", F.round("slope", 9))


CRESTS = f"""{RECORDS}, seg AS (SELECT *, sum(CASE WHEN before IS NULL OR slope > before THEN 1 ELSE 0 END) OVER (PARTITION BY ray ORDER BY step) AS segment FROM rec),
g AS (SELECT ray, segment, arg_min(slope, step) AS top, arg_min(crest_bin, step) AS crest_bin, min(slope) AS low, max(segment) OVER (PARTITION BY ray) AS last FROM seg GROUP BY ray, segment),
crests AS (SELECT ray, crest_bin, max(top) AS slope FROM g WHERE segment = last OR low < tan(atan(top) - 0.0015e0) GROUP BY ray, crest_bin)"""


@query(f"WITH RECURSIVE {CRESTS} SELECT ray, CAST(crest_bin AS INT) AS crest_bin, round(slope, 9) AS slope FROM crests")
def horizon_crests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge lines by gaps and islands."""
    return horizon.crests(march(spark, sf_dir)).withColumn("slope", F.round("slope", 9))


FRONTS = f"""{MARCH}, far AS (SELECT *, max(slope) OVER (PARTITION BY ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM march WHERE d >= 500),
up AS (SELECT *, lag(d) OVER (PARTITION BY ray ORDER BY step) AS prev FROM far WHERE before IS NULL OR slope > before),
f AS (SELECT *, sum(CASE WHEN prev IS NULL OR d - prev > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY ray ORDER BY step) AS front FROM up),
fronts AS (SELECT ray, front, min(d) AS from_m, max(d) AS to_m, min(slope) AS slope_start, max(slope) AS slope_max FROM f GROUP BY ray, front)"""


@query(f"WITH RECURSIVE {FRONTS} SELECT ray, CAST(front AS BIGINT) AS front, from_m, to_m, round(slope_start, 9) AS slope_start, round(slope_max, 9) AS slope_max FROM fronts")
def horizon_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts of rising visible ground."""
    f = horizon.fronts(march(spark, sf_dir))
    return f.select("ray", "front", "from_m", "to_m", F.round("slope_start", 9).alias("slope_start"), F.round("slope_max", 9).alias("slope_max"))


@query(f"""WITH RECURSIVE {MARCH}, top AS (SELECT *, atan(max(slope) OVER (PARTITION BY ray, layer ORDER BY step)) AS a FROM march),
cut AS (SELECT ray, min(step) AS cut FROM top WHERE d > 60000 AND slope < tan(a - 0.02e0) AND a < -0.005e0 GROUP BY ray),
kept AS (SELECT m.* FROM march m LEFT JOIN cut USING (ray) WHERE cut IS NULL OR step <= cut),
l AS (SELECT ray, layer, arg_max(d, (round(slope, 15), -d)) AS dist_m FROM kept GROUP BY ray, layer), h AS (SELECT ray, min(dist_m) AS horizon_m FROM l GROUP BY ray)
SELECT k.ray, round(atan(max(slope)), 9) AS angle, count(*) AS samples, any_value(horizon_m) AS horizon_m FROM kept k JOIN h USING (ray) GROUP BY k.ray""")
def horizon_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skyline and its distance, rays ending early."""
    kept = horizon.early_exit(march(spark, sf_dir))
    both = kept.groupBy("ray").agg(F.round(F.atan(F.max("slope")), 9).alias("angle"), F.count(F.lit(1)).alias("samples"))
    return both.join(horizon.horizon_distance(horizon.layers(kept)), "ray")


@query(f"""WITH RECURSIVE {LAYERS}, w AS (SELECT *, atan(slope) AS angle, CAST(least(8, greatest(0, floor(greatest(90e0, dist_m / 150) / 2 / dist_m / ({TURN} / 3600) + 0.5e0))) AS BIGINT) AS half FROM layered),
x AS (SELECT ray, layer, dist_m, unnest(range(-half, half + 1)) AS j FROM w)
SELECT x.ray, CAST(x.layer AS INT) AS layer, round(avg(n.angle), 9) AS angle FROM x JOIN w n ON n.layer = x.layer AND n.ray = (x.ray + x.j + 3600) % 3600 AND abs(n.dist_m - x.dist_m) / x.dist_m <= 0.5e0 GROUP BY x.ray, x.layer""")
def smoothed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers averaged over neighbouring rays of like distance."""
    return horizon.smooth(horizon.layers(march(spark, sf_dir)), RAYS).select("ray", "layer", F.round("angle", 9).alias("angle"))


VISIBLE = f"{CRESTS}, over AS (SELECT ray, crest_bin, atan(slope) AS angle, max(atan(slope)) OVER (PARTITION BY ray ORDER BY crest_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearer FROM crests), out AS (SELECT ray, crest_bin, angle FROM over WHERE nearer IS NULL OR angle > nearer + 5e-4)"


@query(f"WITH RECURSIVE {VISIBLE} SELECT ray, CAST(crest_bin AS INT) AS crest_bin, round(angle, 9) AS angle FROM out")
def visible_crests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crests that stand out over the nearer ones."""
    return horizon.visible_crests(horizon.crests(march(spark, sf_dir))).select("ray", "crest_bin", F.round("angle", 9).alias("angle"))


@query(f"""WITH RECURSIVE {LAYERS}, lines AS (SELECT ray, atan(max(slope)) AS angle FROM layered GROUP BY ray), {fx.PEAKS.replace('peaks AS', 'peaks_in AS')},
q AS (SELECT id, radians(id * 7 % 360 + 0.05e0) AS az FROM peaks_in), p AS (SELECT *, az / ({TURN} / 3600) AS place FROM q),
m AS (SELECT p.id, p.place - floor(p.place) AS share, a.angle AS a0, b.angle AS a1 FROM p LEFT JOIN lines a ON a.ray = CAST(floor(place) AS BIGINT) % 3600 LEFT JOIN lines b ON b.ray = (CAST(floor(place) AS BIGINT) + 1) % 3600),
s AS (SELECT list_sort(list(angle)) AS v FROM lines WHERE abs(CASE WHEN ray * ({TURN} / 3600) - 1 > pi() THEN ray * ({TURN} / 3600) - 1 - {TURN} ELSE ray * ({TURN} / 3600) - 1 END) <= 0.5e0)
SELECT id, round(coalesce(a0 + (a1 - a0) * share, a0, a1), 9) AS angle, round(CASE WHEN len(v) >= 10 THEN least(pi() / 4, greatest(0e0, v[len(v) // 2 + 1])) END, 9) AS tilt FROM m, s""")
def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silhouette between rays, and the tilt that a view of it asks for."""
    layered = horizon.layers(march(spark, sf_dir)).withColumn("angle", F.atan("slope"))
    line = horizon.silhouette(layered, layered)
    at = fx.peaks(spark, sf_dir).select("id", F.radians(F.col("id") * 7 % 360 + F.lit(0.05)).alias("az"))
    tilt = horizon.auto_tilt(line, 1.0, 1.0, RAYS)  # one row
    return horizon.angle_at(line, at, RAYS).select("id", F.round("angle", 9).alias("angle")).crossJoin(F.broadcast(tilt.select(F.round("tilt", 9).alias("tilt"))))


SEEN = f"""WITH RECURSIVE {LAYERS}, hor AS (SELECT ray, min(dist_m) AS horizon_m FROM layered GROUP BY ray), {fx.PEAKS}, {STEPS.format(name="near_st", start=100)},
pk AS (SELECT id, ele, dist_m, CASE WHEN a < 0 THEN a + {TURN} ELSE a END AS az FROM (SELECT *, {fx.haversine('43.35e0', '42.44e0', 'lat', 'lon')} AS dist_m,
  atan2(sin(radians(lon - 42.44e0)) * cos(radians(lat)), cos(radians(43.35e0)) * sin(radians(lat)) - sin(radians(43.35e0)) * cos(radians(lat)) * cos(radians(lon - 42.44e0))) AS a FROM peaks WHERE ele IS NOT NULL) WHERE dist_m BETWEEN 1 AND 200000),
pp AS (SELECT id, ele, dist_m, az, d, {PLACE} FROM pk LEFT JOIN near_st ON d < dist_m - 100),
{fx.sampled_sql("psam", "pp")},
li AS (SELECT id, any_value(ele) AS ele, any_value(dist_m) AS dist_m, any_value(az) AS az, max((h - {EYE}e0 - {DROP}) / d) AS line FROM psam GROUP BY id),
an AS (SELECT *, (ele - {EYE}e0 - dist_m * dist_m * ((1 - 0.13e0) / (2 * 6371000e0))) / dist_m AS own FROM li),
cl AS (SELECT *, atan(own) AS angle, CASE WHEN NOT coalesce(atan(line) - atan(own) > 0.0009e0, false) THEN 'visible' WHEN coalesce(dist_m < horizon_m, true) THEN 'onSlope'
  WHEN atan(line) - atan(own) <= 0.052e0 AND (line - own) * dist_m <= 400 THEN 'hidden' END AS visibility FROM an LEFT JOIN hor ON ray = CAST(floor(az / ({TURN} / 3600) + 0.5e0) AS BIGINT) % 3600),
shown AS (SELECT *, CASE WHEN visibility = 'hidden' THEN (line - own) * dist_m END AS deficit_m, ele * (1 + 0.4e0 * exp(-dist_m / 40000e0)) AS score FROM cl WHERE visibility IS NOT NULL)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peaks that are seen, with their scores, in no order: sorting would make them twice, to draw a sample first."""
    pyramid = fx.pyramid(spark, sf_dir)
    ring = horizon.horizon_distance(horizon.layers(march(spark, sf_dir)))
    rays = sampling.sample(horizon.peak_rays(fx.peaks(spark, sf_dir), LAT, LON), pyramid)
    shown = horizon.visibility(rays, EYE, ring, RAYS)
    return shown.withColumn("score", scores.label_score(F.col("ele"), F.col("dist_m"), F.lit(None).cast("double")))


@query(f"{SEEN} SELECT id, ele, round(dist_m, 3) AS dist_m, round(az, 9) AS az, round(angle, 9) AS angle, visibility, round(deficit_m, 3) AS deficit_m, round(score, 4) AS score FROM shown")
def peak_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which peaks are seen, stand on a slope, or are hidden by a little."""
    p = horizon.ranked(_seen(spark, sf_dir), F.col("score"))
    return p.select("id", "ele", F.round("dist_m", 3).alias("dist_m"), F.round("az", 9).alias("az"), F.round("angle", 9).alias("angle"), "visibility", F.round("deficit_m", 3).alias("deficit_m"), F.round("score", 4).alias("score"))


@query(f"""{SEEN}, n AS (SELECT *, row_number() OVER (PARTITION BY visibility ORDER BY score DESC, id) AS n FROM shown),
best AS (SELECT arg_max(id, (ele, -id)) AS main FROM shown WHERE visibility <> 'hidden' AND abs(CASE WHEN az - 1 > pi() THEN az - 1 - {TURN} ELSE az - 1 END) <= 0.5e0)
SELECT id, visibility, id = main AS is_main FROM n, best WHERE visibility <> 'hidden' OR n <= 4""")
def labels_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main peak of a view, and the hidden ones that may still be named."""
    p = _seen(spark, sf_dir)
    main = horizon.main_peak(p, 1.0, 1.0).withColumnRenamed("id", "main")  # one row
    rows = horizon.hidden_in_budget(p, 2).select("id", "visibility")
    return rows.crossJoin(F.broadcast(main)).select("id", "visibility", (F.col("id") == F.col("main")).alias("is_main"))


DETAIL = "greatest(90e0, d / 150)"


@query(f"""WITH {fx.PEAKS}, {fx.RASTER}, {fx.PIXELS}, d0 AS (SELECT id, lat, lon, {fx.haversine('43.35e0', '42.44e0', 'lat', 'lon')} AS d FROM peaks),
pts AS (SELECT *, CASE WHEN d < 2000 THEN 7 WHEN d < 10000 THEN 6 WHEN d < 40000 THEN 5 ELSE 4 END AS zoom FROM d0), {fx.sampled_sql("sampled", "pts")},
px AS (SELECT *, (lon + 180) / 360 * pow(2, zoom) * 256 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, zoom) * 256 AS y FROM sampled),
pc AS (SELECT p.*, a.h AS a, coalesce(b.h, a.h) AS b, coalesce(c.h, a.h) AS c, coalesce(e.h, a.h) AS e FROM px p LEFT JOIN pixels a ON a.z = zoom AND a.gx = CAST(floor(x) AS BIGINT) AND a.gy = CAST(floor(y) AS BIGINT)
  LEFT JOIN pixels b ON b.z = zoom AND b.gx = CAST(floor(x) AS BIGINT) + 1 AND b.gy = CAST(floor(y) AS BIGINT) LEFT JOIN pixels c ON c.z = zoom AND c.gx = CAST(floor(x) AS BIGINT) AND c.gy = CAST(floor(y) AS BIGINT) + 1
  LEFT JOIN pixels e ON e.z = zoom AND e.gx = CAST(floor(x) AS BIGINT) + 1 AND e.gy = CAST(floor(y) AS BIGINT) + 1),
s AS (SELECT *, a + (b - a) * (x - floor(x)) + (c + (e - c) * (x - floor(x)) - (a + (b - a) * (x - floor(x)))) * (y - floor(y)) AS slippy, coalesce(h1, h2) AS coarse FROM pc),
r AS (SELECT id, max(h) AS top FROM d0 JOIN raster ON gx BETWEEN CAST(floor((lon - 40.4371e0) * 64) AS BIGINT) - 1 AND CAST(floor((lon - 40.4371e0) * 64) AS BIGINT) + 1 AND gy BETWEEN CAST(floor((45.3529e0 - lat) * 64) AS BIGINT) - 1 AND CAST(floor((45.3529e0 - lat) * 64) AS BIGINT) + 1 GROUP BY id)
SELECT s.id, round(h, 6) AS h, round(slippy, 6) AS slippy, round(CASE WHEN d < 30000 THEN coalesce(h0, slippy, coarse) ELSE coalesce(h0, coarse, slippy) END, 6) AS chained, zoom,
  CAST(CASE WHEN abs(ln(111320 / 64e0 / {DETAIL})) <= abs(ln(111320 / 16e0 / {DETAIL})) THEN 0 WHEN abs(ln(111320 / 16e0 / {DETAIL})) <= abs(ln(111320 / 4e0 / {DETAIL})) THEN 1 ELSE 2 END AS INT) AS level, CAST(top AS DOUBLE) AS ground FROM s LEFT JOIN r USING (id)""")
def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights at points out of levels and sources that stand in for each other."""
    pyramid = fx.pyramid(spark, sf_dir)
    fine = fx.pyramid(spark, sf_dir, (1,))
    coarse = fx.pyramid(spark, sf_dir, (4, 16))
    d = geo.distance_m(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))
    points = fx.peaks(spark, sf_dir).select("id", "lat", "lon", d.alias("d")).withColumn("zoom", sampling.zoom_for_distance(F.col("d")) - fx.ZOOM_SHIFT)
    heights = fx.pixels(spark, sf_dir).select("z", "gx", "gy", sampling.terrarium_height(F.col("r"), F.col("g"), F.col("b")).alias("h"))
    rows = sampling.sample(points, pyramid)
    rows = sampling.sample_slippy(rows, heights, "zoom", "slippy")
    rows = sampling.sample_sources(rows, fine, coarse, heights, "zoom", "d", "chained")
    nearest = fx.pyramid(spark, sf_dir, (1,))
    rows = sampling.observer_height(rows.withColumn("level", sampling.level_for_distance(F.col("d"), pyramid)), nearest)
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("h", "slippy", "chained")], "zoom", "level", "ground")


@query(f"""WITH {fx.PEAKS}, {fx.RASTER}, tiles AS (SELECT DISTINCT gx // 16 AS tx, gy // 16 AS ty FROM raster WHERE h > 5990), wide AS (SELECT DISTINCT gx // 16 AS tx, gy // 16 AS ty FROM raster4 WHERE h > 4200),
p AS (SELECT id, CAST(floor((lon - 40.4371e0) * 64 / 16) AS BIGINT) AS tx, CAST(floor((45.3529e0 - lat) * 64 / 16) AS BIGINT) AS ty, CAST(floor((lon - 40.4371e0) * 16 / 16) AS BIGINT) AS wx, CAST(floor((45.3529e0 - lat) * 16 / 16) AS BIGINT) AS wy FROM peaks),
bytes AS (SELECT (ty * 16 + tx) // 8 AS byte, bit_or(CAST(1 AS INT) << CAST((ty * 16 + tx) % 8 AS INT)) AS bits FROM tiles GROUP BY 1),
packed AS (SELECT to_base64(unhex(string_agg(lpad(printf('%X', coalesce(bits, 0)), 2, '0'), '' ORDER BY i))) AS coverage FROM range(32) r(i) LEFT JOIN bytes ON byte = i)
SELECT id, (tx, ty) IN (SELECT (tx, ty) FROM tiles) AS there, (tx, ty) IN (SELECT (tx, ty) FROM tiles) OR (wx, wy) IN (SELECT (tx, ty) FROM wide) AS covered, coverage, 111320 / 64e0 / (id % 40 + 1) <= 120 AS fine FROM p, packed""")
def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tiles there are, as a bit map and back."""
    whole = fx.pyramid(spark, sf_dir, (1, 4))
    a, b = whole.levels
    high = sampling.Pyramid(whole.min_lon, whole.max_lat, whole.max_lon, whole.min_lat, (sampling.Level(a.cells.filter("h > 5990"), a.cell_deg, a.width, a.height), sampling.Level(b.cells.filter("h > 4200"), b.cell_deg, b.width, b.height)))
    packed = sampling.packed_bits(sampling.coverage_bits(sampling.coverage(high.levels[0].cells, 16), 16), 32)  # one row
    rows = sampling.any_coverage(fx.peaks(spark, sf_dir).select("id", "lat", "lon"), high, 16).crossJoin(F.broadcast(packed))
    tx, ty = F.floor((F.col("lon") - whole.min_lon) / a.cell_deg / 16), F.floor((whole.max_lat - F.col("lat")) / a.cell_deg / 16)
    fine = sampling.is_fine(F.lit(geo.DEGREE_M * a.cell_deg) / (F.col("id") % 40 + 1))
    return rows.select("id", sampling.has_tile(F.col("coverage"), 16, 16, tx, ty).alias("there"), "covered", "coverage", fine.alias("fine"))


@query(f"""{SEEN}, far AS (SELECT *, max(slope) OVER (PARTITION BY ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM march WHERE d >= 500),
up AS (SELECT *, lag(d) OVER (PARTITION BY ray ORDER BY step) AS prev FROM far WHERE before IS NULL OR slope > before), f AS (SELECT *, sum(CASE WHEN prev IS NULL OR d - prev > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY ray ORDER BY step) AS front FROM up),
fronts AS (SELECT ray, front, min(d) AS from_m, max(d) AS to_m, atan(max(slope)) AS top FROM f GROUP BY ray, front), lines AS (SELECT ray, atan(max(slope)) AS angle FROM layered GROUP BY ray),
w AS (SELECT *, greatest(0.009e0, least(0.052e0, atan2(1500e0, dist_m))) AS win, greatest(2000e0, dist_m * 0.15e0) AS tol, CAST(floor(az / ({TURN} / 3600) + 0.5e0) AS BIGINT) AS mid FROM shown),
x AS (SELECT *, unnest(range(greatest(0, mid - CAST(ceil(win / ({TURN} / 3600)) AS BIGINT)), least(3599, mid + CAST(ceil(win / ({TURN} / 3600)) AS BIGINT)) + 1)) AS r FROM w WHERE visibility <> 'hidden'),
m AS (SELECT x.id, f.ray, f.front, f.top, round(-(greatest(0, from_m - dist_m, dist_m - to_m) / tol) * 0.4e0 - abs((r * ({TURN} / 3600) - az) - {TURN} * ceil(((r * ({TURN} / 3600) - az) - pi()) / {TURN})) / win * 0.3e0 + top / 0.3e0 * 0.3e0, 12) AS score
  FROM x JOIN fronts f ON f.ray = x.r WHERE greatest(0, from_m - dist_m, dist_m - to_m) <= tol), b AS (SELECT id, arg_max(ray, (score, -ray, -front)) AS ray, arg_max(top, (score, -ray, -front)) AS top FROM m GROUP BY id),
p AS (SELECT id, az / ({TURN} / 3600) AS place FROM shown), li2 AS (SELECT p.id, coalesce(a.angle + (c.angle - a.angle) * (place - floor(place)), a.angle, c.angle) AS edge FROM p LEFT JOIN lines a ON a.ray = CAST(floor(place) AS BIGINT) % 3600 LEFT JOIN lines c ON c.ray = (CAST(floor(place) AS BIGINT) + 1) % 3600)
SELECT s.id, round(CASE WHEN visibility = 'hidden' OR b.ray IS NULL THEN az ELSE b.ray * ({TURN} / 3600) END, 9) AS marker_az, round(CASE WHEN visibility = 'hidden' THEN angle ELSE coalesce(top, edge) END, 9) AS marker_angle FROM shown s LEFT JOIN b USING (id) JOIN li2 USING (id)""")
def peak_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where peaks are marked on the fronts."""
    marched = march(spark, sf_dir)
    line = horizon.silhouette(horizon.layers(marched).withColumn("angle", F.atan("slope")))
    found = horizon.markers(_seen(spark, sf_dir), horizon.fronts(marched), line, RAYS)
    return found.select("id", F.round("marker_az", 9).alias("marker_az"), F.round("marker_angle", 9).alias("marker_angle"))


VIEW_AT = "asin(sin(radians(lat)) * cos(6000 / 6371000e0) + cos(radians(lat)) * sin(6000 / 6371000e0) * cos(az))"


@query(f"""WITH RECURSIVE {STEPS.format(name="vst", start=100)}, {fx.RASTER}, {fx.PEAKS}, v0 AS (SELECT id, ele, lat, lon, CAST(v AS INT) AS view, v * {TURN} / 12 AS az FROM peaks, range(12) r(v) WHERE ele IS NOT NULL),
v1 AS (SELECT id, ele, lat AS top_lat, lon AS top_lon, view, degrees({VIEW_AT}) AS lat, degrees(radians(lon) + atan2(sin(az) * sin(6000 / 6371000e0) * cos(radians(lat)), cos(6000 / 6371000e0) - sin(radians(lat)) * sin({VIEW_AT}))) AS lon FROM v0),
v2 AS (SELECT *, {fx.haversine('lat', 'lon', 'top_lat', 'top_lon')} AS dist_m, atan2(sin(radians(top_lon - lon)) * cos(radians(top_lat)), cos(radians(lat)) * sin(radians(top_lat)) - sin(radians(lat)) * cos(radians(top_lat)) * cos(radians(top_lon - lon))) AS a FROM v1),
v3 AS (SELECT *, CASE WHEN a < 0 THEN a + {TURN} ELSE a END AS az FROM v2), g AS (SELECT id, view, max(h) AS ground FROM v3 JOIN raster16 ON gx BETWEEN CAST(floor((lon - 40.4371e0) * 4) AS BIGINT) - 1 AND CAST(floor((lon - 40.4371e0) * 4) AS BIGINT) + 1 AND gy BETWEEN CAST(floor((45.3529e0 - lat) * 4) AS BIGINT) - 1 AND CAST(floor((45.3529e0 - lat) * 4) AS BIGINT) + 1 GROUP BY 1, 2),
w AS (SELECT id, view, d, lat AS o_lat, lon AS o_lon, az FROM v3 JOIN vst ON d < dist_m - 100),
w2 AS (SELECT id, view, d, degrees(asin(sin(radians(o_lat)) * cos(d / 6371000e0) + cos(radians(o_lat)) * sin(d / 6371000e0) * cos(az))) AS lat,
  degrees(radians(o_lon) + atan2(sin(az) * sin(d / 6371000e0) * cos(radians(o_lat)), cos(d / 6371000e0) - sin(radians(o_lat)) * (sin(radians(o_lat)) * cos(d / 6371000e0) + cos(radians(o_lat)) * sin(d / 6371000e0) * cos(az)))) AS lon FROM w),
{fx.sampled_sql("ws", "w2")}, l AS (SELECT ws.id, ws.view, max((h2 - ground - 1.7e0 - {DROP}) / d) AS line FROM ws JOIN g USING (id, view) GROUP BY 1, 2),
c AS (SELECT v3.*, ground, coalesce(atan(line) - atan((ele - ground - 1.7e0 - dist_m * dist_m * ((1 - 0.13e0) / (2 * 6371000e0))) / dist_m) > 0.0009e0, false) AS unseen FROM v3 JOIN g USING (id, view) LEFT JOIN l USING (id, view)),
b AS (SELECT id, min({{'unseen': unseen, 'ground': round(ground, 6), 'view': view, 'lat': lat, 'lon': lon, 'az': az}}) AS b FROM c GROUP BY id)
SELECT v.id, b.b.view AS view, round(coalesce(b.b.lat, top_lat), 6) AS lat, round(coalesce(b.b.lon, top_lon), 6) AS lon, round(sin(coalesce(b.b.az, 0)), 6) + 0e0 AS east, round(cos(coalesce(b.b.az, 0)), 6) + 0e0 AS north, NOT b.b.unseen AS sees FROM (SELECT DISTINCT id, top_lat, top_lon FROM v3) v LEFT JOIN b USING (id)""")
def viewpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where to look at a summit."""
    coarse = fx.pyramid(spark, sf_dir, (16,))
    views = horizon.around(fx.peaks(spark, sf_dir).filter("ele IS NOT NULL"), 6000.0)
    key = F.concat_ws("/", F.col("id"), F.col("view"))
    ground = sampling.observer_height(views.select(key.alias("id"), "lat", "lon"), coarse).select(F.col("id").alias("place"), "ground")
    views = views.join(ground, key == F.col("place"), "left").drop("place")
    steps = horizon.steps_table(spark, 100.0, 6100.0).select("d")
    way = views.join(F.broadcast(steps), F.col("d") < F.col("dist_m") - horizon.PEAK_MARGIN_M)
    to = geo.destination(F.col("lat"), F.col("lon"), F.col("az"), F.col("d"))
    samples = sampling.sample(way.select("id", "view", "d", to[0].alias("lat"), to[1].alias("lon")), coarse)
    found = horizon.viewpoints(views, samples)
    return found.select("id", "view", *[F.round(c, 6).alias(c) for c in ("lat", "lon")], (F.round(F.sin("az"), 6) + 0.0).alias("east"), (F.round(F.cos("az"), 6) + 0.0).alias("north"), "sees")


@query(f"""WITH RECURSIVE pst(step, d) AS (SELECT CAST(0 AS INT), 150e0 UNION ALL SELECT step + 1, d + CASE WHEN d < 5000 THEN 90 ELSE 180 END FROM pst WHERE d + CASE WHEN d < 5000 THEN 90 ELSE 180 END <= 12000), {fx.RASTER},
pr AS (SELECT ray, step, d, ray * ({TURN} / 720) AS az FROM range(720) r(ray), pst), pts AS (SELECT ray, d, {PLACE} FROM pr), {fx.sampled_sql("sampled", "pts")}
SELECT ray, round(atan(max((h - {EYE}e0 - {DROP}) / d)), 9) AS angle, count(*) AS samples FROM sampled WHERE h IS NOT NULL GROUP BY ray""")
def preview_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST14: the skyline of a first look."""
    seen = horizon.seen(sampling.sample(horizon.preview(spark, LAT, LON), fx.pyramid(spark, sf_dir)), EYE)
    return seen.groupBy("ray").agg(F.round(F.atan(F.max("slope")), 9).alias("angle"), F.count(F.lit(1)).alias("samples"))
