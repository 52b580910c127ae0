"""Skylines, tiles, maps and pyramid plans over the supplied tables, each query with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.operators import codecs, mapview, panorama_labels, planning, skyline, tiles
from vistaspark.plans import fixtures as fx
from vistaspark.plans.registry import query

TURN = repr(2 * math.pi)
PROFILES = "profiles AS (SELECT vec_id // 10 AS session, vec_id AS frame, CAST(col AS INT) AS col, CAST(embedding[col + 1] AS DOUBLE) AS y FROM embeddings, range(64) r(col) WHERE (vec_id + col) % 7 <> 0)"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("session"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("col", "y"))
    return rows.filter((F.col("frame") + F.col("col")) % 7 != 0).withColumn("y", F.col("y").cast("double"))


@query(f"""WITH {PROFILES}, c AS (SELECT session, col, list_sort(list(y)) AS ys FROM profiles GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (SELECT *, ys[len(ys) // 2 + 1] AS med FROM c), v AS (SELECT *, list_avg(list_transform(ys, lambda y: (y - med) * (y - med))) AS var FROM m)
SELECT session, col, CASE WHEN sqrt(var) <= 0.12e0 THEN round(med, 6) END AS y, round(var, 6) AS variance FROM v""")
def stabilised_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, ST7: profiles of a session's frames as one."""
    s = skyline.stabilised(_profiles(spark, sf_dir), 0.12)
    return s.select("session", "col", F.round("y", 6).alias("y"), F.round("variance", 6).alias("variance"))


@query(f"""WITH {PROFILES}, ref AS (SELECT frame + 1 AS frame, col, y FROM profiles), e AS (SELECT a.frame, s.s AS shift, avg((a.y - r.y) * (a.y - r.y)) AS err, count(*) AS n
  FROM range(-6, 7) s(s) JOIN profiles a ON true JOIN ref r ON r.frame = a.frame AND r.col = a.col - s.s GROUP BY 1, 2),
b AS (SELECT frame, arg_min(shift, (round(err, 12), shift)) AS shift, min(err) AS err FROM e WHERE n >= 20 GROUP BY frame)
SELECT f.frame, CAST(coalesce(shift, 0) AS INT) AS shift, round(err, 6) AS error FROM (SELECT DISTINCT frame FROM profiles) f LEFT JOIN b USING (frame)""")
def frame_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of each frame against the one before."""
    p = _profiles(spark, sf_dir)
    found = skyline.best_shift(p, p.withColumn("frame", F.col("frame") + 1))
    return found.select("frame", "shift", F.round("error", 6).alias("error"))


RING = """t AS (SELECT CAST(i AS BIGINT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS c FROM embeddings, range(16) r(i) WHERE vec_id = 0),
h AS (SELECT vec_id AS frame, CAST(j AS BIGINT) AS j, CAST(embedding[j + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(j)),
s AS (SELECT frame, p.s, round(corr(c, v), 9) AS score FROM range(64) p(s), t JOIN h ON h.j = (t.i + p.s) % 64 GROUP BY frame, p.s)"""


@query(f"""WITH RECURSIVE {RING}, lists AS (SELECT frame, list_sort(list({{'score': -score, 's': s}})) AS rest FROM s WHERE score > 0 GROUP BY frame),
picks AS (SELECT frame, 1 AS k, rest[1].s AS s, -rest[1].score AS score, list_filter(rest, lambda x: least((x.s - rest[1].s + 64) % 64, (rest[1].s - x.s + 64) % 64) > 1) AS rest FROM lists
  UNION ALL SELECT frame, k + 1, rest[1].s, -rest[1].score, list_filter(rest, lambda x: least((x.s - rest[1].s + 64) % 64, (rest[1].s - x.s + 64) % 64) > 1) FROM picks WHERE k < 5 AND len(rest) > 0),
tops AS (SELECT frame, max(score) FILTER (k = 1) AS first, max(score) FILTER (k = 2) AS second, max(CASE WHEN k = 1 THEN radians(frame * 11 % 360) END) AS hint FROM picks GROUP BY frame),
c AS (SELECT p.*, first, second, s * ({TURN}::DOUBLE / 64) + {TURN}::DOUBLE / 8 - hint AS off FROM picks p JOIN tops USING (frame)),
w AS (SELECT *, CASE WHEN abs(off - {TURN}::DOUBLE * round(off / {TURN}::DOUBLE)) < radians(20) THEN score + first * 0.08e0 ELSE score END AS total FROM c)
SELECT frame, CAST(s AS INT) AS place, round(total, 4) AS score, round(CASE WHEN second IS NULL THEN 2e0 ELSE first / second END, 4) AS uniqueness, CAST(row_number() OVER (PARTITION BY frame ORDER BY total DESC, k) AS INT) AS rank FROM w""")
def ring_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five places on its ring where a frame correlates best, apart from each other, and how unique the best is."""
    e = fx.table(spark, sf_dir, "embeddings")
    template = e.filter("vec_id = 0").select(F.slice("embedding", 1, 16).alias("ys"))  # one row
    frames = e.select(F.col("vec_id").alias("frame"), F.col("embedding").alias("ring"), F.radians((F.col("vec_id") * 11 % 360).cast("double")).alias("hint")).crossJoin(F.broadcast(template))
    found = skyline.hypotheses(frames, 16 * 2 * math.pi / 64, least=-1.0)
    return found.select("frame", "place", F.round("score", 4).alias("score"), F.round("uniqueness", 4).alias("uniqueness"), "rank")


@query(f"""WITH {PROFILES}, ring AS (SELECT frame + 1 AS frame, col AS ray, y AS angle FROM profiles), sh AS (SELECT s AS shift, t / 10e0 AS tilt FROM range(-8, 9) a(s), range(-2, 3) b(t)),
n AS (SELECT frame, count(*) AS n FROM profiles GROUP BY frame), e AS (SELECT o.frame, shift, tilt, list_sort(list(abs(o.y + tilt - r.angle))) AS v FROM sh, profiles o JOIN ring r ON r.frame = o.frame AND r.ray = (o.col + shift + 64) % 64 GROUP BY 1, 2, 3)
SELECT frame, CAST(shift AS INT) AS shift, tilt, CASE WHEN len(v) >= greatest(8, round(n * 0.5)) THEN round(v[len(v) // 2 + 1], 6) END AS residual FROM e JOIN n USING (frame)""")
def skyline_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every frame the median differences to the frame before, over a grid of shifts and tilts."""
    p = _profiles(spark, sf_dir)
    rings = p.select((F.col("frame") + 1).alias("frame"), F.col("col").alias("ray"), F.col("y").alias("angle"))
    shifts = spark.range(-8, 9).select(F.col("id").cast("int").alias("shift"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("t")).select("shift", (F.col("t") / 10).alias("tilt"))
    return skyline.residuals(p.select("frame", "col", "y"), rings, 64, shifts).withColumn("residual", F.round("residual", 6))


@query(f"""WITH {PROFILES}, {fx.PEAKS}, g AS (SELECT frame, count(*) AS n, stddev_pop(y) AS sd FROM profiles GROUP BY frame), f AS (SELECT frame, radians(frame * 37 % 360) - CASE WHEN radians(frame * 37 % 360) > pi() THEN {TURN} ELSE 0 END AS centre, frame // 10 % 50 AS place FROM g),
pk AS (SELECT DISTINCT id % 50 AS place, radians(id * 29 % 360) AS az, (id % 13 - 6) / 30e0 AS elevation FROM peaks), w AS (SELECT *, az - centre AS d FROM f JOIN pk USING (place)), x AS (SELECT *, d - {TURN} * ceil((d - pi()) / {TURN}) AS off FROM w),
i AS (SELECT frame, az, elevation, CAST(floor((off + 0.6e0) / 1.2e0 * 64 + 0.5e0) AS BIGINT) AS mid FROM x WHERE abs(off) < 0.6e0), tp AS (SELECT i.frame, az, elevation, max(y) AS top FROM i LEFT JOIN profiles p ON p.frame = i.frame AND p.col IN ((mid - 1 + 64) % 64, mid % 64, (mid + 1) % 64) GROUP BY 1, 2, 3),
a AS (SELECT frame, count(*) AS n, avg(CASE WHEN abs(top - elevation) < {math.radians(0.5)!r} THEN 1e0 ELSE 0e0 END) AS share FROM tp GROUP BY frame)
SELECT g.frame, g.n >= 64 * 0.4e0 AND sd >= 0.005e0 AS telling, round(CASE WHEN a.n >= 2 THEN share ELSE -1 END, 6) AS anchors FROM g LEFT JOIN a USING (frame)""")
def frame_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose profile tells something, and the peaks that stand where it has its tops."""
    p = _profiles(spark, sf_dir)
    frames = p.groupBy("frame").agg(F.collect_list("y").alias("ys"))
    told = frames.select("frame", skyline.is_telling(F.col("ys"), 64).alias("telling"))
    az = F.radians((F.col("frame") * 37 % 360).cast("double"))
    centres = told.select("frame", (F.floor(F.col("frame") / 10) % 50).alias("place"), F.when(az > math.pi, az - 2 * math.pi).otherwise(az).alias("centre"))
    k = F.col("id")
    peaks = fx.peaks(spark, sf_dir).select((k % 50).alias("place"), F.radians((k * 29 % 360).cast("double")).alias("az"), ((k % 13 - 6) / F.lit(30.0)).alias("elevation")).distinct()
    found = skyline.anchor_scores(centres, p, peaks, 64, 1.2)
    return told.join(found, "frame").select("frame", "telling", F.round("anchors", 6).alias("anchors"))


BOX_TILES = f"{fx.REGIONS}, b AS (SELECT *, (min_lat + max_lat) / 2 AS mid_lat, CASE WHEN max_lon < min_lon THEN -180e0 ELSE (min_lon + max_lon) / 2 END AS mid_lon, ord * 100 AS h FROM regions)"


@query(f"""WITH {BOX_TILES}, d AS (SELECT *, {fx.haversine('43.35e0', '42.44e0', 'mid_lat', 'mid_lon')} AS away, CASE WHEN abs(max_lon - min_lon) > 180 THEN 360 - abs(max_lon - min_lon) ELSE abs(max_lon - min_lon) END * 111320e0 * cos(radians(mid_lat)) AS wide,
  atan2(sin(radians(mid_lon - 42.44e0)) * cos(radians(mid_lat)), cos(radians(43.35e0)) * sin(radians(mid_lat)) - sin(radians(43.35e0)) * cos(radians(mid_lat)) * cos(radians(mid_lon - 42.44e0))) AS a FROM b),
r AS (SELECT *, sqrt(wide * wide + pow((max_lat - min_lat) * 111320e0, 2)) / 2 AS rad, CASE WHEN a < 0 THEN a + {TURN} ELSE a END AS az FROM d), k AS (SELECT *, atan2(rad, away) + {TURN} / 72 AS half FROM r WHERE away + rad >= 20000),
s AS (SELECT h, away <= rad AS near, CAST(floor((az - half) / ({TURN} / 72)) AS BIGINT) AS s0, CAST(ceil((az + half) / ({TURN} / 72)) - 1 AS BIGINT) AS s1 FROM k),
x AS (SELECT h, unnest(CASE WHEN near OR s1 - s0 + 1 >= 72 THEN range(72) ELSE range(s0, s1 + 1) END) AS s FROM s)
SELECT i AS sector, coalesce(max(h), 0) AS h FROM range(72) q(i) LEFT JOIN x ON (x.s + 144) % 72 = i GROUP BY i""")
def sector_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest tile that reaches into each sector."""
    return skyline.sector_bounds(fx.regions(spark, sf_dir).withColumn("h", (F.col("ord") * 100).cast("long")), 43.35, 42.44, 72)


@query(f"""WITH {fx.RASTER}, q AS (SELECT tx, ty, x, y, CAST(round_even(coalesce(h, 0) / 4e0, 0) AS INT) AS q FROM (SELECT DISTINCT gx // 16 AS tx, gy // 16 AS ty FROM raster4), range(16) a(x), range(16) b(y) LEFT JOIN raster4 ON gx = tx * 16 + x AND gy = ty * 16 + y),
t AS (SELECT gx // 16 AS tx, gy // 16 AS ty, max(h) AS top FROM raster4 GROUP BY 1, 2) SELECT tx * 16 + x AS gx, ty * 16 + y AS gy, q, q * 4e0 AS h, top FROM q JOIN t USING (tx, ty)""")
def tile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.13, A19, F8, F16, M10, W14: tiles coded to bytes and back."""
    cells = fx.level(spark, sf_dir, 4).cells
    whole = tiles.tiles_of(cells, 16).withColumn("heights", F.transform("heights", lambda h: F.when(F.isnan(h), 0.0).otherwise(h)))
    back = tiles.decode_tiles(tiles.encode_tiles(whole, 16, 4.0), 16, 4.0)
    tops = tiles.tile_tops(cells.withColumn("h", tiles.valid_height(F.col("h"))), 16)
    rows = back.withColumn("tx", F.floor(F.col("gx") / 16)).withColumn("ty", F.floor(F.col("gy") / 16)).join(tops, ["tx", "ty"])
    return rows.select("gx", "gy", "q", "h", "top")


@query(f"WITH {fx.RASTER} SELECT a.gx, a.gy, round(avg(b.h), 6) AS mean FROM raster4 a JOIN raster4 b ON b.gx BETWEEN a.gx - 1 AND a.gx + 1 AND b.gy BETWEEN a.gy - 1 AND a.gy + 1 GROUP BY 1, 2")
def box_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over three by three cells."""
    return planning.box_mean(fx.level(spark, sf_dir, 4).cells).withColumn("mean", F.round("mean", 6))


Y = "(0.5e0 - ln((1 + sin(radians({v}))) / (1 - sin(radians({v})))) / (4 * pi())) * 131072"


@query(f"""WITH {fx.PEAKS}, p AS (SELECT id, ele, (lon - 42.44e0) / 360 * 131072 + 400 AS x, {Y.format(v='lat')} - {Y.format(v='43.35e0')} + 300 AS y FROM peaks), s AS (SELECT * FROM p WHERE x BETWEEN -80 AND 880 AND y BETWEEN -80 AND 680)
SELECT id, ele, round(x, 4) AS x, round(y, 4) AS y, true AS in_frame, abs((id * 7 % 360) * {TURN} / 360 - {TURN} * ceil(((id * 7 % 360) * {TURN} / 360 - pi()) / {TURN})) / 1.2e0 * 800 <= 400 + 420 AS label_near FROM s""")
def map_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peaks in the frame of a map, and whose labels can reach into that of a panorama."""
    rows = mapview.on_screen(fx.peaks(spark, sf_dir).withColumn("in_frame", mapview.in_viewport(43.35, 42.44, 9, 800, 600)), 43.35, 42.44, 9, 800, 600)
    az = F.radians((F.col("id") * 7 % 360).cast("double"))
    return rows.select("id", "ele", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "in_frame", mapview.azimuth_near_view(az, 0.0, 1.2, 800.0, 20.0).alias("label_near"))


@query("""WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(event_id * 7 - 900 AS VARCHAR) END AS a, CASE event_id % 4 WHEN 0 THEN 'NaN' ELSE CAST(event_id % 50 - 25 AS VARCHAR) END AS t, CASE event_id % 3 WHEN 0 THEN NULL ELSE CAST(event_id % 150 AS VARCHAR) END AS f, CASE event_id % 2 WHEN 0 THEN 'false' END AS o FROM events)
SELECT event_id, coalesce(((try_cast(a AS DOUBLE) + 180) - 360 * floor((try_cast(a AS DOUBLE) + 180) / 360)) - 180, 0) AS azimuth_deg, CASE WHEN event_id % 4 = 0 THEN 0 ELSE least(15e0, greatest(-15e0, CAST(t AS DOUBLE))) END AS tilt_deg,
  CASE WHEN f IS NOT NULL THEN least(100e0, greatest(20e0, CAST(f AS DOUBLE))) END AS fov_deg, o IS DISTINCT FROM 'false' AS auto_calibrate FROM c""")
def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stored corrections brought into range."""
    k = F.col("event_id")
    raw = fx.table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 5 == 1, "x").when(k % 5 > 1, (k * 7 - 900).cast("string")).alias("azimuth"), F.when(k % 4 == 0, "NaN").otherwise((k % 50 - 25).cast("string")).alias("tilt"),
        F.when(k % 3 != 0, (k % 150).cast("string")).alias("fov"), F.when(k % 2 == 0, "false").alias("auto"),
    )
    return mapview.calibration(raw).select("event_id", "azimuth_deg", "tilt_deg", "fov_deg", "auto_calibrate")


@query("""WITH c AS (SELECT CAST(o_custkey % 3 AS INT) AS lod, CAST(1 + o_custkey % 4 AS INT) AS priority, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders)
SELECT lod, priority, count(*) AS cells, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY ROLLUP (lod, priority)""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build writes, by level and priority."""
    k = F.col("o_custkey")
    cells = fx.table(spark, sf_dir, "orders").select((k % 3).cast("int").alias("lod"), (1 + k % 4).cast("int").alias("priority"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return mapview.report(cells)


@query("SELECT event_type AS phase, count(*) AS n, round(sum(value), 4) AS total, max(value) AS longest FROM events GROUP BY event_type")
def phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times by phase."""
    return mapview.phases(fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("ms"))).withColumn("total", F.round("total", 4))


JOB_CELLS = "cells AS (SELECT DISTINCT CAST(40 + o_custkey // 8 % 9 AS INT) AS lat, CAST(38 + o_custkey % 8 AS INT) AS lon FROM orders)"


@query(f"""WITH {JOB_CELLS}, small AS (SELECT CAST((lon + 180) * 2 + i AS BIGINT) AS tx, CAST((90 - lat - 1) * 2 + j AS BIGINT) AS ty FROM cells, range(2) a(i), range(2) b(j)),
want AS (SELECT DISTINCT CAST(floor((lon + 180) / 4e0) AS BIGINT) AS tx, CAST(floor((90 - lat - 1e-9) / 4e0) AS BIGINT) AS ty FROM cells),
large AS (SELECT tx, ty, count(*) AS sources FROM want JOIN cells ON lat BETWEEN floor(90 - ty * 4 - 255 / 64e0) AND floor(90 - ty * 4) AND lon BETWEEN floor(-180 + tx * 4) AND floor(-180 + tx * 4 + 255 / 64e0) GROUP BY 1, 2)
SELECT CAST(512 AS INT) AS n, tx, ty, count(*) AS sources FROM small GROUP BY tx, ty UNION ALL SELECT CAST(64 AS INT), tx, ty, sources FROM large""")
def pyramid_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a fine and of a coarse level with their source cells; the levels come out of their text."""
    k = F.col("o_custkey")
    cells = fx.table(spark, sf_dir, "orders").select((40 + F.floor(k / 8) % 9).cast("int").alias("lat"), (38 + k % 8).cast("int").alias("lon")).distinct()
    levels = spark.range(1).select(F.explode(planning.levels_of(F.lit("512:2:600:0.5,64:8:0:-"))).alias("x")).select("x.cells_per_deg").collect()  # two levels
    out = None
    for r in levels:
        n = r["cells_per_deg"]
        rows = planning.jobs(cells, n).select(F.lit(n).alias("n"), "tx", "ty", "sources")
        out = rows if out is None else out.union(rows)
    return out


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS rank, s_suppkey * 37 % 900 + 100 AS bytes FROM supplier), n AS (SELECT count(*) AS n FROM r), pick AS (SELECT rank AS r0, bytes AS b0, lead(rank) OVER (ORDER BY rank) AS r1, lead(bytes) OVER (ORDER BY rank) AS b1 FROM r WHERE rank % 7 = 0),
z AS (SELECT rank, CASE WHEN r1 IS NULL THEN b0 ELSE b0 + (b1 - b0) * (rank - r0) / (r1 - r0) END AS size FROM r JOIN pick ON rank >= r0 AND (r1 IS NULL OR rank < r1)), u AS (SELECT sum(size) OVER (ORDER BY rank) AS used FROM z)
SELECT count(*) FILTER (used < 5000) AS fit, round(coalesce(max(used) FILTER (used < 5000), 0), 6) AS bytes FROM u""")
def build_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs fit into a budget, by sizes between a few measured ones."""
    from pyspark.sql import Window

    r = fx.table(spark, sf_dir, "supplier").select((F.row_number().over(Window.orderBy("s_suppkey")) - 1).alias("rank"), (F.col("s_suppkey") * 37 % 900 + 100).alias("bytes"))
    found = planning.estimate(r.select("rank"), r.filter("rank % 7 = 0"), 5000.0)
    return found.select("fit", F.round("bytes", 6).alias("bytes"))


TILES_THERE = "there AS (SELECT DISTINCT gx // 16 AS tx, gy // 16 AS ty FROM raster)"


@query(f"""WITH {fx.RASTER}, {TILES_THERE}, o AS (SELECT s_suppkey AS id, 41.5e0 + (s_suppkey * 7919 % 3000) / 1e3 AS lat, 40.5e0 + (s_suppkey * 10429 % 3500) / 1e3 AS lon FROM supplier),
f AS (SELECT id, lat, lon, ray * ({TURN} / 72) AS az, d * 8000e0 / 6371000e0 AS r FROM o, range(72) a(ray), range(26) b(d)), s AS (SELECT *, sin(radians(lat)) * cos(r) + cos(radians(lat)) * sin(r) * cos(az) AS s FROM f),
k AS (SELECT DISTINCT id, CAST(floor((degrees(radians(lon) + atan2(sin(az) * sin(r) * cos(radians(lat)), cos(r) - sin(radians(lat)) * s)) - 40.4371e0) / 0.25e0) AS BIGINT) AS tx, CAST(floor((45.3529e0 - degrees(asin(s))) / 0.25e0) AS BIGINT) AS ty FROM s)
SELECT id, tx, ty FROM k SEMI JOIN there USING (tx, ty)""")
def prefetched_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of the raster that the fans of all observers meet."""
    k = F.col("s_suppkey")
    observers = fx.table(spark, sf_dir, "supplier").select(k.alias("id"), (41.5 + k * 7919 % 3000 / F.lit(1e3)).alias("lat"), (40.5 + k * 10429 % 3500 / F.lit(1e3)).alias("lon"))
    there = fx.raster(spark, sf_dir).select(F.floor(F.col("gx") / 16).alias("tx"), F.floor(F.col("gy") / 16).alias("ty")).distinct()
    return planning.prefetch_keys(observers, 1 / 64, 16, 40.4371, 45.3529).join(there, ["tx", "ty"], "left_semi")


@query(f"""WITH {fx.RASTER}, {TILES_THERE}, o AS (SELECT s_suppkey AS id, 41.5e0 + (s_suppkey * 7919 % 3000) / 1e3 AS lat, 40.5e0 + (s_suppkey * 10429 % 3500) / 1e3 AS lon FROM supplier),
f AS (SELECT id, lat, lon, ray, d * 2000e0 AS d, ray * ({TURN} / 24) AS az, d * 2000e0 / 6371000e0 AS r FROM o, range(24) a(ray), range(101) b(d)), s AS (SELECT *, sin(radians(lat)) * cos(r) + cos(radians(lat)) * sin(r) * cos(az) AS s FROM f),
k AS (SELECT id, ray, d, CAST(floor((degrees(radians(lon) + atan2(sin(az) * sin(r) * cos(radians(lat)), cos(r) - sin(radians(lat)) * s)) - 40.4371e0) / 0.25e0) AS BIGINT) AS tx, CAST(floor((45.3529e0 - degrees(asin(s))) / 0.25e0) AS BIGINT) AS ty FROM s)
SELECT id, CAST(ray AS INT) AS ray, max(d) AS last_d FROM k SEMI JOIN there USING (tx, ty) GROUP BY id, ray""")
def covered_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far along each ray of every observer the raster reaches."""
    k = F.col("s_suppkey")
    observers = fx.table(spark, sf_dir, "supplier").select(k.alias("id"), (41.5 + k * 7919 % 3000 / F.lit(1e3)).alias("lat"), (40.5 + k * 10429 % 3500 / F.lit(1e3)).alias("lon"))
    there = fx.raster(spark, sf_dir).select(F.floor(F.col("gx") / 16).alias("tx"), F.floor(F.col("gy") / 16).alias("ty")).distinct()
    return planning.last_covered(planning.fan(observers, 1 / 64, 16, 40.4371, 45.3529, rays=24, step=2_000.0), there)


@query(f"""WITH p AS (SELECT vec_id AS frame, CAST(ray AS INT) AS ray, CAST(embedding[ray + 1] AS DOUBLE) * 0.2e0 AS angle, CASE WHEN radians(vec_id * 37 % 360) > pi() THEN radians(vec_id * 37 % 360) - {TURN} ELSE radians(vec_id * 37 % 360) END AS centre FROM embeddings, range(64) r(ray) WHERE (vec_id + ray) % 9 > 0),
x AS (SELECT *, 400e0 + (ray * ({TURN} / 64) - centre - {TURN} * ceil((ray * ({TURN} / 64) - centre - pi()) / {TURN})) / 1.5e0 * 800 AS x FROM p), s AS (SELECT * FROM x WHERE x BETWEEN -20 AND 820),
b AS (SELECT *, ((ray - lag(ray) OVER w) % 64 + 64) % 64 > 1 OR abs(x - lag(x) OVER w) > 800 * {mapview.WIDEST_GAP!r} OR abs(angle - lag(angle) OVER w) > {mapview.STEEPEST!r} * ({TURN} / 64) AS breaks FROM s WINDOW w AS (PARTITION BY frame ORDER BY x)),
l AS (SELECT *, CAST(sum(CASE WHEN coalesce(breaks, true) THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY x) AS BIGINT) AS line FROM b)
SELECT frame, line, ray, round(x, 6) AS x, round(angle, 6) AS angle FROM (SELECT *, count(*) OVER (PARTITION BY frame, line) AS n FROM l) WHERE n > 1""")
def ridge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridges of all frames on their screens, in pieces without holes or jumps."""
    az = F.radians((F.col("frame") * 37 % 360).cast("double"))
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("ray", "v")).filter((F.col("frame") + F.col("ray")) % 9 > 0)
    profiles = rows.select("frame", "ray", (F.col("v").cast("double") * 0.2).alias("angle"), F.when(az > math.pi, az - 2 * math.pi).otherwise(az).alias("centre"), F.lit(800.0).alias("width"))
    return mapview.ridge_lines(profiles, 1.5, 64).select("frame", "line", "ray", F.round("x", 6).alias("x"), F.round("angle", 6).alias("angle"))


SOURCE_CELLS = """source_cells AS (SELECT 0 AS source, 40e0 + gx * 0.015625e0 AS west, 45e0 - gy * 0.015625e0 AS north, 0.015625e0 AS wide, 0.015625e0 AS high, h FROM raster
  UNION ALL SELECT 1, 40.7e0 + gx * 0.07e0, 44.3e0 - gy * 0.05e0, 0.07e0, 0.05e0, h FROM raster4 WHERE h > 2500)"""


def _source_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources whose cells are of other sizes and corners than the grid's and each other's."""

    def source(cells: DataFrame, k: int, west: float, north: float, wide: float, high: float) -> DataFrame:
        return cells.select(F.lit(k).alias("source"), (west + F.col("gx") * wide).alias("west"), (north - F.col("gy") * high).alias("north"), F.lit(wide).alias("wide"), F.lit(high).alias("high"), F.col("h").cast("double").alias("h"))

    fine, coarse = fx.raster(spark, sf_dir), fx.level(spark, sf_dir, 4).cells.filter("h > 2500")
    return source(fine, 0, 40.0, 45.0, 0.015625, 0.015625).union(source(coarse, 1, 40.7, 44.3, 0.07, 0.05))


@query(f"""WITH {fx.RASTER}, {SOURCE_CELLS}, z AS (SELECT *, west + 180 AS x, 90 - north AS y FROM source_cells),
r AS (SELECT *, unnest(range(CAST(floor(x / 0.04e0) AS BIGINT), greatest(CAST(ceil((x + wide) / 0.04e0) AS BIGINT), CAST(floor(x / 0.04e0) AS BIGINT) + 1))) AS gx FROM z),
q AS (SELECT *, unnest(range(CAST(floor(y / 0.04e0) AS BIGINT), greatest(CAST(ceil((y + high) / 0.04e0) AS BIGINT), CAST(floor(y / 0.04e0) AS BIGINT) + 1))) AS gy FROM r),
w AS (SELECT gx, gy, source, h, greatest(0e0, least((gx + 1) * 0.04e0, x + wide) - greatest(gx * 0.04e0, x)) / 0.04e0 * (greatest(0e0, least((gy + 1) * 0.04e0, y + high) - greatest(gy * 0.04e0, y)) / 0.04e0) AS share FROM q),
c AS (SELECT gx, gy, source, sum(share * h) / sum(share) AS h FROM w WHERE share > 1e-9 GROUP BY 1, 2, 3) SELECT gx, gy, round(arg_max(h, source), 6) AS h FROM c GROUP BY 1, 2""")
def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of unlike cells as one grid that lines up with neither."""
    return planning.reprojected(_source_cells(spark, sf_dir), 0.04).withColumn("h", F.round("h", 6))


@query(f"WITH {fx.RASTER} SELECT gx, gy, CAST(sum(h) OVER w AS BIGINT) AS sum, CAST(sum(h * h) OVER w AS BIGINT) AS sum2, max(h) OVER w AS top FROM raster WINDOW w AS (PARTITION BY gx ORDER BY gy)")
def column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums and the highest so far down the columns."""
    return tiles.prefix_sums(fx.raster(spark, sf_dir))


@query(f"""WITH {fx.RASTER}, q AS (SELECT a.gx, b.gy, CAST(coalesce(round_even(h / 4e0, 0), 0) AS BIGINT) AS q FROM range(64) a(gx), range(64) b(gy) LEFT JOIN raster4 r ON r.gx = a.gx AND r.gy = b.gy),
n AS (SELECT o.gx, o.gy, o.q, l.q AS a, u.q AS b, c.q AS c FROM q o LEFT JOIN q l ON l.gx = o.gx - 1 AND l.gy = o.gy AND o.gx % 16 > 0 LEFT JOIN q u ON u.gx = o.gx AND u.gy = o.gy - 1 AND o.gy % 16 > 0 LEFT JOIN q c ON c.gx = o.gx - 1 AND c.gy = o.gy - 1 AND o.gx % 16 > 0 AND o.gy % 16 > 0),
r AS (SELECT *, q - CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END AS residual FROM n)
SELECT gx // 16 AS tx, gy // 16 AS ty, CAST(sum((CASE WHEN residual >= 0 THEN residual * 2 ELSE -residual * 2 - 1 END) // 64 + 7) AS BIGINT) AS bits FROM r GROUP BY 1, 2""")
def codec_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of tiles after prediction."""
    cells = fx.level(spark, sf_dir, 4).cells.withColumn("q", F.rint(F.col("h") / 4).cast("long"))
    grid = spark.range(64).withColumnRenamed("id", "gx").withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    whole = grid.join(cells.select("gx", "gy", "q"), ["gx", "gy"], "left").withColumn("q", F.coalesce("q", F.lit(0)))
    return tiles.rice_bits(tiles.paeth(whole, 16), ["tx", "ty"], 6)


def _label_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture a customer: its size, roll and the ridge in it."""
    k = F.col("c_custkey")
    ridge = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda j: 240 + 70 * F.sin(k * 0.37 + j * 0.4))
    return fx.table(spark, sf_dir, "customer").select(
        k.alias("frame"), (640.0 + k % 3 * 160).alias("width"), F.lit(480.0).alias("height"), (1 + k % 2 * 0.25).alias("scale"), ((k % 7 - 3) * 0.03).alias("roll"), ridge.alias("ridge")
    )


def _picture_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a peak in its customer's picture; each fifth lies behind the ridge."""
    k = F.col("o_orderkey")
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = fx.table(spark, sf_dir, "orders").withColumn("part", k % 200).join(parts, F.col("part") == F.col("p_partkey"), "left")
    hidden = k % 5 == 0
    info = F.array(F.concat((500 + k * 613 % 5000).cast("string"), F.lit(" m")), F.concat((1 + k % 90).cast("string"), F.lit(" km")))
    return rows.select(
        F.col("o_custkey").alias("frame"), k.alias("key"), (k * 7919 % 1000 - 50.0).alias("x"), (F.when(hidden, 300).otherwise(150) + k * 613 % 130).cast("double").alias("y"),
        F.col("p_name").alias("name"), info.alias("info"), hidden.alias("hidden"), (-F.col("o_totalprice")).alias("rank"),
    )


@query(None)
def panorama_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the labels in every picture."""
    rows = panorama_labels.panorama_labels(_picture_labels(spark, sf_dir), _label_frames(spark, sf_dir))
    return rows.select("frame", "key", "form", F.round("lift", 4).alias("lift"), "mirrored", "line", "text", *[F.round(c, 4).alias(c) for c in ("u0", "u1", "v")])


def _zigzag(r: str) -> str:
    return f"(CASE WHEN {r} >= 0 THEN {r} * 2 ELSE -{r} * 2 - 1 END)"


def _paeth(name: str, cells: str) -> str:
    """CTEs that end in ``name`` (gx, gy, residual): what Paeth leaves of ``cells`` (gx, gy, q) in tiles of 16."""
    return f"""{name}_n AS (SELECT o.gx, o.gy, o.q, l.q AS a, u.q AS b, c.q AS c FROM {cells} o LEFT JOIN {cells} l ON l.gx = o.gx - 1 AND l.gy = o.gy AND o.gx % 16 > 0 LEFT JOIN {cells} u ON u.gx = o.gx AND u.gy = o.gy - 1 AND o.gy % 16 > 0 LEFT JOIN {cells} c ON c.gx = o.gx - 1 AND c.gy = o.gy - 1 AND o.gx % 16 > 0 AND o.gy % 16 > 0),
{name} AS (SELECT gx, gy, q - CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END AS residual FROM {name}_n)"""


_RICE = "least(" + ", ".join(f"sum(CASE WHEN (z >> {k}) > 47 THEN 69 ELSE (z >> {k}) + 1 + {k} END)" for k in range(16)) + ")"


@query(f"""WITH {fx.RASTER}, q AS (SELECT a.gx, b.gy, CAST(coalesce(round_even(h / 4e0, 0), 0) AS BIGINT) AS q FROM range(64) a(gx), range(64) b(gy) LEFT JOIN raster4 r ON r.gx = a.gx AND r.gy = b.gy),
parent AS (SELECT a.px, b.py, CAST(coalesce(round_even(h / 4e0, 0), 0) AS BIGINT) AS q FROM range(16) a(px), range(16) b(py) LEFT JOIN raster16 r ON r.gx = a.px AND r.gy = b.py),
lefts AS (SELECT o.gx, o.gy, o.q - coalesce(l.q, 0) AS residual FROM q o LEFT JOIN q l ON l.gx = o.gx - 1 AND l.gy = o.gy AND o.gx % 16 > 0),
fit AS (SELECT gx // 16 AS tx, gy // 16 AS ty, sum((gx % 16 - 7.5e0) * q) / 5440e0 AS a, sum((gy % 16 - 7.5e0) * q) / 5440e0 AS b, avg(q) AS c FROM q GROUP BY 1, 2),
flat AS (SELECT gx, gy, q - CAST(round_even(a * (gx % 16 - 7.5e0) + b * (gy % 16 - 7.5e0) + c, 0) AS BIGINT) AS q FROM q JOIN fit ON tx = gx // 16 AND ty = gy // 16),
drawn AS (SELECT q.gx, q.gy, q.q - CAST(round_even((a.q * (1 - q.gx % 4 / 4e0) + b.q * (q.gx % 4 / 4e0)) * (1 - q.gy % 4 / 4e0) + (c.q * (1 - q.gx % 4 / 4e0) + d.q * (q.gx % 4 / 4e0)) * (q.gy % 4 / 4e0), 0) AS BIGINT) AS q FROM q
  JOIN parent a ON a.px = q.gx // 4 AND a.py = q.gy // 4 JOIN parent b ON b.px = least(q.gx // 4 + 1, 15) AND b.py = q.gy // 4 JOIN parent c ON c.px = q.gx // 4 AND c.py = least(q.gy // 4 + 1, 15) JOIN parent d ON d.px = least(q.gx // 4 + 1, 15) AND d.py = least(q.gy // 4 + 1, 15)),
{_paeth("paeths", "q")}, {_paeth("planes", "flat")}, {_paeth("levels", "drawn")},
every AS (SELECT 'left' AS predictor, 0 AS more, * FROM lefts UNION ALL SELECT 'paeth', 0, * FROM paeths UNION ALL SELECT 'plane', 12, * FROM planes UNION ALL SELECT 'level', 0, * FROM levels),
z AS (SELECT predictor, more, gx // 16 AS tx, gy // 16 AS ty, gy % 16 // 4 AS block, {_zigzag("residual")} AS z FROM every),
blocks AS (SELECT predictor, more, tx, ty, block, {_RICE} AS bits FROM z GROUP BY ALL),
coded AS (SELECT tx, ty, predictor, 'rice' AS code, 4 + count(*) + (sum(bits) + 7) // 8 + more AS bytes FROM blocks GROUP BY tx, ty, predictor, more
  UNION ALL SELECT tx, ty, predictor, 'golomb', 4 + (sum(2 * (length(bin(z + 1)) - 1) + 1) + 7) // 8 + more FROM z GROUP BY tx, ty, predictor, more)
SELECT tx, ty, predictor, code, CAST(bytes AS BIGINT) AS bytes, bytes = min(bytes) OVER (PARTITION BY tx, ty) AS least FROM coded""")
def codec_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every tile by predictor and code, and which is least."""
    from pyspark.sql import Window

    def steps(factor: int, x: str, y: str) -> DataFrame:
        side = fx.SIDE // factor
        grid = spark.range(side).withColumnRenamed("id", x).withColumn(y, F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn(y, F.col(y).cast("long"))
        cells = fx.level(spark, sf_dir, factor).cells.select(F.col("gx").alias(x), F.col("gy").alias(y), "h")
        return grid.join(cells, [x, y], "left").select(x, y, F.coalesce(F.rint(F.col("h") / 4), F.lit(0)).cast("long").alias("q"))

    found = codecs.bench(steps(4, "gx", "gy"), steps(16, "px", "py"), 16, 4, 4)
    return found.withColumn("least", F.col("bytes") == F.min("bytes").over(Window.partitionBy("tx", "ty")))
