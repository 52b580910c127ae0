"""Scalar geometry over the supplied tables, each query with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.functions import frames, geo, screen, sql
from vistaspark.plans import fixtures as fx
from vistaspark.plans.registry import query

TURN = repr(2 * math.pi)


def _rounded(columns: dict, places: int = 6) -> list:
    return [F.round(v, places).alias(k) for k, v in columns.items()]


def _sql_rounded(columns: dict, places: int = 6) -> str:
    return ", ".join(f"round({v}, {places}) AS {k}" for k, v in columns.items())


@query(f"""WITH {fx.PEAKS}, a AS (SELECT *, radians(((id * 37) % 1440) - 720) AS turn, (0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 262144 AS py, (lon + 180) / 360 * 262144 AS px FROM peaks),
t AS (SELECT *, floor(px / 256) AS tx, floor(py / 256) AS ty, turn - {TURN} * ceil((turn - pi()) / {TURN}) AS w FROM a)
SELECT id, {_sql_rounded({
    "wrapped": "w", "azimuth": f"turn - {TURN} * floor(turn / {TURN})", "py": "py", "tile_px": "px - 256 * tx", "tile_py": "py - 256 * ty",
    "back_lat": "degrees(atan(sinh(pi() - 2 * pi() * py / 262144)))", "back_lon": "px / 262144 * 360 - 180",
    "min_lon": "tx / 1024 * 360 - 180", "min_lat": "degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 1024))))", "max_lon": "(tx + 1) / 1024 * 360 - 180", "max_lat": "degrees(atan(sinh(pi() * (1 - 2 * ty / 1024))))",
})}, abs(lat + id % 100) <= 90 AS valid FROM t""")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles brought into range, and the map projection there and back."""
    lat, lon, turn = F.col("lat"), F.col("lon"), F.radians((F.col("id") * 37 % 1440 - 720).cast("double"))
    px, py = geo.mercator(lat, lon, 10)
    back_lat, back_lon = geo.unproject(px, py, 10)
    in_x, in_y = geo.slippy_pixel(lat, lon, 10)
    columns = {"wrapped": geo.wrap_angle(turn), "azimuth": geo.normalize_azimuth(turn), "py": py, "tile_px": in_x, "tile_py": in_y, "back_lat": back_lat, "back_lon": back_lon}
    columns |= geo.slippy_bbox(*geo.slippy_tile(lat, lon, 10), 10)
    return fx.peaks(spark, sf_dir).select("id", *_rounded(columns), geo.valid(lat + F.col("id") % 100, lon).alias("valid"))


@query(f"""WITH {fx.REGIONS}, c AS (SELECT *, CASE WHEN max_lon < min_lon THEN (min_lon + max_lon + 360) / 2 ELSE (min_lon + max_lon) / 2 END AS mid FROM regions)
SELECT ord, round((min_lat + max_lat) / 2, 6) AS lat, round(CASE WHEN mid >= 180 THEN mid - 360 ELSE mid END, 6) AS lon,
  max_lon - min_lon < 180 OR max_lat - min_lat < 120 AS regional,
  round(-180 + ord * 2.5e0, 6) AS tile_min_lon, round(90 - (ord // 3) * 2.5e0 - 2.5e0, 6) AS tile_min_lat, round(-180 + ord * 2.5e0 + 2.5e0, 6) AS tile_max_lon, round(90 - (ord // 3) * 2.5e0, 6) AS tile_max_lat FROM c""")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of boxes, also across the antimeridian, and the boxes of pyramid tiles."""
    lat, lon = geo.bbox_centre()
    k = F.col("ord")
    tile = geo.pyramid_bbox(F.lit(-180.0), F.lit(90.0), F.lit(2.5), k, F.floor(k / 3))
    return fx.regions(spark, sf_dir).select("ord", *_rounded({"lat": lat, "lon": lon}), geo.is_regional().alias("regional"), *_rounded({f"tile_{n}": c for n, c in tile.items()}))


FRAME = "SELECT event_id, radians(30 + event_id % 50) AS base, 640e0 + event_id % 900 AS fw, 480e0 + event_id * 7 % 1100 AS fh, 360e0 + event_id * 3 % 700 AS vw, 700e0 + event_id * 5 % 300 AS vh, (event_id % 5) / 2e0 AS zoom, CAST(event_id % 3 - 1 AS INT) * 90 AS soft, [0, 90, 270][CAST(event_id % 3 AS INT) + 1] AS win, event_id % 2 = 0 AS device FROM events"


@query(f"""WITH f AS ({FRAME}), a AS (SELECT *, CASE WHEN fw >= fh THEN base ELSE 2 * atan(tan(base / 2) * fw / fh) END AS h, CASE WHEN fw >= fh THEN 2 * atan(tan(base / 2) * fh / fw) ELSE base END AS v, greatest(vw / fw, vh / fh) AS s FROM f)
SELECT event_id, {_sql_rounded({
    "fov_h": "h", "fov_v": "v", "zoomed": "2 * atan(tan(h / 2) / CASE WHEN zoom > 0 THEN zoom ELSE 1 END)",
    "cropped_h": "2 * atan(tan(h / 2) * least(1e0, vw / (fw * s)))", "cropped_v": "2 * atan(tan(v / 2) * least(1e0, vh / (fh * s)))",
    "horizon_row": "(0.55e0 * vh - (vh - fh * s) / 2) / (fh * s)",
    "roll": "radians(event_id % 40) - (soft + CASE WHEN device AND win = 90 THEN 90 WHEN device AND win = 270 THEN -90 ELSE 0 END) * pi() / 180",
})}, CAST((360 - soft) % 360 AS INT) AS rotation, CASE WHEN soft <> 0 THEN fh ELSE fw END AS turned_w, CASE WHEN soft <> 0 THEN fw ELSE fh END AS turned_h FROM a""")
def camera_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of view of frames, cropped, zoomed and turned."""
    k = F.col("event_id")
    rows = fx.table(spark, sf_dir, "events").select(
        "event_id", F.radians((30 + k % 50).cast("double")).alias("base"), (640.0 + k % 900).alias("fw"), (480.0 + k * 7 % 1100).alias("fh"), (360.0 + k * 3 % 700).alias("vw"),
        (700.0 + k * 5 % 300).alias("vh"), (k % 5 / 2).alias("zoom"), ((k % 3 - 1) * 90).cast("int").alias("soft"), F.element_at(F.array(F.lit(0), F.lit(90), F.lit(270)), (k % 3 + 1).cast("int")).alias("win"),
    )
    fw, fh, vw, vh = (F.col(x) for x in ("fw", "fh", "vw", "vh"))
    h, v = frames.fov_for_frame(F.col("base"), fw, fh)
    crop_h, crop_v = frames.apply_cover_crop(h, v, fw, fh, vw, vh)
    rotation = frames.frame_rotation(F.col("soft"))
    turned_w, turned_h = frames.rotated_size(fw, fh, rotation)
    columns = {
        "fov_h": h, "fov_v": v, "zoomed": frames.apply_zoom(h, F.col("zoom")), "cropped_h": crop_h, "cropped_v": crop_v,
        "horizon_row": frames.horizon_row_in_frame(F.lit(0.55), fw, fh, vw, vh), "roll": frames.overlay_roll(F.radians((k % 40).cast("double")), F.col("soft"), F.col("win"), k % 2 == 0),
    }
    return rows.select("event_id", *_rounded(columns), rotation.cast("int").alias("rotation"), turned_w.alias("turned_w"), turned_h.alias("turned_h"))


@query(f"""WITH e AS (SELECT event_id, ts, radians(event_id * 13 % 360) AS a, radians(event_id * 7 % 179 - 89) AS b, radians(event_id * 11 % 179 - 89) AS g, event_id % 8 * 45 AS wind FROM events),
l AS (SELECT *, -(cos(a) * sin(g) + sin(a) * sin(b) * cos(g)) AS x, -(sin(a) * sin(g) - cos(a) * sin(b) * cos(g)) AS y FROM e),
z AS (SELECT *, CASE WHEN atan2(x, y) < 0 THEN atan2(x, y) + {TURN} ELSE atan2(x, y) END AS az, extract(year FROM ts) AS yr FROM l)
SELECT event_id, {_sql_rounded({
    "azimuth": "az", "elevation": "atan2(-cos(b) * cos(g), sqrt(x * x + y * y))", "roll": "atan2(-cos(b) * sin(g), sin(b))",
    "rate": "cos(b) * sin(g) * radians(event_id % 17) - sin(b) * radians(event_id % 23) - cos(b) * cos(g) * radians(event_id % 31)",
    "year": "yr + CAST(epoch_us(ts) - epoch_us(make_timestamp(yr, 1, 1, 0, 0, 0)) AS DOUBLE) / (epoch_us(make_timestamp(yr + 1, 1, 1, 0, 0, 0)) - epoch_us(make_timestamp(yr, 1, 1, 0, 0, 0)))",
})}, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(wind // 45 AS INT) + 1] || ' ' || wind || '°' AS wind, CAST(floor(degrees(radians(event_id % 360 + 0.25e0)) + 0.5e0) AS INT) || '°' AS heading,
  abs(CASE WHEN az > pi() THEN az - {TURN} ELSE az END) <= 0.5e0 AS in_sector FROM z""")
def device_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where devices look, how fast they turn, and when."""
    k = F.col("event_id")
    alpha, beta, gamma = ((x).cast("double") for x in (k * 13 % 360, k * 7 % 179 - 89, k * 11 % 179 - 89))
    pose = frames.look(alpha, beta, gamma)
    columns = pose | {"rate": frames.vertical_rate(beta, gamma, k % 31, k % 17, k % 23), "year": geo.decimal_year(F.col("ts").cast("timestamp"))}
    return fx.table(spark, sf_dir, "events").select(
        "event_id", *_rounded(columns), geo.cardinal(k % 8 * 45).alias("wind"), geo.format_azimuth(F.radians(k % 360 + F.lit(0.25))).alias("heading"),
        geo.in_sector(pose["azimuth"], F.lit(0.0), F.lit(1.0)).alias("in_sector"),
    )


SCREEN = "SELECT c_custkey AS id, c_custkey * 31 % 1100 - 50e0 AS x, c_custkey * 17 % 900 - 50e0 AS y, 40e0 + c_custkey % 160 AS len, radians(c_custkey % 60) AS slope, radians(c_custkey * 3 % 50 - 25) AS roll, c_custkey * 53 % 1000 + 0e0 AS x2, c_custkey * 71 % 800 + 0e0 AS y2, c_name AS name FROM customer"


def _corner_sql(u: str, v: str) -> str:
    px, py = f"(x + {u} * cos(slope) - ({v}) * -sin(slope) - 500)", f"(y + {u} * -sin(slope) + ({v}) * cos(slope) - 400)"
    return f"(500 + {px} * cos(roll) - {py} * sin(roll) BETWEEN 0 AND 1000 AND 400 + {px} * sin(roll) + {py} * cos(roll) BETWEEN 0 AND 800)"


CORNERS = [_corner_sql(u, v) for u in ("0", "len") for v in ("-9", "9")]


def _side_sql(p, q, r):
    return f"sign(({r[0]} - {p[0]}) * ({q[1]} - {p[1]}) - ({r[1]} - {p[1]}) * ({q[0]} - {p[0]}))"


_A, _B, _C, _D = ("x", "y"), ("x2", "y2"), ("100e0", "700e0"), ("900e0", "150e0")


@query(f"""WITH s AS ({SCREEN}), t AS (SELECT *,
  [CASE WHEN x2 = x THEN 0e0 ELSE least((300 - x) / nullif(x2 - x, 0), (700 - x) / nullif(x2 - x, 0)) END, CASE WHEN y2 = y THEN 0e0 ELSE least((200 - y) / nullif(y2 - y, 0), (600 - y) / nullif(y2 - y, 0)) END, 0e0] AS f,
  [CASE WHEN x2 = x THEN 1e0 ELSE greatest((300 - x) / nullif(x2 - x, 0), (700 - x) / nullif(x2 - x, 0)) END, CASE WHEN y2 = y THEN 1e0 ELSE greatest((200 - y) / nullif(y2 - y, 0), (600 - y) / nullif(y2 - y, 0)) END, 1e0] AS u FROM s)
SELECT id, round(greatest(20, (1000 * (1 - cos(roll)) + 800 * abs(sin(roll))) / 2 + 5e0 * 1.5e0 + 8), 6) AS margin, {' AND '.join(CORNERS)} AS whole, {' OR '.join(CORNERS)} AS part,
  (x2 <> x OR x BETWEEN 300 AND 700) AND (y2 <> y OR y BETWEEN 200 AND 600) AND list_max(f) <= list_min(u) AS meets_box,
  {_side_sql(_A, _B, _C)} * {_side_sql(_A, _B, _D)} < 0 AND {_side_sql(_C, _D, _A)} * {_side_sql(_C, _D, _B)} < 0 AS crosses, least(148e0, 6.5e0 * length(name) + 8) AS width FROM t""")
def screen_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and lines against the turned screen."""
    k = F.col("c_custkey")
    s = fx.table(spark, sf_dir, "customer").select(
        k.alias("id"), (k * 31 % 1100 - 50).cast("double").alias("x"), (k * 17 % 900 - 50).cast("double").alias("y"), (40.0 + k % 160).alias("len"), F.radians((k % 60).cast("double")).alias("slope"),
        F.radians((k * 3 % 50 - 25).cast("double")).alias("roll"), (k * 53 % 1000).cast("double").alias("x2"), (k * 71 % 800).cast("double").alias("y2"), "c_name",
    )
    x, y, x2, y2 = (F.col(c) for c in ("x", "y", "x2", "y2"))
    label = (x, y, F.col("len"), F.cos("slope"), -F.sin("slope"), F.col("roll"), F.lit(1000.0), F.lit(800.0), F.lit(1.0))
    box = [F.lit(float(v)) for v in (300, 700, 200, 600)]
    c, d = [tuple(F.lit(v) for v in p) for p in ((100.0, 700.0), (900.0, 150.0))]
    return s.select(
        "id", F.round(screen.roll_edge_margin(F.lit(1000.0), F.lit(800.0), F.col("roll"), F.lit(1.5)), 6).alias("margin"), screen.label_fully_on_screen(*label).alias("whole"),
        screen.label_partly_on_screen(*label).alias("part"), screen.segment_meets_box(x, y, x2, y2, *box).alias("meets_box"), screen.segments_cross((x, y), (x2, y2), c, d).alias("crosses"), screen.label_width(F.col("c_name")).alias("width"),
    )


# The dipole of the field in 2025, nanotesla and their change a year.
DIPOLE = [(1, 0, -29351.8, 0.0, 12.0, 0.0), (1, 1, -1410.8, 4545.4, 9.7, -21.5)]


@query(f"""WITH {fx.PEAKS}, p AS (SELECT id, radians(lat - id % 90) AS phi, radians(lon * 4 - id % 180) AS lam, 2024.5e0 + id % 9 AS yr FROM peaks), n AS (SELECT *, least(6, greatest(-1, yr - 2025)) AS dt, 6378.137e0 / sqrt(1 - 0.00669437999014e0 * sin(phi) * sin(phi)) AS nn FROM p),
q AS (SELECT *, sqrt(pow(nn * cos(phi), 2) + pow(nn * (1 - 0.00669437999014e0) * sin(phi), 2)) AS r FROM n), c AS (SELECT *, asin(nn * (1 - 0.00669437999014e0) * sin(phi) / r) AS gc, -29351.8e0 + 12e0 * dt AS g0, -1410.8e0 + 9.7e0 * dt AS g1, 4545.4e0 - 21.5e0 * dt AS h1 FROM q),
b AS (SELECT *, -g0 * cos(gc) + (g1 * cos(lam) + h1 * sin(lam)) * sin(gc) AS x, g1 * sin(lam) - h1 * cos(lam) AS y, -2 * (g0 * sin(gc) + (g1 * cos(lam) + h1 * sin(lam)) * cos(gc)) AS z FROM c)
SELECT id, round(degrees(atan2(y, x * cos(gc - phi) - z * sin(gc - phi))), 6) AS declination FROM b""")
def dipole_declination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declination of a dipole; models of more terms go the same way."""
    from vistaspark.operators.magnetism import declination

    at = declination(spark.createDataFrame(DIPOLE, "n int, m int, g double, h double, gt double, ht double"), 2025.0)
    k = F.col("id")
    return fx.peaks(spark, sf_dir).select("id", F.round(at(F.col("lat") - k % 90, F.col("lon") * 4 - k % 180, 2024.5 + k % 9), 6).alias("declination"))


@query(f"""WITH {fx.PEAKS}, d AS (SELECT id, ele, {fx.haversine('43.35e0', '42.44e0', 'lat', 'lon')} AS d FROM peaks)
SELECT id, round(d, 3) AS d, round(d * d * 0.87e0 / (2 * 6371000e0), 6) AS sunk, round(atan2(coalesce(ele, 0) - 2000 - d * d * 0.87e0 / (2 * 6371000e0), d), 9) AS angle, round(coalesce(ele, 0) * (1 + 0.4e0 * exp(-d / 40000e0)), 3) AS score FROM d WHERE d < 150000""")
def sql_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14: distance, drop, elevation and score of peaks as SQL text over registered functions."""
    sql.register(spark)
    return spark.sql(
        """SELECT id, round(d, 3) AS d, round(drop_m(d), 6) AS sunk, round(elevation_angle(2000, coalesce(ele, 0), d), 9) AS angle, round(label_score(ele, d, NULL), 3) AS score
        FROM (SELECT id, ele, distance_m(43.35, 42.44, lat, lon) AS d FROM {peaks}) WHERE d < 150000""",
        peaks=fx.peaks(spark, sf_dir),
    )


@query(f"""WITH {fx.REGIONS}, s AS (SELECT ord, min_lat, max_lat, unnest(CASE WHEN min_lon <= max_lon THEN [{{'lo': min_lon, 'hi': max_lon}}] ELSE [{{'lo': min_lon, 'hi': 180e0}}, {{'lo': -180e0, 'hi': max_lon}}] END) AS p FROM regions),
x AS (SELECT ord, min_lat, max_lat, unnest(range(CAST(floor((p.lo + 180) / 0.25e0) AS BIGINT), CAST(ceil((p.hi + 180) / 0.25e0) AS BIGINT))) AS tx FROM s),
k AS (SELECT DISTINCT ord, tx, unnest(range(CAST(floor((90 - max_lat) / 0.25e0) AS BIGINT), CAST(ceil((90 - min_lat) / 0.25e0) AS BIGINT))) AS ty FROM x) SELECT ord, count(*) AS tiles, min(tx) AS first_tx, max(ty) AS last_ty FROM k GROUP BY ord""")
def sql_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14, M15: the tiles of every region by a table function in a lateral join."""
    sql.register(spark)
    return spark.sql(
        "SELECT ord, count(*) AS tiles, min(tx) AS first_tx, max(ty) AS last_ty FROM {regions} r, LATERAL tile_keys_in_bbox(r.min_lat, r.min_lon, r.max_lat, r.max_lon, 0.25) GROUP BY ord",
        regions=fx.regions(spark, sf_dir),
    )


@query("""WITH RECURSIVE m(d) AS (SELECT 150e0 UNION ALL SELECT d + CASE WHEN d < 5000 THEN 90 WHEN d < 30000 THEN 180 WHEN d < 100000 THEN 350 ELSE 700 END FROM m WHERE d <= 200000), w AS (SELECT d / 6371000e0 AS w FROM m WHERE d <= 60000),
o AS (SELECT s_suppkey AS id, radians(41.5e0 + (s_suppkey * 7919 % 3000) / 1e3) AS p, radians(40.5e0 + (s_suppkey * 10429 % 3500) / 1e3) AS q, radians(s_suppkey * 37 % 360) AS z FROM supplier),
s AS (SELECT id, degrees(asin(sin(p) * cos(w) + cos(p) * sin(w) * cos(z))) AS lat FROM o, w) SELECT id, count(*) AS steps, round(max(lat), 6) AS top, round(min(lat), 6) AS low FROM s GROUP BY id""")
def sql_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14, M6: the samples of a ray of every observer by a table function in a lateral join."""
    sql.register(spark)
    k = F.col("s_suppkey")
    observers = fx.table(spark, sf_dir, "supplier").select(k.alias("id"), (41.5 + k * 7919 % 3000 / F.lit(1e3)).alias("lat"), (40.5 + k * 10429 % 3500 / F.lit(1e3)).alias("lon"), F.radians((k * 37 % 360).cast("double")).alias("az"))
    return spark.sql("SELECT id, count(*) AS steps, round(max(s.lat), 6) AS top, round(min(s.lat), 6) AS low FROM {observers} o, LATERAL ray_steps(o.lat, o.lon, o.az, 150, 60000) s GROUP BY id", observers=observers)


@query(f"""WITH {fx.PEAKS}, m AS (SELECT id, lat, lon, ele, radians(id * 37 % 360) + CASE WHEN id % 3 > 0 THEN (id % 900 - 450e0) / 900e0 * 1.2e0 ELSE 0e0 END AS az, 500e0 / 6371000e0 AS r FROM peaks),
s AS (SELECT *, sin(radians(lat)) * cos(r) + cos(radians(lat)) * sin(r) * cos(az) AS s FROM m)
SELECT id, round(degrees(asin(s)), 7) AS lat, round(degrees(radians(lon) + atan2(sin(az) * sin(r) * cos(radians(lat)), cos(r) - sin(radians(lat)) * s)), 7) AS lon, CASE WHEN id % 5 = 0 THEN 2500e0 ELSE ele END + (id % 7 - 3) * 100e0 AS height FROM s""")
def moved_observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observers a step forward where they tapped, and lifted."""
    k = F.col("id")
    to = geo.forward(F.col("lat"), F.col("lon"), F.radians((k * 37 % 360).cast("double")), F.lit(1.2), F.when(k % 3 > 0, (k % 900).cast("double")), F.lit(900.0))
    height = geo.lifted(F.when(k % 5 == 0, 2500.0), F.col("ele").cast("double"), k % 7 - 3)
    return fx.peaks(spark, sf_dir).select("id", F.round(to[0], 7).alias("lat"), F.round(to[1], 7).alias("lon"), height.alias("height"))
