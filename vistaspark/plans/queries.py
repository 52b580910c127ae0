"""The terrain and gazetteer operators over the supplied tables, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.functions import geo, scores
from vistaspark.operators import gazetteer, raster, regions, search
from vistaspark.plans import fixtures as fx
from vistaspark.plans import camera, imaging, names, offline, panorama, scalars  # noqa: F401
from vistaspark.plans import sensors as readings
from vistaspark.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from vistaspark.streaming import sensors

OBSERVER = (43.35, 42.44)
LAT, LON = (f"{x}e0" for x in OBSERVER)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = [F.lit(x) for x in OBSERVER]
    p = fx.peaks(spark, sf_dir)
    return p.withColumn("d", geo.distance_m(*here, F.col("lat"), F.col("lon"))).withColumn("az", geo.azimuth(*here, F.col("lat"), F.col("lon")))


D = fx.haversine(LAT, LON, "lat", "lon")
AZ = f"atan2(sin(radians(lon - {LON})) * cos(radians(lat)), cos(radians({LAT})) * sin(radians(lat)) - sin(radians({LAT})) * cos(radians(lat)) * cos(radians(lon - {LON})))"


@query(f"""WITH {fx.PEAKS}, d AS (SELECT *, {D} AS dist FROM peaks)
SELECT id, name, ele, round(dist, 2) AS distance_m, round(ele * (1 + 0.4e0 * exp(-dist / 40000e0)), 3) AS score
FROM d WHERE ele IS NOT NULL AND dist BETWEEN 1 AND 200000 ORDER BY score DESC, id LIMIT 12""")
def peaks_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scored peaks within 200 km."""
    p = _observed(spark, sf_dir).filter(F.col("ele").isNotNull() & F.col("d").between(1, 200000))
    score = F.round(scores.label_score(F.col("ele"), F.col("d"), F.lit(None).cast("double")), 3)
    return p.select("id", "name", "ele", F.round("d", 2).alias("distance_m"), score.alias("score")).orderBy(F.desc("score"), "id").limit(12)


@query(f"""WITH {fx.PEAKS}, d AS (SELECT *, {D} AS dist, {AZ} AS a FROM peaks)
SELECT id, round(dist, 2) AS distance_m, round(CASE WHEN a < 0 THEN a + {2 * math.pi!r} ELSE a END, 6) AS azimuth,
       round(dist * dist * (1 - 0.13e0) / (2 * 6371000e0), 3) AS drop_m,
       round(atan2(coalesce(ele, 0) - 1000e0 - dist * dist * (1 - 0.13e0) / (2 * 6371000e0), dist), 6) AS elevation,
       CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS tx,
       CAST(floor((0.5e0 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 1024) AS BIGINT) AS ty,
       round((lon + 180) / 360 * 262144, 3) AS px
FROM d""")
def geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2-G8, G16, G18 for every peak."""
    p = _observed(spark, sf_dir)
    tx, ty = geo.slippy_tile(F.col("lat"), F.col("lon"), 10)
    return p.select(
        "id", F.round("d", 2).alias("distance_m"), F.round("az", 6).alias("azimuth"), F.round(geo.drop_m(F.col("d")), 3).alias("drop_m"),
        F.round(geo.elevation_angle(F.lit(1000.0), F.coalesce("ele", F.lit(0)).cast("double"), F.col("d")), 6).alias("elevation"),
        tx.alias("tx"), ty.alias("ty"), F.round(geo.mercator(F.col("lat"), F.col("lon"), 10)[0], 3).alias("px"),
    )


@query(f"""WITH {fx.PEAKS}, d AS (SELECT id, radians(lat) AS p, radians(lon) AS l, (id % 360) * pi() / 180 AS az, (1000e0 + id * 37 % 150000) / 6371000e0 AS r FROM peaks),
e AS (SELECT *, sin(p) * cos(r) + cos(p) * sin(r) * cos(az) AS s FROM d)
SELECT id, round(degrees(asin(s)), 6) AS lat, round(degrees(l + atan2(sin(az) * sin(r) * cos(p), cos(r) - sin(p) * s)), 6) AS lon FROM e""")
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point along a bearing from every peak."""
    p = fx.peaks(spark, sf_dir)
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.radians((F.col("id") % 360).cast("double")), F.lit(1000.0) + F.col("id") * 37 % 150000)
    return p.select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


ISO = f"""{fx.PEAKS}, m AS (SELECT avg(lat) AS ml FROM peaks),
q AS (SELECT p.*, coalesce(ele, 0) AS h, lon * 111320e0 * cos(radians(ml)) AS x, lat * 111320e0 AS y FROM peaks p, m),
iso AS (SELECT a.*, (SELECT least(sqrt(min((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))), 36000e0) FROM q b
        WHERE b.ele IS NOT NULL AND (b.h > a.h OR (b.h = a.h AND b.id < a.id))) AS near FROM q a),
isolated AS (SELECT *, coalesce(near, 36000e0) AS iso_m FROM iso)"""


@query(f"WITH {ISO} SELECT id, name, ele, round(iso_m, 2) AS iso_m, round({fx.weight('iso_m')}, 5) AS weight FROM isolated")
def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest higher peak."""
    p = gazetteer.isolation(fx.peaks(spark, sf_dir))
    return p.select("id", "name", "ele", F.round("iso_m", 2).alias("iso_m"), F.round(scores.isolation_weight(F.col("iso_m")), 5).alias("weight"))


@query(f"""WITH {ISO}, s AS (SELECT *, round(coalesce(ele, 0) * {fx.weight('iso_m')} * CASE WHEN wikidata IS NOT NULL THEN 1.35e0 ELSE 1e0 END, 6) AS sc FROM isolated),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY sc DESC, id) AS rank FROM s)
SELECT region, CAST(rank AS INT) AS rank, id, name, round(sc, 3) AS score FROM r WHERE rank <= 400 AND name IS NOT NULL""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best peaks of each region."""
    p = gazetteer.search_index(gazetteer.isolation(fx.peaks(spark, sf_dir)))
    return p.select("region", "rank", "id", "name", F.round("score", 3).alias("score"))


@query(f"""WITH {ISO}, s AS (SELECT *, round(coalesce(ele, 0) * 1.4e0 * {fx.weight('iso_m')}, 6) AS score, coalesce(trim(name), '') IN ('', '—') AS blank FROM isolated),
r AS (SELECT *, row_number() OVER (PARTITION BY name, blank ORDER BY score DESC, ele DESC NULLS LAST, id) AS n FROM s)
SELECT id, name, ele, round(score, 3) AS score FROM (SELECT * FROM r WHERE blank OR n = 1 ORDER BY score DESC, ele DESC NULLS LAST, id LIMIT 400)""")
def map_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that a map shows, one a name."""
    p = gazetteer.select_for_map(gazetteer.isolation(fx.peaks(spark, sf_dir)), zoom=10)
    return p.select("id", "name", "ele", F.round("score", 3).alias("score"))


NAME = "regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH {fx.PEAKS}, h AS (SELECT *, {NAME} = 'an' AS exact FROM peaks WHERE contains({NAME}, 'an')),
o AS (SELECT *, row_number() OVER (PARTITION BY round(lat, 5), round(lon, 5) ORDER BY exact DESC, id) AS n FROM h),
s AS (SELECT *, round(coalesce(ele, 0) * CASE WHEN exact THEN 2e0 ELSE 1e0 END
      * (1 + 0.5e0 * exp(-sqrt(pow((lat - {LAT}) * 111.32e0, 2) + pow((lon - {LON}) * 111.32e0 * cos(radians({LAT})), 2)) / 500e0)), 4) AS score FROM o WHERE n = 1)
SELECT id, name, exact, round(score, 2) AS score FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 12)""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that contain what was typed."""
    return search.search([fx.peaks(spark, sf_dir)], "An", *OBSERVER).select("id", "name", "exact", F.round("score", 2).alias("score"))


@query(f"WITH {fx.PEAKS}, {fx.REGIONS} SELECT p.id, r.region AS found FROM peaks p JOIN regions r ON {fx.INSIDE}")
def region_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region that holds a peak."""
    boxes = fx.regions(spark, sf_dir).withColumnRenamed("region", "found")
    return regions.containing(fx.peaks(spark, sf_dir), boxes).select("id", "found")


GAP = "CASE WHEN CASE WHEN r.min_lon <= r.max_lon THEN p.lon BETWEEN r.min_lon AND r.max_lon ELSE p.lon >= r.min_lon OR p.lon <= r.max_lon END THEN 0e0 ELSE least((r.min_lon - p.lon + 720e0) % 360e0, (p.lon - r.max_lon + 720e0) % 360e0) END"


@query(f"""WITH {fx.PEAKS}, {fx.REGIONS}, c AS (
  SELECT p.id, r.region, r.priority, r.ord, {fx.INSIDE} AS inside,
         round(sqrt(pow(greatest(0e0, r.min_lat - p.lat, p.lat - r.max_lat) * 111320e0, 2) + pow({GAP} * 111320e0 * cos(radians(p.lat)), 2)), 3) AS d
  FROM peaks p, regions r),
o AS (SELECT id, region, row_number() OVER (PARTITION BY id ORDER BY priority, ord) AS n FROM c WHERE inside),
b AS (SELECT id, region, d, row_number() OVER (PARTITION BY id ORDER BY d, priority, ord) AS n FROM c WHERE d <= 200000)
SELECT p.id, coalesce(o.region, b.region) AS region, o.region IS NOT NULL AS inside, CASE WHEN o.region IS NULL THEN b.d END AS distance_m
FROM peaks p LEFT JOIN (SELECT * FROM o WHERE n = 1) o USING (id) LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (id)""")
def region_of_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containing region, else the nearest."""
    return regions.region_of(fx.peaks(spark, sf_dir), fx.regions(spark, sf_dir))


@query(f"WITH {fx.RASTER} SELECT gx // 4 AS gx, gy // 4 AS gy, round(avg(h), 6) AS h FROM raster GROUP BY 1, 2")
def raster_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means without the holes."""
    return raster.downsample(fx.raster(spark, sf_dir), 4).withColumn("h", F.round("h", 6))


@query(f"WITH {fx.RASTER}, q AS (SELECT gx, gy, CAST(round_even(h / 4e0, 0) AS INT) AS q FROM raster) SELECT gx, gy, q, q - lag(q, 1, 0) OVER (PARTITION BY gy ORDER BY gx) AS delta FROM q")
def raster_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised heights and their differences along the row."""
    return raster.row_deltas(raster.quantise(fx.raster(spark, sf_dir), 4.0)).select("gx", "gy", "q", "delta")


@query(f"""WITH {fx.RASTER} SELECT gx // 64 AS tx, gy // 64 AS ty, round(quantile_cont(h, 0.005), 4) AS low, round(quantile_cont(h, 0.995), 4) AS high,
round(avg(h), 4) AS mean, round(quantile_cont(h, 0.995) - quantile_cont(h, 0.005), 4) AS relief FROM raster GROUP BY 1, 2""")
def raster_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles and relief of tiles."""
    r = raster.relief_stats(fx.raster(spark, sf_dir), 64)
    return r.select("tx", "ty", *[F.round(c, 4).alias(c) for c in ("low", "high", "mean", "relief")])


@query("""WITH cells AS (SELECT o_custkey AS cell, round((max(o_totalprice) - min(o_totalprice)) / 1e2, 4) AS relief, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, CAST(CASE WHEN o_custkey % 10 = 0 THEN 9 ELSE 1 + o_custkey % 4 END AS INT) AS priority FROM orders GROUP BY o_custkey),
k AS (SELECT * FROM cells WHERE relief * CASE priority WHEN 1 THEN 4e0 WHEN 2 THEN 3e0 WHEN 3 THEN 2e0 WHEN 4 THEN 1.5e0 ELSE 1e0 END >= 3000),
u AS (SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY priority, relief DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM k)
SELECT cell, priority, relief, bytes, used FROM u WHERE used < 300000000""")
def cells_in_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by priority and relief under a byte budget."""
    o = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell"))
    cells = o.agg(F.round((F.max("o_totalprice") - F.min("o_totalprice")) / F.lit(1e2), 4).alias("relief"), F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"))
    cells = cells.withColumn("priority", F.when(F.col("cell") % 10 == 0, 9).otherwise(1 + F.col("cell") % 4).cast("int"))
    return raster.select_cells(cells, 3000.0, 300_000_000).select("cell", "priority", "relief", "bytes", "used")


def _sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", (F.col("value") * F.lit(7.3) % 360).alias("azimuth_deg"))


@query("""WITH g AS (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS device, CAST(sum(opens) AS BIGINT) AS visits, count(*) AS events FROM g GROUP BY user_id""")
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: sessions with a 30-minute gap."""
    return sensors.visits(_sensors(spark, sf_dir))


@query(f"""WITH a AS (SELECT event_id, user_id, ts, radians((value * 7.3e0) % 360) AS r FROM events),
m AS (SELECT event_id, atan2(avg(sin(r)) OVER w, avg(cos(r)) OVER w) AS m FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN m < 0 THEN m + {2 * math.pi!r} ELSE m END, 4) AS mean_rad FROM m""")
def mean_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G26, ST2: circular mean of the last five samples."""
    return sensors.circular_mean_of_five(_sensors(spark, sf_dir)).select("event_id", F.round("mean_rad", 4).alias("mean_rad"))


@query("SELECT conv_id AS channel, max(turn) AS request, arg_max(length(text), turn) AS payload FROM conversations GROUP BY conv_id")
def latest_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8, ST9: the newest request of each channel."""
    rows = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel"), F.col("turn").alias("request"), F.length("text").cast("long").alias("payload"))
    return sensors.latest_request(rows)


@query("""SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS start_us, event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST15: tumbling windows."""
    w = sensors.windowed_counts(_sensors(spark, sf_dir))
    return w.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", F.round("mean_value", 4).alias("mean_value"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address without query and fragment."""
    return fx.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))


@query(f"""WITH {fx.REGIONS}, s AS (SELECT ord, min_lat, max_lat, unnest(CASE WHEN min_lon <= max_lon THEN [{{'lo': min_lon, 'hi': max_lon}}] ELSE [{{'lo': min_lon, 'hi': 180e0}}, {{'lo': -180e0, 'hi': max_lon}}] END) AS p FROM regions),
x AS (SELECT ord, min_lat, max_lat, unnest(range(CAST(floor((p.lo + 180) / 0.5e0) AS BIGINT), CAST(ceil((p.hi + 180) / 0.5e0) AS BIGINT))) AS tx FROM s)
SELECT DISTINCT ord, tx, unnest(range(CAST(floor((90 - max_lat) / 0.5e0) AS BIGINT), CAST(ceil((90 - min_lat) / 0.5e0) AS BIGINT))) AS ty FROM x""")
def planned_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile keys of every region."""
    return raster.tile_keys(fx.regions(spark, sf_dir), 0.5)


QUERIES.update(readings.WITHOUT_SQL)
