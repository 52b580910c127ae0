"""Offline regions over the supplied tables, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.functions import geo
from vistaspark.operators import offline, regions
from vistaspark.plans import fixtures as fx
from vistaspark.plans.registry import query

#: A detail tile exists unless it is one of a few of the cells of a kind.
DETAIL = "detail AS (SELECT tx, ty FROM (SELECT unnest(range(1075, 1125)) AS tx), (SELECT unnest(range(225, 260)) AS ty) WHERE NOT ((tx // 5 * 3 + ty // 5 * 5) % 4 = 0 AND (tx + ty) % 5 = 0))"
PARTS = f"{fx.REGIONS}, s AS (SELECT ord, min_lat, max_lat, unnest(CASE WHEN min_lon <= max_lon THEN [{{'lo': min_lon, 'hi': max_lon}}] ELSE [{{'lo': min_lon, 'hi': 180e0}}, {{'lo': -180e0, 'hi': max_lon}}] END) AS p FROM regions)"


def _keys_sql(lod: int, deg: str, most_x: int, most_y: int) -> str:
    return f"""SELECT DISTINCT ord, CAST({lod} AS INT) AS lod, tx, ty FROM (SELECT ord, tx, unnest(range(CAST(floor((90 - max_lat) / {deg}) AS BIGINT), CAST(ceil((90 - min_lat) / {deg}) AS BIGINT))) AS ty
  FROM (SELECT ord, min_lat, max_lat, unnest(range(CAST(floor((p.lo + 180) / {deg}) AS BIGINT), CAST(ceil((p.hi + 180) / {deg}) AS BIGINT))) AS tx FROM s)) WHERE tx BETWEEN 0 AND {most_x} AND ty BETWEEN 0 AND {most_y}"""


KEYS = f"""{PARTS}, {DETAIL}, base AS ({_keys_sql(0, '0.5e0', 719, 359)} UNION ALL {_keys_sql(1, '2e0', 179, 89)}),
full_cells AS (SELECT tx // 5 AS cx, ty // 5 AS cy FROM detail GROUP BY 1, 2 HAVING count(*) = 25),
kept AS (SELECT * FROM base b WHERE lod > 0 OR NOT EXISTS (SELECT 1 FROM full_cells f WHERE f.cx = b.tx // 2 AND f.cy = b.ty // 2)),
stored AS (SELECT * FROM kept WHERE ord % 3 = 0 OR (ord * 31 + lod * 7 + tx * 13 + ty * 17) % 11 > ord % 5)"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.planned_keys(fx.regions(spark, sf_dir), [offline.Grid(0, 0.5, 720, 360), offline.Grid(1, 2.0, 180, 90)])


def _detail(spark: SparkSession) -> DataFrame:
    tx, ty = F.col("tx"), F.col("ty")
    tiles = spark.range(1075, 1125).select(F.col("id").alias("tx"), F.explode(F.sequence(F.lit(225).cast("long"), F.lit(259).cast("long"))).alias("ty"))
    return tiles.filter(~(((F.floor(tx / 5) * 3 + F.floor(ty / 5) * 5) % 4 == 0) & ((tx + ty) % 5 == 0)))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.without_covered(_planned(spark, sf_dir), _detail(spark))


def _stored(kept: DataFrame) -> DataFrame:
    k = F.col("ord") * 31 + F.col("lod") * 7 + F.col("tx") * 13 + F.col("ty") * 17
    return kept.filter((F.col("ord") % 3 == 0) | (k % 11 > F.col("ord") % 5))


@query(f"WITH {KEYS} SELECT ord, lod, tx, ty, (ord, lod, tx, ty) NOT IN (SELECT (ord, lod, tx, ty) FROM stored) AS lacking FROM kept")
def offline_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of every level that a region needs, less what the detail covers, and which are lacking."""
    kept = _kept(spark, sf_dir)
    lacking = offline.missing(kept, _stored(kept)).withColumn("lacking", F.lit(True))
    return kept.join(lacking, kept.columns, "left").withColumn("lacking", F.coalesce("lacking", F.lit(False)))


@query(f"""WITH {KEYS}, b AS (SELECT ord, CAST(sum(CASE lod WHEN 0 THEN 30900 ELSE 40000 END) AS BIGINT) AS bytes FROM kept GROUP BY ord),
t AS (SELECT k.ord, bool_or(s.ord IS NULL) AS incomplete, count(*) FILTER (k.lod = 0) = 0 OR count(*) FILTER (k.lod = 0 AND s.ord IS NOT NULL) > 0 AS has_detail, count(*) FILTER (s.ord IS NOT NULL) AS done, count(*) FILTER (s.ord IS NULL) AS failed,
  CAST(coalesce(sum(CASE WHEN s.ord IS NOT NULL THEN 1000 + k.tx END), 0) AS BIGINT) AS got FROM kept k LEFT JOIN stored s USING (ord, lod, tx, ty) GROUP BY k.ord),
v AS (SELECT r.ord, CASE r.ord % 4 WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' WHEN 2 THEN '' END AS made, CASE WHEN r.ord % 5 = 0 THEN 'v2' END AS purged, CASE r.ord % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END AS noted, CASE WHEN r.ord % 2 = 0 THEN 'v2' ELSE 'v1' END AS before FROM regions r)
SELECT t.ord, bytes, incomplete, has_detail, done, failed, got, coalesce(CASE WHEN made <> '' THEN made <> 'v2' ELSE purged = 'v2' END, false) AS outdated, noted IS DISTINCT FROM 'v2' AND NOT (noted IS NULL AND before = 'v2') AS purge FROM t JOIN b USING (ord) JOIN v USING (ord)""")
def offline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a region, what it lacks, whether it is outdated or purged, and how its transfers went."""
    kept = _kept(spark, sf_dir)
    stored = _stored(kept)
    weights = spark.createDataFrame([(0, 30_900)], "lod int, avg_bytes long")
    ok = stored.withColumn("ok", F.lit(True))
    transfers = kept.join(ok, kept.columns, "left").select("ord", F.coalesce("ok", F.lit(False)).alias("ok"), (1000 + F.col("tx")).alias("bytes"))
    counts = offline.accounting(transfers).withColumnRenamed("bytes", "got")
    k = F.col("ord")
    made = F.when(k % 4 == 0, "v2").when(k % 4 == 1, "v1").when(k % 4 == 2, "")
    versions = fx.regions(spark, sf_dir).select(
        "ord", offline.is_outdated(made, F.when(k % 5 == 0, "v2"), F.lit("v2")).alias("outdated"),
        offline.purge(F.when(k % 3 == 0, "v1").when(k % 3 == 1, "v2"), F.when(k % 2 == 0, "v2").otherwise("v1"), F.lit("v2")).alias("purge"),
    )
    return offline.bytes_needed(kept, weights).join(offline.state(kept, stored), "ord").join(counts, "ord").join(versions, "ord")


PHI = "radians(least(85.05e0, greatest(-85.05e0, {y})))"


def _row_sql(y: str, n: int) -> str:
    p = PHI.format(y=y)
    return f"(1 - ln(tan({p}) + 1 / cos({p})) / pi()) / 2 * {n}"


def _detail_sql(zoom: int) -> str:
    n = 1 << zoom
    r = "30000e0 / 6371000e0"
    north, south = f"degrees(radians(lat) + {r})", f"degrees(radians(lat) - {r})"
    side = f"degrees(atan2(sin({r}) * cos(radians(lat)), cos({r}) - sin(radians(lat)) * sin(radians(lat)) * cos({r})))"
    wrap = lambda v: f"({v} + 180 - 360 * floor(({v} + 180) / 360))"
    x0, x1 = f"CAST(floor({wrap(f'lon - {side}')} / 360 * {n}) AS BIGINT)", f"CAST(ceil({wrap(f'lon + {side}')} / 360 * {n}) AS BIGINT)"
    return f"""SELECT DISTINCT ord, CAST({zoom} AS INT) AS zoom, (x + {n}) % {n} AS x, y FROM (SELECT ord, x, unnest(range(CAST(floor({_row_sql(north, n)}) AS BIGINT), CAST(ceil({_row_sql(south, n)}) AS BIGINT))) AS y
  FROM (SELECT *, unnest(range({x0}, CASE WHEN {x1} <= {x0} THEN {x1} + {n} ELSE {x1} END)) AS x FROM centres)) WHERE y BETWEEN 0 AND {n - 1}"""


@query(f"""WITH {fx.REGIONS}, centres AS (SELECT ord, (min_lat + max_lat) / 2 AS lat, CASE WHEN max_lon < min_lon THEN -180e0 ELSE (min_lon + max_lon) / 2 END AS lon FROM regions),
k AS ({_detail_sql(12)} UNION ALL {_detail_sql(11)}) SELECT ord, zoom, count(*) AS tiles, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM k GROUP BY 1, 2""")
def detail_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippy tiles about the centres of regions, across the antimeridian too."""
    lat, lon = geo.bbox_centre()
    keys = offline.detail_keys(fx.regions(spark, sf_dir).select("ord", lat.alias("lat"), lon.alias("lon")))
    return keys.groupBy("ord", "zoom").agg(F.count(F.lit(1)).alias("tiles"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


OWN = f"""own AS (SELECT p.id, arg_min(r.region, (r.priority, r.ord)) AS found FROM peaks p JOIN regions r ON {fx.INSIDE} GROUP BY p.id)"""


@query(f"""WITH {fx.PEAKS}, {fx.REGIONS}, {OWN}, c AS (SELECT p.id, p.region AS current, bool_or({fx.INSIDE}) AS holds FROM peaks p JOIN regions r ON r.region = p.region GROUP BY p.id, p.region),
m AS (SELECT id, {fx.haversine('lat', 'lon', 'lag(lat) OVER (PARTITION BY region ORDER BY id)', 'lag(lon) OVER (PARTITION BY region ORDER BY id)')} AS moved FROM peaks)
SELECT c.id, CASE WHEN NOT holds AND found IS DISTINCT FROM current THEN found END AS offered, coalesce(moved >= 500, false) AS refine FROM c LEFT JOIN own USING (id) LEFT JOIN m USING (id)""")
def region_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region to offer at a point that the current one doesn't hold, and whether a move is worth a new view."""
    from pyspark.sql import Window

    p, boxes = fx.peaks(spark, sf_dir), fx.regions(spark, sf_dir)
    found = regions.containing(p, boxes.withColumnRenamed("region", "found")).groupBy("id").agg(F.min_by("found", F.struct("priority", "ord")).alias("found"))
    current = p.join(boxes.drop("ord", "priority"), "region").select("id", "region", geo.in_bbox(F.col("lat"), F.col("lon")).alias("holds"))
    way = Window.partitionBy("region").orderBy("id")  # each region's peaks as the moves of one user
    moved = geo.distance_m(F.col("lat"), F.col("lon"), F.lag("lat").over(way), F.lag("lon").over(way))
    moves = p.select("id", moved.alias("moved"))
    rows = current.join(found, "id", "left").join(moves, "id", "left")
    return rows.select("id", offline.suggestion(F.col("region"), F.col("holds"), F.col("found")).alias("offered"), offline.worth_refining(F.col("moved")).alias("refine"))


@query("""WITH l AS (SELECT s_suppkey % 5 AS source, s_suppkey % 3 AS lod, min(s_suppkey) AS k FROM supplier GROUP BY 1, 2)
SELECT source, string_agg(concat('0.', k % 9 + 1, ':', CASE WHEN k % 2 = 0 THEN k % 4 + 1 ELSE 1 END, ':', CASE WHEN k % 3 = 0 THEN 0 ELSE k * 100 END, ':', k + 10, 'x', k + 20), '|' ORDER BY lod) AS version FROM l GROUP BY source""")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version text of an index."""
    k = F.col("k")
    levels = fx.table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).alias("source"), (F.col("s_suppkey") % 3).alias("lod")).agg(F.min("s_suppkey").alias("k"))
    levels = levels.select(
        "source", "lod", F.concat(F.lit("0."), (k % 9 + 1).cast("string")).alias("cell"), F.when(k % 2 == 0, k % 4 + 1).alias("quant"), F.when(k % 3 != 0, k * 100).alias("avg_bytes"), (k + 10).alias("tiles_x"), (k + 20).alias("tiles_y")
    )
    return offline.index_version(levels)
