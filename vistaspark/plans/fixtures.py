"""The supplied tables seen as peaks, regions, sensors and rasters, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.operators.raster import downsample
from vistaspark.operators.sampling import Level, Pyramid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").withColumn("part", k % 200)
    rows = rows.join(part, F.col("part") == F.col("p_partkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        k.alias("id"),
        (41 + (k * 7919 % 30000) / F.lit(1e4)).alias("lat"),
        (40 + (k * 10429 % 40000) / F.lit(1e4)).alias("lon"),
        F.when(k % 11 != 0, 500 + k * 613 % 5000).cast("int").alias("ele"),
        F.col("p_name").alias("name"),
        F.col("n_name").alias("region"),
        F.when(k % 7 == 0, F.concat(F.lit("Q"), k.cast("string"))).alias("wikidata"),
        (k % 13 == 0).alias("volcano"),
    )


PEAKS = """peaks AS (
  SELECT c_custkey AS id, 41 + ((c_custkey * 7919) % 30000) / 1e4 AS lat, 40 + ((c_custkey * 10429) % 40000) / 1e4 AS lon,
         CASE WHEN c_custkey % 11 <> 0 THEN CAST(500 + (c_custkey * 613) % 5000 AS INT) END AS ele, p_name AS name, n_name AS region,
         CASE WHEN c_custkey % 7 = 0 THEN 'Q' || c_custkey END AS wikidata, c_custkey % 13 = 0 AS volcano
  FROM customer LEFT JOIN part ON p_partkey = c_custkey % 200 JOIN nation ON n_nationkey = c_nationkey
)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    last = k == 24
    low = F.lit(39.8) + (k % 5) * F.lit(0.8)
    south = F.lit(40.9) + F.floor(k / 5) * F.lit(0.6)
    return table(spark, sf_dir, "nation").select(
        k.cast("int").alias("ord"),
        F.col("n_name").alias("region"),
        F.when(last, 179.0).otherwise(low).alias("min_lon"),
        F.when(last, -179.0).otherwise(low + F.lit(1.2)).alias("max_lon"),
        south.alias("min_lat"),
        (south + F.lit(1.0)).alias("max_lat"),
        (1 + k % 4).cast("int").alias("priority"),
    )


REGIONS = """regions AS (
  SELECT CAST(n_nationkey AS INT) AS ord, n_name AS region,
         CASE WHEN n_nationkey = 24 THEN 179e0 ELSE 39.8e0 + (n_nationkey % 5) * 0.8e0 END AS min_lon,
         CASE WHEN n_nationkey = 24 THEN -179e0 ELSE 39.8e0 + (n_nationkey % 5) * 0.8e0 + 1.2e0 END AS max_lon,
         40.9e0 + (n_nationkey // 5) * 0.6e0 AS min_lat, 40.9e0 + (n_nationkey // 5) * 0.6e0 + 1e0 AS max_lat,
         CAST(1 + n_nationkey % 4 AS INT) AS priority
  FROM nation
)"""
INSIDE = "p.lat BETWEEN r.min_lat AND r.max_lat AND CASE WHEN r.min_lon <= r.max_lon THEN p.lon BETWEEN r.min_lon AND r.max_lon ELSE p.lon >= r.min_lon OR p.lon <= r.max_lon END"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def weight(iso: str) -> str:
    return f"(CASE WHEN {iso} IS NULL THEN 1e0 ELSE 0.55e0 + 0.45e0 * least(1e0, greatest(0e0, ln(greatest({iso}, 1e0) / 300e0) / ln(100e0))) END)"


#: Spellings that the fixtures give to peaks in turn: (name, name_ru, name_en).
SPELLINGS = (
    ("Эльбрус", None, "Elbrus"), ("მყინვარწვერი - Казбек", "Казбек", "Kazbek"), ("Ушба Южная", None, None), ("Gora Ushba", "Ушба", None), ("Mont Blanc", "Монблан", "Mont Blanc"),
    ("Шхара", "Шхара", "Shkhara"), ("Schesaplana", None, None), ("Щуровского пик", None, ""), ("თეთნულდი", None, "Tetnuldi"), ("Kazbek (сопка)", None, None), ("Ağrı Dağı", "Арарат", "Ararat"),
    ("Dent du Géant", None, None), ("富士山", "Фудзи", "Mount Fuji"), ("", None, None), (None, None, None), ("Pic-Ouest — Ёлка", None, None),
    ("Արարատ", None, None), ("Όλυμπος", None, None), ("جبل طوبقال", None, None), ("ཇོ་མོ་གླང་མ", None, None), ("सगरमाथा", None, None), ("ดอยอินทนนท์", None, None), ("ራስ ደጀን", None, None), ("フジ山", None, None), ("백두산", None, None), ("한라산", None, None), ("珠穆朗玛峰", None, None), ("玉龙雪山", None, None), ("ふじ", None, None),
)


def named_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with names in several scripts, and the heights as peaks have them."""
    names = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(row, ("name", "name_ru", "name_en"), strict=True)]) for row in SPELLINGS])
    rows = peaks(spark, sf_dir).withColumn("spelling", F.get(names, (F.col("id") * 7 % len(SPELLINGS)).cast("int"))).drop("name")
    return rows.select("*", "spelling.*").drop("spelling")


def _literal(v) -> str:
    return "NULL" if v is None else "'" + v + "'"


NAMED = f"""{PEAKS}, spellings(k, name, name_ru, name_en) AS (VALUES {", ".join(f"({i}, {', '.join(map(_literal, row))})" for i, row in enumerate(SPELLINGS))}),
named AS (SELECT p.* EXCLUDE (name), s.name, s.name_ru, s.name_en FROM peaks p JOIN spellings s ON s.k = p.id * 7 % {len(SPELLINGS)})"""


# The corner, the cells and the sides of the raster's levels; the slippy map's zooms, coarser by five than usual.
NORTH_WEST, CELL_DEG, SIDE = (45.3529, 40.4371), 1 / 64, 256
ZOOM_SHIFT = 5


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % SIDE).alias("gx"), (F.col("l_partkey") % SIDE).alias("gy"), (F.floor("l_extendedprice").cast("long") % 6000).alias("h"))
    return rows.groupBy("gx", "gy").agg(F.max("h").alias("h"))


def level(spark: SparkSession, sf_dir: str, factor: int) -> Level:
    cells = raster(spark, sf_dir)
    if factor > 1:
        cells = downsample(cells, factor).withColumn("h", F.round("h", 2))
    return Level(cells, CELL_DEG * factor, SIDE // factor, SIDE // factor)


def pyramid(spark: SparkSession, sf_dir: str, factors: tuple[int, ...] = (1, 4, 16)) -> Pyramid:
    lat, lon = NORTH_WEST
    return Pyramid(lon, lat, lon + SIDE * CELL_DEG, lat - SIDE * CELL_DEG, tuple(level(spark, sf_dir, f) for f in factors))


RASTER = """raster AS (SELECT l_orderkey % 256 AS gx, l_partkey % 256 AS gy, max(CAST(floor(l_extendedprice) AS BIGINT) % 6000) AS h FROM lineitem GROUP BY 1, 2),
raster4 AS (SELECT gx // 4 AS gx, gy // 4 AS gy, round(avg(h), 2) AS h FROM raster GROUP BY 1, 2), raster16 AS (SELECT gx // 16 AS gx, gy // 16 AS gy, round(avg(h), 2) AS h FROM raster GROUP BY 1, 2)"""


def sampled_sql(name: str, points: str, rest: str = "") -> str:
    """CTEs that end in ``name``: ``points`` (lat, lon) with h0, h1, h2, the heights at the three levels, and h, the first of them."""
    out, last = [], points
    for i, f in enumerate((1, 4, 16)):
        raster, deg, side, now = f"raster{'' if f == 1 else f}", f"{f / 64!r}e0", 256 // f, f"{name}_{i}"
        out.append(f"""{now}_at AS (SELECT *, (lon - 40.4371e0) / {deg} AS x, (45.3529e0 - lat) / {deg} AS y FROM {last}),
{now} AS (SELECT p.* EXCLUDE (x, y), CASE WHEN x >= 0 AND y >= 0 AND x < {side - 1} AND y < {side - 1} THEN a.h + (b.h - a.h) * (x - floor(x)) + (c.h + (d.h - c.h) * (x - floor(x)) - (a.h + (b.h - a.h) * (x - floor(x)))) * (y - floor(y)) END AS h{i}
FROM {now}_at p LEFT JOIN {raster} a ON a.gx = CAST(floor(x) AS BIGINT) AND a.gy = CAST(floor(y) AS BIGINT) LEFT JOIN {raster} b ON b.gx = CAST(floor(x) AS BIGINT) + 1 AND b.gy = CAST(floor(y) AS BIGINT)
LEFT JOIN {raster} c ON c.gx = CAST(floor(x) AS BIGINT) AND c.gy = CAST(floor(y) AS BIGINT) + 1 LEFT JOIN {raster} d ON d.gx = CAST(floor(x) AS BIGINT) + 1 AND d.gy = CAST(floor(y) AS BIGINT) + 1)""")
        last = now
    return ",\n".join([*out, f"{name} AS (SELECT *, coalesce(h0, h1, h2) AS h FROM {last})"])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (z, gx, gy, r, g, b) of a sparse slippy map over the same box."""
    k, lat, lon = F.col("o_orderkey"), *NORTH_WEST
    z = 4 + k % 4
    size = F.pow(F.lit(2.0), z) * 256
    x0, y0 = F.floor((lon + 180) / 360 * size), F.floor((1 - F.log(F.tan(F.radians(F.lit(lat))) + 1 / F.cos(F.radians(F.lit(lat)))) / F.pi()) / 2 * size)
    place = lambda step, n: k * step % F.ceil(size * n)
    rows = table(spark, sf_dir, "orders").select(z.alias("z"), (x0 + place(7919, 1 / 90)).alias("gx"), (y0 + place(104729, 1 / 64)).alias("gy"), (128 + k % 12).alias("r"), (k * 7 % 256).alias("g"), (k * 13 % 256).alias("b"))
    return rows.groupBy("z", "gx", "gy").agg(F.max(F.struct("r", "g", "b")).alias("p")).select("z", "gx", "gy", "p.*")


PIXELS = """pixel_rows AS (SELECT o_orderkey AS k, CAST(4 + o_orderkey % 4 AS BIGINT) AS z, pow(2, 4 + o_orderkey % 4) * 256 AS size FROM orders),
pixel_all AS (SELECT z, CAST(floor((40.4371e0 + 180) / 360 * size) AS BIGINT) + k * 7919 % CAST(ceil(size / 90) AS BIGINT) AS gx,
  CAST(floor((1 - ln(tan(radians(45.3529e0)) + 1 / cos(radians(45.3529e0))) / pi()) / 2 * size) AS BIGINT) + k * 104729 % CAST(ceil(size / 64) AS BIGINT) AS gy, 128 + k % 12 AS r, k * 7 % 256 AS g, k * 13 % 256 AS b FROM pixel_rows),
pixels AS (SELECT z, gx, gy, p.r * 256 + p.g + p.b / 256e0 - 32768 AS h FROM (SELECT z, gx, gy, max({'r': r, 'g': g, 'b': b}) AS p FROM pixel_all GROUP BY 1, 2, 3))"""
