"""Readers and writers of gazetteer files (survey S3-S5, S7, S14-S17, S19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PEAK = "lat double, lon double, name string, name_ru string, name_en string, ele int, wikidata string, volcano boolean"
REGION = "title string, title_ru string, title_en string, core_ru string, core_en string, bbox array<double>, priority int, `group` string"
#: The keys of a positional row of the search index.
INDEX_ROW = ("name", "lat", "lon", "ele", "region", "name_en", "name_ru")


def read_peak_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: one peak a line; lines without a name are left out."""
    return spark.read.schema(PEAK).json(path).filter("name <> ''")


def write_region_files(peaks: DataFrame, path: str) -> None:
    """The peaks of each region in a folder of its own, the highest first, absent fields left out."""
    columns = [x.split()[0] for x in PEAK.split(", ") if x.split()[0] in peaks.columns]
    # a region is one file unless it outgrows the limit of rows
    rows = peaks.repartition("region").sortWithinPartitions("region", F.desc(F.coalesce("ele", F.lit(0))))
    rows.select("region", *columns).write.option("ignoreNullFields", "true").option("maxRecordsPerFile", 1_000_000).partitionBy("region").json(path)


def read_region_files(spark: SparkSession, path: str) -> DataFrame:
    """Peaks with their region."""
    return spark.read.schema(PEAK + ", region string").option("basePath", path).json(path)


def read_region_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files with one document {region, generated, peaks: [...]} each."""
    rows = spark.read.schema(f"region string, generated string, peaks array<struct<{', '.join(x.replace(' ', ': ', 1) for x in PEAK.split(', '))}>>").option("multiLine", "true").json(path)
    return rows.select("region", "generated", F.explode("peaks").alias("peak")).select("region", "generated", "peak.*")


def other_spelling(spelling: Column, name: Column) -> Column:
    """a spelling that differs from the name and is not empty."""
    return F.nullif(F.nullif(spelling, name), F.lit(""))


def index_rows(peaks: DataFrame) -> DataFrame:
    """Positional rows as JSON; other spellings stand last, and only if they differ from the name."""
    en, ru = other_spelling(F.col("name_en"), F.col("name")), other_spelling(F.col("name_ru"), F.col("name"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    values = [quoted(F.col("name")), F.round("lat", 5).cast("string"), F.round("lon", 5).cast("string"), F.coalesce(F.col("ele").cast("string"), F.lit("null")), quoted(F.col("region"))]
    more = [F.when(en.isNotNull() | ru.isNotNull(), quoted(F.coalesce(en, F.lit("")))), F.when(ru.isNotNull(), quoted(ru))]
    return peaks.select(F.concat(F.lit("["), F.concat_ws(",", *values, *more), F.lit("]")).alias("value"))


def read_index_rows(rows: DataFrame) -> DataFrame:
    """Peaks of positional rows (value); an empty spelling is none."""
    parts = F.from_json("value", "array<string>")
    at = lambda k: F.nullif(F.get(parts, F.lit(k)), F.lit(""))
    kinds = {"lat": "double", "lon": "double", "ele": "int"}
    return rows.select(*[at(k).cast(kinds.get(n, "string")).alias(n) for k, n in enumerate(INDEX_ROW)])


def cell_of_filename(name: Column) -> tuple[Column, Column]:
    """South-western corner of a height file, from its name's _N43_00_E042_00_DEM; null for other names."""
    part = lambda k: F.regexp_extract(name, r"_([NS])(\d{2})_00_([EW])(\d{3})_00_DEM", k)
    signed = lambda side, value, minus: F.when(part(value) != "", F.when(part(side) == minus, -1).otherwise(1) * part(value).cast("int"))
    return signed(1, 2, "S"), signed(3, 4, "W")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """The registry, one object of regions by key; keys that begin with $ are remarks. ``ord``: place in the file."""
    whole = spark.read.text(path, wholetext=True).select(F.json_object_keys("value").alias("keys"), F.from_json("value", "map<string, string>").alias("all"))
    rows = whole.select(F.posexplode("keys").alias("ord", "region"), "all").filter(~F.col("region").startswith("$"))
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    rows = rows.select("ord", "region", F.from_json(F.col("all")[F.col("region")], REGION).alias("r")).select("ord", "region", "r.*")
    return rows.select("*", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(box)]).drop("bbox")


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """N, m, g, h, gt, ht of a magnetic model's .COF file, without its head and what follows a line of nines."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter((F.size("p") == 6) & ~F.get("p", F.lit(0)).startswith("9999"))
    kinds = {"n": "int", "m": "int"}
    return rows.select(*[F.get("p", F.lit(i)).try_cast(kinds.get(c, "double")).alias(c) for i, c in enumerate(("n", "m", "g", "h", "gt", "ht"))]).filter("n IS NOT NULL")


def url_position(url: Column) -> tuple[Column, Column]:
    """?lat=&lon= of an address where both are numbers in range."""
    number = lambda k: F.try_parse_url(url, F.lit("QUERY"), F.lit(k)).try_cast("double")
    lat, lon = number("lat"), number("lon")
    good = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(good, lat), F.when(good, lon)


def pick_source(candidates: DataFrame, offline_only: bool = False) -> DataFrame:
    """Of each place the first candidate (place, rank, url, online, cached) that answers or is stored."""
    good = F.col("cached") if offline_only else F.col("online") | F.col("cached")
    return candidates.filter(good).groupBy("place").agg(F.min_by("url", "rank").alias("url"))
