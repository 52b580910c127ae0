"""Names, search and the gazetteer's making over the supplied tables, each query with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.functions import scripts, text
from vistaspark.operators import etl, search
from vistaspark.operators.dealing import spread
from vistaspark.plans import fixtures as fx
from vistaspark.plans.registry import query
from vistaspark.sources import gazetteer as files

MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.LATIN.items()) + "}"
BLOCKS = {k: "[" + re.sub(r"\\u(\w{4})", r"\\x{\1}", v) + "]" for k, v in text.SCRIPTS.items()}
READ = "MAP {" + ", ".join(f"'{k}': '{v.capitalize()}'" for k, v in scripts.CHINESE.items()) + "}"
HANGUL = " || ".join(f"[{', '.join(repr(x) for x in letters)}][CAST(floor({place}) AS INT) + 1]" for letters, place in ((scripts.INITIALS, "(ord(c) - 44032) / 588"), (scripts.MEDIALS, "(ord(c) - 44032) % 588 / 28"), (scripts.FINALS, "(ord(c) - 44032) % 28")))


def _latin(name: str) -> str:
    """Each letter in its Latin spelling."""
    spelled = f"array_to_string(list_transform(string_split({name}, ''), lambda c: CASE WHEN ord(c) BETWEEN 44032 AND 55203 THEN {HANGUL} ELSE coalesce({MAP}[lower(c)], {MAP}[c], {READ}[c], c) END), '')"
    return f"CASE WHEN regexp_matches({name}, '{BLOCKS['chinese']}') THEN regexp_replace({spelled}, '([a-z])([A-Z])', '\\1 \\2', 'g') ELSE {spelled} END"


def _capitals(name: str) -> str:
    chars = f"string_split({name}, '')"
    return f"array_to_string(list_transform({chars}, lambda c, i: CASE WHEN i = 1 OR contains(' -–—(', {chars}[i - 1]) THEN upper(c) ELSE c END), '')"


def _norm(name: str) -> str:
    return f"regexp_replace(lower({_latin(name)}), '[^a-z0-9]+', '', 'g')"


FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(name, '{b}') THEN '{s}' END" for s, b in BLOCKS.items()) + "], lambda s: s IS NOT NULL)"


@query(f"""WITH {fx.NAMED}, s AS (SELECT *, {FOUND} AS found FROM named WHERE name IS NOT NULL)
SELECT id, CASE len(found) WHEN 0 THEN 'latin' WHEN 1 THEN found[1] ELSE 'mixed' END AS script, {_capitals(_latin("name"))} AS latin, {_norm("name")} AS normalised,
  regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS plain, regexp_matches(name, '{BLOCKS["cyrillic"]}') AS cyrillic,
  trim(substr(trim(regexp_replace({_capitals(_latin("name"))}.lower(), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40)) AS slug,
  least(coalesce(len(list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')), 0), 9) AS words,
  CASE WHEN length(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) < 5 THEN 0 WHEN length(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) <= 8 THEN 1 ELSE 2 END AS budget,
  CASE WHEN name_en IS NOT NULL THEN name_en WHEN len(found) = 0 THEN name ELSE {_capitals(_latin("name"))} END AS shown FROM s""")
def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts and spellings of names."""
    n = F.col("name")
    words = F.size(text.forms(n))
    return spread(fx.named_peaks(spark, sf_dir).filter("name IS NOT NULL"), "id").select(
        "id", text.script(n).alias("script"), text.to_latin(n).alias("latin"), text.normalised(n).alias("normalised"), text.plain(n).alias("plain"), text.is_cyrillic(n).alias("cyrillic"),
        text.slug(text.to_latin(n)).alias("slug"), F.when(text.plain(n) == "", 0).when(words > 1, words - 1).otherwise(1).cast("bigint").alias("words"), text.typo_budget(F.length(text.plain(n))).alias("budget"),
        text.peak_name(n, F.col("name_ru"), F.col("name_en"), "en").alias("shown"),
    )


@query(f"""WITH {fx.NAMED}, t AS (SELECT *, 1000.37e0 + id * 977 % 30000 AS d FROM named)
SELECT id, concat_ws(' · ', coalesce(name_en, name, '—'), CASE WHEN ele IS NOT NULL THEN ele || ' m' END, CASE WHEN d < 10000 THEN printf('%.1f', d / 1000) ELSE printf('%.0f', d / 1000) END || ' km') AS label,
  printf('%.5f,%.5f', lat, lon) AS hit_key, concat_ws('/', id % 3, id % 100, id % 77) AS tile_key, CASE WHEN id % 4 = 0 THEN '' ELSE 'hi' || id % 4 || '/' END AS prefix,
  coalesce(MAP {{'a': 'first', 'b': 'second'}}[substr('abcd', CAST(id % 4 + 1 AS INT), 1)], substr('abcd', CAST(id % 4 + 1 AS INT), 1)) AS looked_up,
  coalesce(name_en, name, name_ru, '') AS title, 'view-peak-' || id % 5 || '-2026-01-02-030405' || CASE WHEN row_number() OVER (PARTITION BY id % 5 ORDER BY id) > 1 THEN '-' || row_number() OVER (PARTITION BY id % 5 ORDER BY id) ELSE '' END || '.png' AS photo,
  array_to_string([CASE WHEN name IS NOT NULL THEN name END, regexp_replace(printf('%.5f', abs(lat - 43)), '\\.?0+$', '') || CASE WHEN round(lat - 43, 5) >= 0 THEN '°N' ELSE '°S' END, regexp_replace(printf('%.5f', abs(lon)), '\\.?0+$', '') || '°E', CAST(floor(d + 0.5) AS BIGINT) || ' m'], ';') AS caption FROM t""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, keys, file names and captions."""
    from pyspark.sql import Window

    k, d = F.col("id"), 1000.37 + F.col("id") * 977 % 30000
    url = F.when(k % 4 == 0, "https://h/dem/global/").otherwise(F.concat(F.lit("https://h/dem/hi"), (k % 4).cast("string")))
    table = F.create_map(F.lit("a"), F.lit("first"), F.lit("b"), F.lit("second"))
    nth = F.row_number().over(Window.partitionBy(k % 5).orderBy("id"))
    photo = text.photo_filename(F.concat(F.lit("Peak "), (k % 5).cast("string")), F.lit(None).cast("string"), F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    return fx.named_peaks(spark, sf_dir).select(
        "id", text.label_parts(F.coalesce("name_en", "name", F.lit(text.BLANK)), F.col("ele"), d).alias("label"), text.hit_key(F.col("lat"), F.col("lon")).alias("hit_key"),
        text.tile_key(k % 3, k % 100, k % 77).alias("tile_key"), text.store_prefix(url).alias("prefix"), text.lookup(table, F.substring(F.lit("abcd"), (k % 4 + 1).cast("int"), F.lit(1))).alias("looked_up"),
        text.in_locale(F.col("name_ru"), F.col("name_en"), "en", F.col("name")).alias("title"), text.numbered(photo, nth).alias("photo"),
        F.array_join(text.caption_parts(F.col("name"), F.col("lat") - 43, F.col("lon"), d), ";").alias("caption"),
    )


def _merged(hits: str, lat: str = "43.35e0", lon: str = "42.44e0") -> str:
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY printf('%.5f,%.5f', lat, lon) ORDER BY exact DESC, typos, source, id) AS n,
  min(source * 1000000 + id) OVER (PARTITION BY printf('%.5f,%.5f', lat, lon)) AS arrived FROM {hits}),
s AS (SELECT *, round(coalesce(ele, 0) * CASE WHEN exact THEN 2e0 ELSE 1e0 END / pow(2, typos) * (1 + 0.5e0 * exp(-sqrt(pow((lat - {lat}) * 111.32e0, 2) + pow((lon - {lon}) * 111.32e0 * cos(radians({lat})), 2)) / 500e0)), 4) AS score FROM o WHERE n = 1)
SELECT id, source, exact, typos, round(score, 2) AS score FROM (SELECT * FROM s ORDER BY score DESC, arrived LIMIT 12)"""


SOURCES = f"{fx.NAMED}, sources AS (SELECT *, CAST(0 AS INT) AS source FROM named WHERE id % 3 < 2 UNION ALL SELECT *, CAST(1 AS INT) AS source FROM named WHERE id % 3 > 0), n AS (SELECT *, list_filter([{_norm('name')}, {_norm('name_ru')}, {_norm('name_en')}], lambda x: x IS NOT NULL AND x <> '') AS norms FROM sources)"


def _found(spark: SparkSession, sf_dir: str, typed: str) -> DataFrame:
    p = fx.named_peaks(spark, sf_dir)
    return search.search([p.filter("id % 3 < 2"), p.filter("id % 3 > 0")], typed, 43.35, 42.44).select("id", "source", "exact", "typos", F.round("score", 2).alias("score"))


@query(f"WITH {SOURCES}, hits AS (SELECT *, list_contains(norms, 'kazbek') AS exact, CAST(0 AS INT) AS typos FROM n WHERE len(list_filter(norms, lambda x: contains(x, 'kazbek'))) > 0), {_merged('hits')}")
def search_any_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name typed in Cyrillic over two sources."""
    return _found(spark, sf_dir, "Казбек")


def _forms(cut: str, spell) -> str:
    one = lambda name: f"list_filter(regexp_split_to_array(lower({spell(name)}), '{cut}'), lambda w: w <> '')"
    both = lambda name: f"list_concat([array_to_string({one(name)}, '')], CASE WHEN len({one(name)}) > 1 THEN {one(name)} ELSE [] END)"
    return "list_concat(" + ", ".join(f"CASE WHEN {n} IS NULL THEN [] ELSE {both(n)} END" for n in ("name", "name_ru", "name_en")) + ")"


@query(f"""WITH {SOURCES}, f AS (SELECT *, {_forms('[^a-z0-9]+', _latin)} AS latin, {_forms('[^\\p{L}\\p{N}]+', lambda x: x)} AS plain FROM n),
d AS (SELECT *, CAST(least(coalesce(list_min(list_transform(list_filter(latin, lambda w: w <> ''), lambda w: damerau_levenshtein(w, 'elburs'))), 9), coalesce(list_min(list_transform(list_filter(plain, lambda w: w <> ''), lambda w: damerau_levenshtein(w, 'эльбурс'))), 9)) AS INT) AS typos
  FROM f WHERE len(list_filter(plain, lambda w: w <> '' AND length(w) <= 8)) > 0),
hits AS (SELECT *, false AS exact FROM d WHERE typos <= 1), {_merged('hits')}""")
def search_with_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two letters that changed places."""
    return _found(spark, sf_dir, "Эльбурс")


NODES = f"""{fx.NAMED}, nodes AS (SELECT id, region, lat, lon, CASE id % 5 WHEN 0 THEN 'volcano' WHEN 4 THEN 'tree' ELSE 'peak' END AS "natural", nullif(name, '') AS name, nullif(name_ru, '') AS name_ru, nullif(name_en, '') AS name_en,
  CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN printf('%d m', 500 + id) WHEN 2 THEN printf('1,%03d', id % 1000) WHEN 3 THEN 'high' WHEN 4 THEN printf('%.1f', id + 0.5e0) ELSE printf('%d', id) END AS ele, wikidata FROM named),
heights AS (SELECT *, CASE id % 6 WHEN 1 THEN 500 + id WHEN 2 THEN 1000 + id % 1000 WHEN 4 THEN round_even(id + 0.5e0, 0) WHEN 5 THEN id END AS metres, coalesce(name_ru, name, name_en) AS picked FROM nodes WHERE "natural" <> 'tree')"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    natural = F.when(k % 5 == 0, "volcano").when(k % 5 == 4, "tree").otherwise("peak")
    ele = F.when(k % 6 == 1, F.format_string("%d m", 500 + k)).when(k % 6 == 2, F.format_string("1,%03d", k % 1000)).when(k % 6 == 3, "high").when(k % 6 == 4, F.format_string("%.1f", k + F.lit(0.5))).when(k % 6 == 5, k.cast("string"))
    pairs = {"natural": natural, "name": F.col("name"), "name:ru": F.col("name_ru"), "name:en": F.col("name_en"), "ele": ele, "wikidata": F.col("wikidata"), "source": F.lit("survey")}
    tags = F.map_filter(F.create_map(*[x for key, value in pairs.items() for x in (F.lit(key), value)]), lambda key, value: value.isNotNull())
    return fx.named_peaks(spark, sf_dir).select("id", "region", "lat", "lon", tags.alias("tags"))


@query(f"""WITH {NODES} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, picked AS name, nullif(name_ru, '') AS name_ru, nullif(name_en, '') AS name_en, CAST(metres AS INT) AS ele, wikidata, "natural" = 'volcano' AS volcano,
  nullif(nullif(name_en, picked), '') AS other_en FROM heights WHERE picked IS NOT NULL""")
def peaks_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map nodes as peaks."""
    p = etl.peaks_of(_nodes(spark, sf_dir))
    return p.select("id", "lat", "lon", "name", "name_ru", "name_en", "ele", "wikidata", "volcano", files.other_spelling(F.col("name_en"), F.col("name")).alias("other_en"))


@query(f"""WITH {NODES}, b AS (SELECT *, lon BETWEEN 40.5 AND 43.5 AND lat BETWEEN 41.5 AND 43.5 AS inside FROM heights)
SELECT region, count(*) AS peaks, count(*) FILTER (NOT inside) AS outside, count(*) FILTER (inside AND picked IS NULL) AS no_name, count(*) FILTER (inside AND picked IS NOT NULL AND metres IS NULL) AS no_ele,
  count(*) FILTER (inside AND picked IS NOT NULL AND "natural" = 'volcano') AS volcanoes, count(*) FILTER (inside AND picked IS NOT NULL) AS written FROM b GROUP BY region""")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the nodes, added up by region."""
    return etl.counts(_nodes(spark, sf_dir), (40.5, 41.5, 43.5, 43.5), ["region"])


CELLS = "cells AS (SELECT DISTINCT CAST(39 + o_custkey % 8 AS INT) AS lon, CAST(40 + o_custkey // 8 % 6 AS INT) AS lat FROM orders)"


@query(f"""WITH {fx.REGIONS}, {CELLS}, s AS (SELECT priority, min_lat, max_lat, unnest(CASE WHEN min_lon <= max_lon THEN [{{'lo': min_lon, 'hi': max_lon}}] ELSE [{{'lo': min_lon, 'hi': 180e0}}, {{'lo': -180e0, 'hi': max_lon}}] END) AS p FROM regions),
j AS (SELECT c.lat, c.lon, min(s.priority) AS priority FROM cells c LEFT JOIN s ON s.p.lo < c.lon + 1 AND s.p.hi > c.lon AND s.min_lat < c.lat + 1 AND s.max_lat > c.lat GROUP BY c.lat, c.lon)
SELECT lat, lon, coalesce(priority, 4) AS priority, coalesce(priority, 4) IN (1, 2) AS wanted FROM j""")
def cell_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best priority of the regions over each cell."""
    k = F.col("o_custkey")
    cells = fx.table(spark, sf_dir, "orders").select((39 + k % 8).cast("int").alias("lon"), (40 + F.floor(k / 8) % 6).cast("int").alias("lat")).distinct()
    ranked = etl.cell_priorities(cells, fx.regions(spark, sf_dir), 4)
    wanted = etl.wanted_cells(ranked, priorities=[1, 2]).select("lat", "lon", F.lit(True).alias("wanted"))
    return ranked.join(wanted, ["lat", "lon"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))


@query("""WITH u AS (SELECT c_custkey AS id, c_custkey % 200 - 100 AS lat, c_custkey * 3 % 400 - 200 AS lon, c_custkey % 7 = 0 AS broken FROM customer)
SELECT id, CASE WHEN NOT broken AND abs(lat) <= 90 AND abs(lon) <= 180 THEN CAST(lat AS DOUBLE) END AS lat, CASE WHEN NOT broken AND abs(lat) <= 90 AND abs(lon) <= 180 THEN CAST(lon AS DOUBLE) END AS lon,
  CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END * CAST(id % 80 AS INT) AS cell_lat, CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END * CAST(id % 170 AS INT) AS cell_lon,
  CASE WHEN id % 5 = 0 THEN 'a' WHEN id % 5 IN (1, 2) THEN 'b' WHEN id % 5 = 3 THEN 'c' END AS source FROM u""")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in addresses and file names, and the source that answers."""
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://h/?lat="), F.when(k % 7 == 0, "x").otherwise((k % 200 - 100).cast("string")), F.lit("&lon="), (k * 3 % 400 - 200).cast("string"))
    name = F.format_string("Copernicus_DSM_30_%s%02d_00_%s%03d_00_DEM.tif", F.when(k % 2 == 0, "S").otherwise("N"), k % 80, F.when(k % 3 == 0, "W").otherwise("E"), k % 170)
    lat, lon = files.url_position(url)
    cell_lat, cell_lon = files.cell_of_filename(name)
    rows = fx.table(spark, sf_dir, "customer").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"), cell_lat.alias("cell_lat"), cell_lon.alias("cell_lon"))
    option = lambda rank, url, online, cached: F.struct(F.lit(rank).alias("rank"), F.lit(url).alias("url"), online.alias("online"), cached.alias("cached"))
    m, no = F.col("id") % 5, F.lit(False)
    options = F.array(option(0, "a", m == 0, no), option(1, "b", m == 1, m == 2), option(2, "c", m != 4, no))
    candidates = rows.select(F.col("id").alias("place"), F.explode(options).alias("o")).select("place", "o.*")
    picked = files.pick_source(candidates).withColumnRenamed("url", "source")
    return rows.join(picked, F.col("id") == F.col("place"), "left").drop("place")
