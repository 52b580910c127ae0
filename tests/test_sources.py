"""Readers and writers, tiles as bytes, and small operators that have no query."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaspark.functions import geo, text
from vistaspark.operators import etl, magnetism, planning, search, skyline, tiles
from vistaspark.sources import gazetteer as files

PEAKS = [
    ("a", 43.123456, 42.5, "Эльбрус", "Эльбрус", "Elbrus", 5642, "Q1", True),
    ("a", 43.2, 42.6, "Ushba", None, None, None, None, False),
    ("b", -70.0, 179.5, 'Quo"te', "Кавычка", "", 4710, None, False),
]
SCHEMA = "region string, lat double, lon double, name string, name_ru string, name_en string, ele int, wikidata string, volcano boolean"


def test_region_files_there_and_back(spark, tmp_path):
    peaks = spark.createDataFrame(PEAKS, SCHEMA)
    files.write_region_files(peaks, f"{tmp_path}/peaks")
    back = files.read_region_files(spark, f"{tmp_path}/peaks").select(peaks.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, peaks.collect()))
    lines = [x for f in (tmp_path / "peaks" / "region=a").glob("*.json") for x in f.read_text().splitlines()]
    assert [json.loads(x).get("ele") for x in lines] == [5642, None] and "ele" not in json.loads(lines[1])


def test_lines_and_documents(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"name":"A","lat":1,"lon":2}\n{"name":"","lat":1,"lon":2}\n{"lat":3,"lon":4}\n')
    assert [r["name"] for r in files.read_peak_lines(spark, f"{tmp_path}/l.jsonl").collect()] == ["A"]
    (tmp_path / "d.json").write_text(json.dumps({"region": "r", "generated": "now", "peaks": [{"name": "A", "lat": 1.5, "lon": 2, "ele": 7}, {"name": "B", "lat": 1, "lon": 2}]}, indent=1))
    assert [(r["region"], r["name"], r["ele"]) for r in files.read_region_documents(spark, f"{tmp_path}/d.json").collect()] == [("r", "A", 7), ("r", "B", None)]


def test_index_rows_there_and_back(spark):
    rows = files.index_rows(spark.createDataFrame(PEAKS, SCHEMA))
    said = [json.loads(r["value"]) for r in rows.collect()]
    assert said == [["Эльбрус", 43.12346, 42.5, 5642, "a", "Elbrus"], ["Ushba", 43.2, 42.6, None, "a"], ['Quo"te', -70.0, 179.5, 4710, "b", "", "Кавычка"]]
    back = files.read_index_rows(rows).collect()
    assert [(r["name"], r["ele"], r["name_en"], r["name_ru"]) for r in back] == [("Эльбрус", 5642, "Elbrus", None), ("Ushba", None, None, None), ('Quo"te', 4710, None, "Кавычка")]


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"$note": "x", "w": {"title_ru": "В", "bbox": [177.5, 70, -177.5, 72], "priority": 1}, "e": {"title_en": "E", "bbox": [1, 2, 3, 4]}}))
    got = files.read_regions(spark, f"{tmp_path}/r.json").orderBy("ord").collect()
    assert [(r["region"], r["min_lon"], r["max_lon"], r["priority"]) for r in got] == [("w", 177.5, -177.5, 1), ("e", 1.0, 3.0, None)]


def test_declination_of_known_places(spark, tmp_path):
    (tmp_path / "m.COF").write_text("    2025.0            WMM-2025     11/13/2024\n  1  0  -29351.8       0.0       12.0        0.0\n  1  1   -1410.8    4545.4        9.7      -21.5\n" + "9" * 48 + "\n")
    rows = files.read_coefficients(spark, f"{tmp_path}/m.COF")
    assert [tuple(r)[:4] for r in rows.collect()] == [(1, 0, -29351.8, 0.0), (1, 1, -1410.8, 4545.4)]
    at = magnetism.declination(rows, 2025.0)
    places = spark.createDataFrame([(43.3499, 42.4453, 2026.63), (0.0, 0.0, None)], "lat double, lon double, year double")
    near, none = places.select(at(F.col("lat"), F.col("lon"), F.col("year")).alias("got")).collect()
    assert abs(near["got"]) < 20 and (none["got"] is None or math.isnan(none["got"]))


def potential(r, theta, lam, rows, years):
    """The model's potential out of the explicit derivatives of Legendre polynomials, half-normalised after Schmidt."""
    x, total = math.cos(theta), 0.0
    for n, m, g, h, gt, ht in rows:
        series = np.polynomial.legendre.Legendre.basis(n)
        p = (series.deriv(m) if m else series)(x) * math.sin(theta) ** m
        p *= math.sqrt(2 * math.factorial(n - m) / math.factorial(n + m)) if m else 1.0
        total += magnetism.SPHERE * (magnetism.SPHERE / r) ** (n + 1) * p * ((g + years * gt) * math.cos(m * lam) + (h + years * ht) * math.sin(m * lam))
    return total


def test_a_model_of_order_twelve_is_the_slope_of_its_potential():
    rng = np.random.default_rng(12)
    rows = [(n, m, *(rng.normal(0, 30000 / n**3, 2)), *rng.normal(0, 20, 2)) for n in range(1, 13) for m in range(n + 1)]
    rows[0] = (1, 0, -29000.0, 0.0, 12.0, 0.0)
    for lat, lon, years in [(43.3, 42.4, 1.6), (-33.9, 151.2, 0.0), (64.0, -21.0, 4.9), (0.0, 0.0, 3.0), (89.0, 10.0, 1.0), (-77.9, 166.7, 9.0)]:
        phi, lam, t = math.radians(lat), math.radians(lon), min(years, 6.0)
        normal = magnetism.SEMI_MAJOR / math.sqrt(1 - magnetism.ECCENTRICITY2 * math.sin(phi) ** 2)
        p, z = normal * math.cos(phi), normal * (1 - magnetism.ECCENTRICITY2) * math.sin(phi)
        r, theta, e = math.hypot(p, z), math.atan2(p, z), 1e-5
        north = (potential(r, theta + e, lam, rows, t) - potential(r, theta - e, lam, rows, t)) / (2 * e * r)
        east = -(potential(r, theta, lam + e, rows, t) - potential(r, theta, lam - e, rows, t)) / (2 * e * r * math.sin(theta))
        down = (potential(r + 0.01, theta, lam, rows, t) - potential(r - 0.01, theta, lam, rows, t)) / 0.02
        turn = (math.pi / 2 - theta) - phi
        want = math.degrees(math.atan2(east, north * math.cos(turn) - down * math.sin(turn)))
        assert magnetism.field_angle(*(np.array([v]) for v in (lat, lon, years)), rows)[0] == pytest.approx(want, abs=1e-4)


def test_tabled_rays_are_those_of_the_formula(spark):
    rows = spark.range(500).select((F.col("id") % 170 - 85).cast("double").alias("lat"), (F.col("id") * 7 % 360 - 180).cast("double").alias("lon"), F.radians((F.col("id") * 13 % 360).cast("double")).alias("az"), (F.col("id") * 400.0 + 1).alias("d"))
    a = geo.destination(*[F.col(c) for c in ("lat", "lon", "az", "d")])
    b = geo.destination_tabled(F.col("lat"), F.col("lon"), F.col("az"), F.sin(F.col("d") / geo.EARTH_M), F.cos(F.col("d") / geo.EARTH_M))
    assert rows.filter((a[0] != b[0]) | (a[1] != b[1])).count() == 0


def test_restricted_distance():
    d = search.restricted_distance
    assert (d("elburs", "elbrus", 2), d("ca", "abc", 3), d("abc", "abc", 0), d("abcdef", "ghijkl", 2)) == (1, 3, 0, 3)


def test_search_of_nothing_finds_nothing(spark):
    peaks = spark.createDataFrame([(1, 43.0, 42.0, 100, "Elbrus"), (2, 43.1, 42.1, 200, "Эльбрус")], "id long, lat double, lon double, ele int, name string")
    assert search.search([peaks], " - ", 43.0, 42.0).count() == 0
    assert {r["id"] for r in search.search([peaks], "эльбрус", 43.0, 42.0).collect()} == {1, 2}
    assert {r["id"] for r in search.search([peaks], "Elbrus", 43.0, 42.0).collect()} == {1, 2}
    assert {r["id"]: r["typos"] for r in search.search([peaks], "Elburs", 43.0, 42.0).collect()} == {1: 1, 2: 1}


def test_scripts_and_spellings(spark):
    cases = {"Шхара Восточная": "Shkhara Vostochnaya", "მყინვარწვერი": "Mqhinvartsveri", "Mont-blanc": "Mont-Blanc"}
    rows = spark.createDataFrame([(k,) for k in cases], "n string").select("n", text.to_latin(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in rows} == cases
    ru = {"Schesaplana": "Шесаплана", "Malāṅphulāṅ": "Маланфулан", "Ushba": "Ушба"}
    rows = spark.createDataFrame([(k,) for k in ru], "n string").select("n", text.to_cyrillic(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in rows} == ru
    tokens = spark.range(1).select(text.name_tokens(F.lit("Pic du Midi-Ouest")).alias("t")).first()["t"]
    assert tokens == ["Pic ", "du ", "Midi-", "Ouest"]


def test_heights_are_parsed(spark):
    raw = {"5642": 5642.0, "5,642": 5642.0, "4127.5 m": 4127.5, "high": None, "": None, "nan": None, "1_0": None, None: None}
    rows = spark.createDataFrame([(k,) for k in raw], "e string").select("e", etl.parse_ele(F.col("e")).alias("x")).collect()
    assert {r["e"]: r["x"] for r in rows} == raw


def test_voids_are_filled_from_the_sides():
    t = np.array([[1, 2, 3], [4, np.nan, 6], [7, 8, np.nan]])
    assert tiles.filled(t).tolist() == [[1, 2, 3], [4, 5, 6], [7, 8, 7]]
    assert not tiles.filled(np.full((3, 3), np.nan)).any()
    wide = np.full((20, 20), np.nan)
    wide[0, 0] = 10
    assert np.isfinite(tiles.filled(wide)).all()


def test_tiles_wrap_as_sixteen_bits_do():
    steps = np.array([[32767, -32768, 5], [0, 1, -1], [7, 7, 7]])
    assert (tiles.decoded(tiles.encoded(steps.astype(float), 1.0), 3) == steps).all()


def png(pixels, kinds):
    h, w, step = pixels.shape
    raw, above = b"", np.zeros(w * step, int)
    for y in range(h):
        line, out = pixels[y].ravel().astype(int), []
        for x in range(w * step):
            a, b, c = line[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((line[x] - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256)
        raw, above = raw + bytes([kinds[y], *out]), line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return tiles.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if step == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [3, 4])
def test_pictures_are_read(spark, step):
    pixels = np.random.default_rng(1).integers(0, 256, (8, 8, step))
    data = png(pixels, [0, 1, 2, 3, 4, 4, 3, 1])
    assert (tiles.png_pixels(data) == pixels).all()
    rows = spark.createDataFrame([(0, 0, data), (0, 1, data[:40]), (0, 2, b"no")], "tx int, ty int, data binary")
    got = {r["ty"]: r["heights"] for r in tiles.decode_png(rows, 8).collect()}
    want = pixels[..., 0] * 256 + pixels[..., 1] + pixels[..., 2] / 256 - 32768
    assert got[0] == want.ravel().tolist() and got[1] is None and set(got) == {0, 1}


def test_a_build_goes_on_where_it_broke_off(spark, tmp_path):
    first = spark.createDataFrame([(0, 0, b"a")], "tx int, ty int, data binary")
    both = spark.createDataFrame([(0, 0, b"x"), (0, 1, b"b")], "tx int, ty int, data binary")
    for t in (first, both, both):
        tiles.append_tiles(t, f"{tmp_path}/t")
    assert sorted((r["ty"], bytes(r["data"])) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(0, b"a"), (1, b"b")]


def test_levels_must_cut_the_world_evenly(spark):
    r = spark.range(1).select(planning.levels_of(F.lit("512:2:600:0.5,64:8:0:-")).alias("a"), planning.levels_of(F.lit("100:1:0:-")).alias("b")).first()
    assert [tuple(x) for x in r["a"]] == [(512, 2, 600.0, 0.5), (64, 8, 0.0, None)] and r["b"] is None


def test_ring_scores_against_plain_sums():
    rng = np.random.default_rng(6)
    ring, frame = rng.normal(size=90), rng.normal(size=30)
    ring[rng.random(90) < 0.1] = np.nan
    frame[rng.random(30) < 0.1] = np.nan
    got = skyline.ring_scores(ring, frame)
    for s in range(90):
        part = ring[(s + np.arange(30)) % 90]
        both = np.isfinite(part) & np.isfinite(frame)
        assert got[s] == pytest.approx(np.corrcoef(part[both], frame[both])[0, 1], abs=1e-6)


def test_the_true_direction_is_found(spark):
    n, az = 3600, np.arange(3600) * 2 * math.pi / 3600
    ring = 0.07 * np.sin(3 * az) + 0.05 * np.exp(-(((az - 1) / 0.05) ** 2)) + 0.04 * np.exp(-(((az - 2.5) / 0.03) ** 2))
    fov = math.radians(70)
    frame = ring[(500 + np.arange(700)) % n]
    rows = spark.createDataFrame([(1, ring.tolist(), frame.tolist())], "frame long, ring array<double>, ys array<double>")
    best = skyline.hypotheses(rows, fov).filter("rank = 1").first()
    assert best["place"] == 500 and best["score"] == pytest.approx(1, abs=1e-6) and best["uniqueness"] > 1
    order = skyline.apart_peaks(np.array([0.1, 0.9, 0.8, 0.2, 0.7, -1.0]), 1)
    assert order == [1, 4]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def pack(numbers):
    return b"".join(map(varint, numbers))


def pbf_blob(kind, data, squeeze=True):
    blob = field(2, len(data)) + field(3, zlib.compress(data)) if squeeze else field(1, data)
    head = field(1, kind) + field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def pbf_block(strings, group, grain=None):
    return field(1, b"".join(field(1, s.encode()) for s in strings)) + field(2, group) + (field(17, grain) if grain else b"")


def test_nodes_of_a_map_file(spark, tmp_path, monkeypatch):
    from vistaspark.sources import pbf

    strings = ["", "natural", "peak", "name", "Эльбрус", "ele", "5642"]
    deltas = lambda values: pack([zigzag(b - a) for a, b in zip([0, *values], values)])  # noqa: B905, E731
    ids, lats, lons = [5, 7, 300], [433499000, -10, 433600000], [424453000, 20, -424000000]
    dense = field(1, deltas(ids)) + field(8, deltas(lats)) + field(9, deltas(lons)[:5]) + field(9, deltas(lons)[5:]) + field(10, pack([1, 2, 3, 4, 0, 0, 5, 6, 0]))
    bare = field(1, deltas([9])) + field(8, deltas([1])) + field(9, deltas([1]))
    node = field(1, zigzag(-12)) + field(2, pack([1, 5])) + field(3, pack([2, 6])) + field(8, zigzag(430000000)) + field(9, zigzag(420000000))
    data = pbf_blob(b"OSMHeader", b"") + pbf_blob(b"OSMData", pbf_block(strings, field(2, dense))) + pbf_blob(b"OSMData", pbf_block(strings, field(1, node) + field(2, bare)), squeeze=False)
    (tmp_path / "m.pbf").write_bytes(data)
    spark.dataSource.register(pbf.PbfNodes)
    monkeypatch.setattr(pbf, "RUN_BYTES", 1)
    nodes = spark.read.format("pbf-nodes").load(f"{tmp_path}/m.pbf")
    got = {r["id"]: (round(r["lat"], 7), round(r["lon"], 7), r["tags"]) for r in nodes.collect()}
    assert got == {5: (43.3499, 42.4453, {"natural": "peak", "name": "Эльбрус"}), 300: (43.36, -42.4, {"ele": "5642"}), -12: (43.0, 42.0, {"natural": "peak", "ele": "5642"})}
    assert len(pbf.PbfReader(f"{tmp_path}/m.pbf").partitions()) == 2
    assert [(r["name"], r["ele"]) for r in etl.peaks_of(nodes).collect()] == [("Эльбрус", None)]
