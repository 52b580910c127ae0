"""GeoTIFFs written by hand, tile folders with a manifest, codecs and grids that don't line up."""

import base64
import gzip
import itertools
import json
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaspark.operators import codecs, offline, planning, sampling, tiles
from vistaspark.sources import geotiff, tile_store

FORMATS = {"f": 3, "i": 2, "u": 1}


def packed(values, order, predictor, compression):
    kind = values.dtype.newbyteorder(order)
    if predictor == 3:
        planes = values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(*values.shape, -1).transpose(0, 2, 1).reshape(len(values), -1)
        data = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    elif predictor == 2:
        data = np.diff(values, axis=1, prepend=values.dtype.type(0)).astype(kind).tobytes()
    else:
        data = values.astype(kind).tobytes()
    return zlib.compress(data) if compression == 8 else data


def write_tiff(path, levels, west, north, step, tile=16, order="<", predictor=1, compression=8, no_data=None, big=False, strips=0):
    """A TIFF of several pictures (the whole one, then its overviews)."""
    mark = {"<": b"II", ">": b"MM"}[order]
    out = bytearray(mark + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link, code = (8, "Q") if big else (4, "I")
    for k, grid in enumerate(levels):
        height, width = grid.shape
        wide, high = (width, strips) if strips else (tile, tile)
        places = []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = grid[y : y + high, x : x + wide]
                if not strips:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1])), mode="edge")
                data = packed(part, order, predictor, compression)
                places.append((len(out), len(data)))
                out += data
        tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [grid.dtype.itemsize * 8]), (259, "H", [compression]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [FORMATS[grid.dtype.kind]])]
        offsets, counts = [p[0] for p in places], [p[1] for p in places]
        tags += [(273, code, offsets), (278, "I", [high]), (279, code, counts)] if strips else [(322, "I", [wide]), (323, "I", [high]), (324, code, offsets), (325, code, counts)]
        if k == 0:
            tags += [(33550, "d", [step, step, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0])]
            tags += [(42113, "s", f"{no_data}\0".encode())] if no_data is not None else []
        entries = b""
        for tag, c, values in sorted(tags, key=lambda t: t[0]):
            raw = values if c == "s" else struct.pack(order + c * len(values), *values)
            if len(raw) > struct.calcsize(code):
                at, raw_at = len(out), raw
                out += raw_at
                raw = struct.pack(order + code, at)
            kind = {"I": 4, "H": 3, "d": 12, "s": 2, "Q": 16}[c]
            entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + raw.ljust(struct.calcsize(code), b"\0")
        out[link : link + struct.calcsize(code)] = struct.pack(order + code, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(out)
        out += struct.pack(order + code, 0)
    path.write_bytes(bytes(out))


@pytest.fixture(scope="module")
def tiff(spark):
    spark.dataSource.register(geotiff.GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda path, **o: spark.read.format("geotiff").options(path=str(path), **o).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def mosaic(rows, shape, tile):
    out = np.full(shape, -1.0)
    for r in rows:
        y, x = r["ty"] * tile[1], r["tx"] * tile[0]
        out[y : y + r["height"], x : x + r["width"]] = np.array(r["heights"], float).reshape(r["height"], r["width"])
    return out


KINDS = [("f4", 3, 8, "<", False, 0), ("f4", 1, 1, ">", False, 0), ("i2", 2, 8, "<", False, 0), ("u2", 2, 8, ">", True, 0), ("f8", 3, 8, ">", True, 0), ("i4", 1, 8, "<", False, 7), ("f4", 3, 8, "<", False, 7)]


def test_whole_pictures(tiff, tmp_path):
    grids = {}
    for k, (dtype, predictor, compression, order, big, strips) in enumerate(KINDS):
        grids[k] = (np.random.default_rng(k).random((37, 53)) * 4000).astype(dtype)
        write_tiff(tmp_path / f"{k}.tif", [grids[k]], 40.0, 44.0, 0.01, order=order, predictor=predictor, compression=compression, big=big, strips=strips)
    found = tiff(tmp_path, run=800)
    assert found.rdd.getNumPartitions() > len(KINDS)
    every = found.collect()
    for k, (*_, strips) in enumerate(KINDS):
        rows = [r for r in every if r["file"].endswith(f"/{k}.tif")]
        assert mosaic(rows, grids[k].shape, (53, 7) if strips else (16, 16)) == pytest.approx(grids[k].astype("f4"))
        one = next(r for r in rows if (r["tx"], r["ty"]) == (0, 1))
        high = 7 if strips else 16
        assert (one["west"], one["north"], one["south"]) == pytest.approx((40.0, 44.0 - high * 0.01, 44.0 - 2 * high * 0.01))
        assert all(r["east"] == pytest.approx(40.53) for r in rows if r["tx"] == (0 if strips else 3))


def test_a_box_prunes_tiles(tiff, tmp_path):
    grid = np.arange(64 * 64, dtype="f4").reshape(64, 64)
    write_tiff(tmp_path / "a.tif", [grid], 40.0, 44.0, 0.01, predictor=3)
    whole = tiff(tmp_path)
    box = (F.col("east") > 40.2) & (F.col("west") < 40.3) & (F.col("south") < 43.7) & (F.col("north") > 43.6)
    assert sorted((r["tx"], r["ty"]) for r in whole.filter(box).collect()) == sorted((r["tx"], r["ty"]) for r in whole.collect() if r["east"] > 40.2 and r["west"] < 40.3 and r["south"] < 43.7 and r["north"] > 43.6) == [(1, 1), (1, 2)]
    reader = geotiff.GeoTiffReader({"path": str(tmp_path)})
    list(reader.pushFilters([geotiff.GreaterThan(("east",), 40.2), geotiff.LessThan(("west",), 40.3), geotiff.GreaterThan(("tx",), 0)]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4


def test_overviews_and_no_data(tiff, tmp_path):
    grid = np.arange(64 * 48, dtype="f4").reshape(48, 64)
    grid[3, 5] = -9999
    means = lambda g, n: np.nanmean(np.where(g == -9999, np.nan, g).reshape(g.shape[0] // n, n, g.shape[1] // n, n), axis=(1, 3))
    write_tiff(tmp_path / "a.tif", [grid, means(grid, 2).astype("f4"), means(grid, 4).astype("f4")], 40.0, 44.0, 0.01, no_data=-9999, predictor=3)
    write_tiff(tmp_path / "b.tif", [grid], 41.0, 44.0, 0.01, no_data=-9999)
    rows = tiff(tmp_path, factor=4).collect()
    assert {r["factor"] for r in rows} == {4.0}
    for name, tile in (("a", (16, 16)), ("b", (4, 4))):
        got = mosaic([r for r in rows if r["file"].endswith(f"{name}.tif")], (12, 16), tile)
        assert got == pytest.approx(means(grid, 4), rel=1e-6)
    full = [r for r in tiff(tmp_path / "b.tif").collect() if (r["tx"], r["ty"]) == (0, 0)][0]
    assert math.isnan(full["heights"][3 * 16 + 5]) and full["heights"][3 * 16 + 6] == grid[3, 6]
    assert tiff(tmp_path / "none*.tif").count() == 0


def test_what_is_no_tiff(tiff, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"PK" + bytes(30))
    with pytest.raises(Exception, match="not a TIFF"):
        tiff(tmp_path).collect()


LEVELS = [{"cellDeg": 0.001953125, "gridWidth": 64, "gridHeight": 48, "tilesX": 4, "tilesY": 3, "quantM": 2}, {"cellDeg": 0.015625, "gridWidth": 16, "gridHeight": 12, "tilesX": 1, "tilesY": 1}]


@pytest.fixture(scope="module")
def store(spark):
    spark.dataSource.register(tile_store.TileStore)

    def write(rows, path, mode="append", parts=3):
        made = spark.createDataFrame(rows, "lod int, tx int, ty int, data binary").repartition(parts)
        made.write.format("tiles").mode(mode).options(path=str(path), levels=json.dumps(LEVELS), bbox="[40, 43, 41, 44]", ext="bin").save()

    return write


def test_tiles_with_a_manifest(spark, store, tmp_path):
    some = [(0, x, y, bytes([x, y]) * (x + 1)) for x in range(4) for y in range(3) if (x, y) != (2, 1)] + [(1, 0, 0, b"coarse")]
    store(some, tmp_path / "s")
    assert all((tmp_path / "s" / str(z) / str(x) / f"{y}.bin").read_bytes() == d for z, x, y, d in some)
    manifest = json.loads((tmp_path / "s/index.json").read_text())
    assert manifest["bbox"] == [40, 43, 41, 44] and [x["avgTileBytes"] for x in manifest["lods"]] == [round(sum(len(d) for z, *_, d in some if z == 0) / 11), 6]
    levels = tile_store.manifest_levels(spark, [str(tmp_path / "s/index.json")])
    got = offline.index_version(levels).first()["version"]
    assert got == "0.001953125:2:5:4x3|0.015625:1:6:1x1"
    cover = spark.createDataFrame([(manifest["lods"][0]["coverage"], x, y) for x in range(-1, 5) for y in range(-1, 4)], "c string, x int, y int")
    there = cover.filter(sampling.has_tile(F.col("c"), 4, 3, F.col("x"), F.col("y"))).collect()
    assert {(r["x"], r["y"]) for r in there} == {(x, y) for z, x, y, _ in some if z == 0}
    bits = np.unpackbits(np.frombuffer(base64.b64decode(manifest["lods"][0]["coverage"]), np.uint8), bitorder="little")
    assert bits.sum() == 11 and bits[1 * 4 + 2] == 0
    # a build that goes on keeps what is there and counts it
    store([*some, (0, 2, 1, b"late"), (0, 0, 0, b"other")][-2:] + some[1:], tmp_path / "s")
    assert (tmp_path / "s/0/0/0.bin").read_bytes() == bytes([0, 0]) and json.loads((tmp_path / "s/index.json").read_text())["lods"][0]["coverage"] == base64.b64encode(b"\xff\x0f").decode()
    store([(0, 0, 0, b"new")], tmp_path / "s", "overwrite")
    assert (tmp_path / "s/0/0/0.bin").read_bytes() == b"new"


def test_a_failed_write_leaves_no_manifest(store, tmp_path):
    rows = [(0, x, y, b"x") for x in range(4) for y in range(3)]
    store(rows, tmp_path / "f")
    with pytest.raises(Exception, match="outside the grid"):
        store([*rows, (0, 9, 9, b"bad")], tmp_path / "f", "overwrite", parts=4)
    assert not (tmp_path / "f/index.json").exists()
    assert not [f for _, _, names in os.walk(tmp_path / "f") for f in names if f.count(".") > 1]


def test_raw_tiles(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(0, 0, [1.0, nan, -3.0, 40000.0]), (1, 0, [nan] * 4)], "tx long, ty long, heights array<double>")
    got = tile_store.raw_tiles(rows, 2).collect()
    assert [(r["tx"], np.frombuffer(r["data"], "<i2").tolist()) for r in got] == [(0, [1, 0, -3, 32767])]
    assert gzip.decompress(tiles.encode_tiles(rows, 2, 1.0).first()["data"]) != b""


def plain_paeth(q):
    out = np.zeros_like(q)
    for y, x in itertools.product(range(q.shape[0]), range(q.shape[1])):
        a, b, c = (int(q[y, x - 1]) if x else None), (int(q[y - 1, x]) if y else None), (int(q[y - 1, x - 1]) if x and y else None)
        guess = 0 if a is None and b is None else b if a is None else a if b is None else min((a, b, c), key=lambda v: abs(a + b - c - v))
        out[y, x] = q[y, x] - guess
    return out


def plain_bytes(res, rows, code):
    z = [[v * 2 if v >= 0 else -v * 2 - 1 for v in line] for line in res.tolist()]
    if code == "golomb":
        return 4 + (sum(2 * ((v + 1).bit_length() - 1) + 1 for line in z for v in line) + 7) // 8
    blocks = [[v for line in z[y : y + rows] for v in line] for y in range(0, len(z), rows)]
    return 4 + len(blocks) + (sum(min(sum(69 if v >> k > 47 else (v >> k) + 1 + k for v in b) for k in range(16)) for b in blocks) + 7) // 8


def test_codecs_against_plain_loops(spark):
    rng = np.random.default_rng(6)
    side, ratio = 8, 2
    y, x = np.mgrid[:side, : 2 * side]
    grid = np.rint(3 * x - 5 * y + rng.normal(0, 6, x.shape)).astype(int)
    grid[3, 4] = 3000
    parent = grid[::ratio, ::ratio]
    cells = spark.createDataFrame([(int(c), int(r), int(grid[r, c])) for r in range(side) for c in range(2 * side)], "gx long, gy long, q long")
    parents = spark.createDataFrame([(int(c), int(r), int(parent[r, c])) for r in range(parent.shape[0]) for c in range(parent.shape[1])], "px long, py long, q long")
    got = {(r["tx"], r["predictor"], r["code"]): r["bytes"] for r in codecs.bench(cells, parents, side, ratio, 4).collect()}
    for tx in range(2):
        tile = grid[:, tx * side : (tx + 1) * side]
        ys, xs = np.mgrid[:side, :side]
        a, b, c = np.linalg.lstsq(np.stack([xs.ravel(), ys.ravel(), np.ones(side * side)], axis=1), tile.ravel(), rcond=None)[0]
        up = np.zeros_like(tile)
        for r, k in itertools.product(range(side), range(side)):
            py, px = r / ratio, (k + tx * side) / ratio
            at = lambda i, j: parent[min(i, parent.shape[0] - 1), min(j, parent.shape[1] - 1)]
            i, j = int(py), int(px)
            up[r, k] = np.rint((at(i, j) * (1 - px + j) + at(i, j + 1) * (px - j)) * (1 - py + i) + (at(i + 1, j) * (1 - px + j) + at(i + 1, j + 1) * (px - j)) * (py - i))
        residuals = {"left": np.diff(tile, axis=1, prepend=0), "paeth": plain_paeth(tile), "plane": plain_paeth(tile - np.rint(a * xs + b * ys + c).astype(int)), "level": plain_paeth(tile - up)}
        for name, res in residuals.items():
            for code in ("rice", "golomb"):
                assert got[tx, name, code] == plain_bytes(res, 4, code) + (12 if name == "plane" else 0), (tx, name, code)
    best = {r["tx"]: r["bytes"] for r in codecs.best_codec(codecs.bench(cells, parents, side, ratio, 4)).collect()}
    assert best == {tx: min(v for k, v in got.items() if k[0] == tx) for tx in range(2)}


def test_grids_that_do_not_line_up_keep_the_mass(spark):
    rng = random.Random(3)
    rows = [(0, 10.003 + 0.07 * i, 50.0011 - 0.05 * j, 0.07, 0.05, rng.uniform(0, 3000)) for i in range(30) for j in range(25)]
    rows += [(0, 12.2, 50.0, 0.07, 0.05, None), (0, 12.3, 50.0, 0.0, 0.05, 5.0), (0, 12.4, 50.0, 0.1, 0.1, float("nan"))]
    cells = spark.createDataFrame(rows, "source int, west double, north double, wide double, high double, h double")
    for target in (0.03, 0.11, 0.5):
        dealt = planning.overlaps(cells, target)
        mass = dealt.agg(F.sum(F.col("share") * F.col("h")).alias("m")).first()["m"] * target * target
        assert mass == pytest.approx(sum(r[3] * r[4] * r[5] for r in rows[:750]), rel=1e-9)
        assert dealt.groupBy("gx", "gy").agg(F.sum("share").alias("s")).agg(F.max("s")).first()[0] <= 1 + 1e-9
    # cell by cell against the overlap of rectangles
    got = {(r["gx"], r["gy"]): r["h"] for r in planning.reprojected(cells, 0.11).collect()}
    for (gx, gy), h in list(got.items())[::7]:
        w, n = -180 + gx * 0.11, 90 - gy * 0.11
        shares = [(max(0, min(w + 0.11, a + wide) - max(w, a)) * max(0, min(n, b) - max(n - 0.11, b - high)), v) for _, a, b, wide, high, v in rows[:750]]
        assert h == pytest.approx(sum(s * v for s, v in shares) / sum(s for s, _ in shares), rel=1e-6)


def test_the_later_source_wins_where_it_is(spark):
    rows = [(0, 0.0, 1.0, 1.0, 1.0, 5.0), (1, 0.0, 1.0, 0.25, 0.25, 9.0), (1, 0.25, 1.0, 0.25, 0.25, None)]
    cells = spark.createDataFrame(rows, "source int, west double, north double, wide double, high double, h double")
    got = {(r["gx"], r["gy"]): r["h"] for r in planning.reprojected(cells, 0.25, 0.0, 1.0).collect()}
    assert len(got) == 16 and got[0, 0] == 9.0 and got[1, 0] == 5.0
