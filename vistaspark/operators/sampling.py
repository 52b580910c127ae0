"""Heights out of rasters: bilinear reads, levels and sources that stand in for each other (survey J8-J11, M7, M9, M18, F18, F19, F21).

A raster is rows (gx, gy, h) of a grid from the north-western corner. Bilinear reads join a
point with the quad of heights at its cell: quads are built once a raster, so a point is
joined once a level and not once a corner. Filters on gx and gy reach the raster's scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaspark.functions import geo

# Pixels of a tile's side in the slippy map, the near zone, detail of a fine source, zooms by distance.
TILE_PX, NEAR_M, FINE_M = 256, 30_000.0, 120.0
ZOOMS = ((2_000.0, 12), (10_000.0, 11), (40_000.0, 10))
FAR_ZOOM = 9
#: A raster's quads are broadcast up to this many rows.
BROADCAST_QUADS = 2_000_000


@dataclass(frozen=True)
class Level:
    """A raster (gx, gy, h) and its grid."""

    cells: DataFrame
    cell_deg: float
    width: int
    height: int


@dataclass(frozen=True)
class Pyramid:
    """Levels from fine to coarse over one box."""

    min_lon: float
    max_lat: float
    max_lon: float
    min_lat: float
    levels: tuple[Level, ...]


def zoom_for_distance(d: Column, zooms=ZOOMS, far: int = FAR_ZOOM) -> Column:
    """M7: zoom of the slippy map by distance."""
    out = F.lit(far)
    for limit, zoom in reversed(zooms):
        out = F.when(d < limit, zoom).otherwise(out)
    return out


def level_for_distance(d: Column, pyramid: Pyramid) -> Column:
    """M7: the level whose detail is nearest, by logarithm, to a 150th of the distance."""
    wanted = F.greatest(F.lit(90.0), d / 150)
    off = [F.struct(F.abs(F.log(F.lit(x.cell_deg * geo.DEGREE_M) / wanted)).alias("off"), F.lit(i).alias("level")) for i, x in enumerate(pyramid.levels)]
    return F.array_min(F.array(*off))["level"]


def terrarium_height(r: Column, g: Column, b: Column) -> Column:
    """M9: metres of a Terrarium pixel."""
    return r * 256 + g + b / 256 - 32768


def is_fine(resolution_m: Column) -> Column:
    """a source whose finest level is fine enough for the near zone."""
    return resolution_m <= FINE_M


def quads(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of each cell (``keys``, gx, gy) the heights at its four corners, h00, h10, h01, h11, as far as there are."""
    corner = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    rows = cells.select(*keys, "gx", "gy", "h", corner.alias("c"))
    at = lambda dx, dy: F.max(F.when((F.col("c.dx") == dx) & (F.col("c.dy") == dy), F.col("h"))).alias(f"h{dx}{dy}")
    return rows.groupBy(*keys, (F.col("gx") - F.col("c.dx")).alias("gx"), (F.col("gy") - F.col("c.dy")).alias("gy")).agg(*[at(dx, dy) for dx in (0, 1) for dy in (0, 1)])


def _small(table: DataFrame, most: int) -> DataFrame:
    """Broadcast a table of at most ``most`` rows, as its grid says, if that is little; else Spark chooses by what it meets."""
    return F.broadcast(table) if most <= BROADCAST_QUADS else table


def _mixed(fx: Column, fy: Column, h00: Column, h10: Column, h01: Column, h11: Column) -> Column:
    top, bottom = h00 + (h10 - h00) * fx, h01 + (h11 - h01) * fx
    return top + (bottom - top) * fy


def sample_level(points: DataFrame, pyramid: Pyramid, level: int, out: str) -> DataFrame:
    """``points`` (lat, lon) with the bilinear height at one level; null outside and where a corner is missing."""
    x = pyramid.levels[level]
    gx, gy = (F.col("lon") - pyramid.min_lon) / x.cell_deg, (pyramid.max_lat - F.col("lat")) / x.cell_deg
    inside = (gx >= 0) & (gy >= 0) & (gx < x.width - 1) & (gy < x.height - 1)
    there = quads(x.cells, []).filter("h00 IS NOT NULL AND h10 IS NOT NULL AND h01 IS NOT NULL AND h11 IS NOT NULL")
    there = _small(there.select(F.col("gx").alias("__gx"), F.col("gy").alias("__gy"), "h00", "h10", "h01", "h11"), x.width * x.height)
    rows = points.withColumn("__x", F.when(inside, gx)).withColumn("__y", F.when(inside, gy))
    rows = rows.join(there, (F.floor("__x") == F.col("__gx")) & (F.floor("__y") == F.col("__gy")), "left")
    h = _mixed(F.col("__x") - F.floor("__x"), F.col("__y") - F.floor("__y"), *[F.col(c) for c in ("h00", "h10", "h01", "h11")])
    return rows.withColumn(out, h).drop("__x", "__y", "__gx", "__gy", "h00", "h10", "h01", "h11")


def sample(points: DataFrame, pyramid: Pyramid, out: str = "h", start: Column | None = None) -> DataFrame:
    """The height at the first level, from ``start`` on, that has one."""
    names = [f"__level{i}" for i in range(len(pyramid.levels))]
    for i, name in enumerate(names):
        points = sample_level(points, pyramid, i, name)
    start = F.lit(0) if start is None else start
    return points.withColumn(out, F.coalesce(*[F.when(start <= i, F.col(n)) for i, n in enumerate(names)])).drop(*names)


def sample_slippy(points: DataFrame, pixels: DataFrame, zoom: str, out: str) -> DataFrame:
    """The bilinear height out of pixels (z, gx, gy, h) of the world at the point's ``zoom``.

    The pixel at the point must be there; a missing neighbour counts as equal to it.
    Longitudes wrap.
    """
    at = F.pow(F.lit(2.0), F.col(zoom)) * TILE_PX
    p = F.radians(F.greatest(F.lit(-geo.SLIPPY_LIMIT), F.least(F.lit(geo.SLIPPY_LIMIT), F.col("lat"))))
    x = (geo.normalize_lon(F.col("lon")) + 180) / 360 * at
    y = (1 - F.log(F.tan(p) + 1 / F.cos(p)) / 3.141592653589793) / 2 * at
    world = F.pow(F.lit(2.0), F.col("z")) * TILE_PX
    there = quads(pixels, ["z"]).withColumn("gx", F.pmod(F.col("gx"), world).cast("long"))
    there = there.groupBy("z", "gx", "gy").agg(*[F.max(c).alias(c) for c in ("h00", "h10", "h01", "h11")]).filter("h00 IS NOT NULL")
    there = there.withColumnRenamed("z", "__z").withColumnRenamed("gx", "__gx").withColumnRenamed("gy", "__gy")
    rows = points.withColumn("__x", x).withColumn("__y", y)
    rows = rows.join(there, (F.col(zoom) == F.col("__z")) & (F.floor("__x") == F.col("__gx")) & (F.floor("__y") == F.col("__gy")), "left")
    near = [F.coalesce(F.col(c), F.col("h00")) for c in ("h10", "h01", "h11")]
    h = _mixed(F.col("__x") - F.floor("__x"), F.col("__y") - F.floor("__y"), F.col("h00"), *near)
    return rows.withColumn(out, h).drop("__x", "__y", "__z", "__gx", "__gy", "h00", "h10", "h01", "h11")


def _within(pyramid: Pyramid) -> Column:
    return F.col("lat").between(pyramid.min_lat, pyramid.max_lat) & F.col("lon").between(pyramid.min_lon, pyramid.max_lon)


def sample_sources(points: DataFrame, fine: Pyramid, coarse: Pyramid, pixels: DataFrame, zoom: str, distance: str, out: str = "h") -> DataFrame:
    """The fine source, then the slippy map in the near zone and the coarse source beyond it, then the other one."""
    rows = sample(points, fine, "__fine")
    rows = sample(rows, coarse, "__coarse")
    rows = sample_slippy(rows, pixels, zoom, "__slippy")
    f, c, s = F.when(_within(fine), F.col("__fine")), F.when(_within(coarse), F.col("__coarse")), F.col("__slippy")
    return rows.withColumn(out, F.when(F.col(distance) < NEAR_M, F.coalesce(f, s, c)).otherwise(F.coalesce(f, c, s))).drop("__fine", "__coarse", "__slippy")


def observer_height(points: DataFrame, pyramid: Pyramid, out: str = "ground") -> DataFrame:
    """The highest of the nine cells about a point at the first level that has any of them.

    ``points`` have an ``id``.
    """
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    found = None
    for i, x in enumerate(pyramid.levels):
        cell = points.select("id", F.floor((F.col("lon") - pyramid.min_lon) / x.cell_deg).alias("cx"), F.floor((pyramid.max_lat - F.col("lat")) / x.cell_deg).alias("cy"), around.alias("c"))
        near = cell.select("id", (F.col("cx") + F.col("c.dx")).alias("gx"), (F.col("cy") + F.col("c.dy")).alias("gy")).join(x.cells, ["gx", "gy"])
        best = near.groupBy("id").agg(F.max("h").cast("double").alias("h")).withColumn("level", F.lit(i))
        found = best if found is None else found.union(best)
    first = found.groupBy("id").agg(F.min_by("h", "level").alias(out))
    return points.join(first, "id", "left")


def coverage(cells: DataFrame, tile: int) -> DataFrame:
    """The tiles (tx, ty) that have a cell."""
    return cells.select(F.floor(F.col("gx") / tile).alias("tx"), F.floor(F.col("gy") / tile).alias("ty")).distinct()


def coverage_bits(tiles: DataFrame, tiles_x: int, keys: list[str] = ()) -> DataFrame:
    """The tiles as bytes of a bit map, bit ``ty * tiles_x + tx``, lowest bit first: rows (keys, byte, bits)."""
    bit = (F.col("ty") * tiles_x + F.col("tx")).cast("long")
    return tiles.groupBy(*keys, F.floor(bit / 8).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))).alias("bits"))


def packed_bits(bits: DataFrame, size: int) -> DataFrame:
    """The bit map of one level as base64 of ``size`` bytes, those without a tile as zeros."""
    whole = bits.agg(F.map_from_entries(F.collect_list(F.struct(F.col("byte"), F.hex(F.col("bits"))))).alias("m"))  # at most ``size`` rows
    digits = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: F.lpad(F.coalesce(F.col("m")[i], F.lit("0")), 2, "0"))
    return whole.select(F.base64(F.unhex(F.array_join(digits, ""))).alias("coverage"))


def has_tile(coverage: Column, tiles_x: int, tiles_y: int, tx: Column, ty: Column) -> Column:
    """a tile of the grid whose bit in the map (base64) is set; without a map every tile of the grid may be there."""
    bit = ty * tiles_x + tx
    byte = F.conv(F.substring(F.hex(F.unbase64(coverage)), (F.floor(bit / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    inside = (tx >= 0) & (ty >= 0) & (tx < tiles_x) & (ty < tiles_y)
    return inside & (coverage.isNull() | (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))) != 0))


def any_coverage(points: DataFrame, pyramid: Pyramid, tile: int, start: int = 0, out: str = "covered") -> DataFrame:
    """whether some level from ``start`` on has the tile at a point."""
    flags = []
    for i, x in enumerate(pyramid.levels[start:], start):
        tiles = _small(coverage(x.cells, tile).select(F.col("tx").alias("__tx"), F.col("ty").alias("__ty"), F.lit(True).alias(f"__c{i}")), -(-x.width // tile) * -(-x.height // tile))
        tx, ty = F.floor((F.col("lon") - pyramid.min_lon) / x.cell_deg / tile), F.floor((pyramid.max_lat - F.col("lat")) / x.cell_deg / tile)
        points = points.join(tiles, (F.col("__tx") == tx) & (F.col("__ty") == ty), "left").drop("__tx", "__ty")
        flags.append(f"__c{i}")
    return points.withColumn(out, F.coalesce(*flags, F.lit(False))).drop(*flags)
