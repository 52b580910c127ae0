"""What an offline region needs, has and lacks (survey A10, F22, J6, J14-J18, M15, M16, S10, S21, U3, U4)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaspark.functions import geo
from vistaspark.operators.regions import split_boxes

# Bytes of a tile of unknown weight and of a slippy tile, radius and zooms of the detailed zone, least move.
TILE_BYTES, SLIPPY_BYTES, DETAIL_M, DETAIL_ZOOMS, MOVED_M = 40_000, 60_000, 30_000.0, (12, 11), 500.0
#: Tiles of a base cell's side, and of the detail's, in one degree.
BASE_SIDE, DETAIL_SIDE = 2, 5


@dataclass(frozen=True)
class Grid:
    """A level's grid of tiles from a north-western corner; ``tiles`` (tx, ty): those that exist, all if None."""

    lod: int
    tile_deg: float
    tiles_x: int
    tiles_y: int
    tiles: DataFrame | None = None
    west: float = -180.0
    north: float = 90.0


def planned_keys(boxes: DataFrame, grids: list[Grid]) -> DataFrame:
    """Ord, lod, tx, ty of the existing tiles that each box touches, over all levels."""
    out = None
    for g in grids:
        span = lambda a, b, d=g.tile_deg: F.explode(F.sequence(F.floor(a / d).cast("long"), (F.ceil(b / d) - 1).cast("long")))
        rows = split_boxes(boxes).withColumn("tx", span(F.col("part.lo") - g.west, F.col("part.hi") - g.west))
        rows = rows.withColumn("ty", span(g.north - F.least(F.lit(90.0), "max_lat"), g.north - F.greatest(F.lit(-90.0), "min_lat")))
        rows = rows.filter(F.col("tx").between(0, g.tiles_x - 1) & F.col("ty").between(0, g.tiles_y - 1))
        if g.tiles is not None:
            rows = rows.join(g.tiles, ["tx", "ty"], "left_semi")
        rows = rows.select("ord", F.lit(g.lod).alias("lod"), "tx", "ty").distinct()
        out = rows if out is None else out.union(rows)
    return out


def detail_keys(centres: DataFrame, radius: float = DETAIL_M, zooms: tuple[int, ...] = DETAIL_ZOOMS) -> DataFrame:
    """Ord, zoom, x, y of the slippy tiles about a point (ord, lat, lon); longitudes wrap, latitudes end with the world."""
    lat, lon = F.col("lat"), F.col("lon")
    to = lambda az: geo.destination(lat, lon, F.lit(az), F.lit(radius))
    north, south, east, west = to(0.0)[0], to(math.pi)[0], to(math.pi / 2)[1], to(-math.pi / 2)[1]
    out = None
    for zoom in zooms:
        n = 1 << zoom

        def row(y, n=n):
            p = F.radians(F.greatest(F.lit(-85.05), F.least(F.lit(85.05), y)))
            return (1 - F.log(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * n

        x0, x1 = F.floor((west + 180) / 360 * n), F.ceil((east + 180) / 360 * n)
        x1 = F.when(x1 <= x0, x1 + n).otherwise(x1)
        rows = centres.withColumn("x", F.explode(F.sequence(x0, x1 - 1))).withColumn("y", F.explode(F.sequence(F.floor(row(north)), F.ceil(row(south)) - 1)))
        rows = rows.filter(F.col("y").between(0, n - 1)).select("ord", F.lit(zoom).alias("zoom"), F.pmod("x", F.lit(n)).alias("x"), "y").distinct()
        out = rows if out is None else out.union(rows)
    return out


def without_covered(base: DataFrame, detail: DataFrame) -> DataFrame:
    """Base keys (lod, tx, ty) less those of the finest level in cells all of whose detail tiles (tx, ty) exist."""
    cell = lambda c, side: F.floor(F.col(c) / side).alias(f"c{c[-1]}")
    full = detail.select("tx", "ty").distinct().groupBy(cell("tx", DETAIL_SIDE), cell("ty", DETAIL_SIDE)).count().filter(F.col("count") == DETAIL_SIDE**2)
    covered = (F.col("lod") == 0) & (F.floor(F.col("tx") / BASE_SIDE) == full["cx"]) & (F.floor(F.col("ty") / BASE_SIDE) == full["cy"])
    return base.join(full, covered, "left_anti")


def missing(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """U4: the planned keys that are not stored."""
    return planned.join(stored, planned.columns, "left_anti")


def state(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Per region whether anything is lacking, and whether any of the finest tiles is there (true if none is planned)."""
    there = planned.join(stored.withColumn("there", F.lit(True)), planned.columns, "left")
    fine = F.col("lod") == 0
    return there.groupBy("ord").agg(
        F.coalesce(F.bool_or(F.col("there").isNull()), F.lit(False)).alias("incomplete"),
        ((F.count_if(fine) == 0) | (F.count_if(fine & F.col("there").isNotNull()) > 0)).alias("has_detail"),
    )


def bytes_needed(planned: DataFrame, weights: DataFrame) -> DataFrame:
    """A10: per region the bytes of its tiles by the level's average (lod, avg_bytes)."""
    small = F.broadcast(weights)  # one row a level
    return planned.join(small, "lod", "left").groupBy("ord").agg(F.sum(F.coalesce("avg_bytes", F.lit(TILE_BYTES))).alias("bytes"))


def accounting(transfers: DataFrame) -> DataFrame:
    """Per region the transfers (ord, ok, bytes) that went through and failed, and their bytes."""
    return transfers.groupBy("ord").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("bytes"))


def index_version(levels: DataFrame) -> DataFrame:
    """Per source the levels (source, lod, cell, quant, avg_bytes, tiles_x, tiles_y) as one text, ``cell:quant:bytes:XxY`` each.

    ``cell`` is the text of the cell's degrees.
    """
    one = F.concat_ws(":", "cell", F.coalesce("quant", F.lit(1)), F.coalesce("avg_bytes", F.lit(0)), F.concat_ws("x", "tiles_x", "tiles_y"))
    return levels.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lod", one.alias("v")))), lambda x: x["v"]), "|").alias("version"))


def is_outdated(made_with: Column, purged: Column, current: Column) -> Column:
    """Made with another version; without one, whether what there was has been purged for the current one."""
    return F.coalesce(F.when(made_with != "", made_with != current).otherwise(purged == current), F.lit(False))


def purge(stored: Column, previous: Column, current: Column) -> Column:
    """Whether the tiles of a source go: its version changed, unless none was noted and the index before is the same."""
    changed = ~stored.eqNullSafe(current)
    return changed & ~(stored.isNull() & F.coalesce(previous == current, F.lit(False)))


def suggestion(current: Column, current_holds: Column, found: Column) -> Column:
    """The region to offer: none while the current one holds the point, nor the current one itself."""
    return F.when(~F.coalesce(current_holds, F.lit(False)) & ~found.eqNullSafe(current), found)


def worth_refining(moved: Column) -> Column:
    """F22."""
    return F.coalesce(moved >= MOVED_M, F.lit(False))
