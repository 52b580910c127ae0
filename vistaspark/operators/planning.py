"""Planning and building a height pyramid (survey A21, M12, M13, M17, M33, W12)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.functions import geo
from vistaspark.operators.dealing import spread

TILE = 256
#: Ranks that one window sums up; a share of a cell below this is a rounding of its edge.
RANK_BLOCK, LEAST_SHARE = 100_000, 1e-9


def levels_of(spec: Column) -> Column:
    """``cells:quant:relief:share`` levels, parted by commas, a dash for no share, as structs from fine to coarse.

    Null where a level would not cut the world into whole tiles.
    """

    def level(part):
        v = F.split(part, ":")
        at = lambda i: F.get(v, F.lit(i))
        return F.struct(at(0).try_cast("int").alias("cells_per_deg"), at(1).try_cast("int").alias("quant"), at(2).try_cast("double").alias("relief"), F.when(at(3) != "-", at(3).try_cast("double")).alias("share"))

    levels = F.transform(F.split(spec, ","), level)
    return F.when(F.forall(levels, lambda x: F.coalesce(360 * x["cells_per_deg"] % TILE == 0, F.lit(False))), levels)


def jobs(cells: DataFrame, cells_per_deg: int) -> DataFrame:
    """The tiles (tx, ty) that the cells of one degree (lat, lon: south-western corner) take part in, with their cells.

    A tile of a degree or less has one source cell, a larger one all that touch it.
    """
    span = TILE / cells_per_deg
    if span <= 1:
        n = round(1 / span)
        steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = cells.withColumn("i", steps()).withColumn("j", steps())
        tiles = rows.select(((F.col("lon") + 180) * n + F.col("i")).cast("long").alias("tx"), ((90 - F.col("lat") - 1) * n + F.col("j")).cast("long").alias("ty"), "lat", "lon")
        return tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("sources"))
    wanted = cells.select(F.floor((F.col("lon") + 180) / span).alias("tx"), F.floor((90 - F.col("lat") - 1e-9) / span).alias("ty")).distinct()
    west, north = -180 + F.col("tx") * span, 90 - F.col("ty") * span
    reach = (TILE - 1) / cells_per_deg
    around = wanted.withColumn("lat", F.explode(F.sequence(F.floor(north - reach), F.floor(north)))).withColumn("lon", F.explode(F.sequence(F.floor(west), F.floor(west + reach))))
    there = around.join(cells.select("lat", "lon").distinct(), ["lat", "lon"])
    return there.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("sources"))


def estimate(ranked: DataFrame, measured: DataFrame, budget: float) -> DataFrame:
    """How many jobs (rank from 0) fit into the bytes, with sizes drawn in straight lines between the measured ones (rank, bytes).

    A measured rank and the next one hold the jobs between them: an interval join on the few
    samples.
    """
    following = Window.orderBy("rank")  # a dozen samples
    spans = measured.select(F.col("rank").alias("r0"), F.col("bytes").alias("b0"), F.lead("rank").over(following).alias("r1"), F.lead("bytes").over(following).alias("b1"))
    hit = (F.col("rank") >= F.col("r0")) & (F.col("r1").isNull() | (F.col("rank") < F.col("r1")))
    size = F.when(F.col("r1").isNull(), F.col("b0")).otherwise(F.col("b0") + (F.col("b1") - F.col("b0")) * (F.col("rank") - F.col("r0")) / (F.col("r1") - F.col("r0")))
    sized = ranked.join(F.broadcast(spans), hit).withColumn("size", size)
    # the running sum in blocks of ranks: sums of blocks first, then within each
    blocks = sized.withColumn("block", F.floor(F.col("rank") / RANK_BLOCK))
    sums = blocks.groupBy("block").agg(F.sum("size").alias("all"))
    before = sums.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("before"))  # one row a block
    within = F.sum("size").over(Window.partitionBy("block").orderBy("rank"))
    run = blocks.join(F.broadcast(before), "block").withColumn("used", F.col("before") + within)
    return run.agg(F.count_if(F.col("used") < budget).alias("fit"), F.coalesce(F.max(F.when(F.col("used") < budget, F.col("used"))), F.lit(0.0)).alias("bytes"))


def box_mean(cells: DataFrame) -> DataFrame:
    """The mean of each cell (gx, gy, h) and its neighbours, as far as there are: each cell gives its height to the nine around it."""
    step = lambda c: F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])).alias(c)
    spread = cells.select(step("gx"), "gy", "h").select("gx", step("gy"), "h").groupBy("gx", "gy").agg(F.avg("h").alias("mean"))
    return cells.select("gx", "gy").join(spread, ["gx", "gy"])


def overlaps(cells: DataFrame, target: float, west: float = -180.0, north: float = 90.0) -> DataFrame:
    """Each source cell (source, west, north, wide, high, h) dealt to the cells (gx, gy) of a grid that it overlaps, with the share of the target cell that it covers.

    The grids need not line up: a cell's reach along each axis is a range of target cells, so
    rows grow by the ratio of the cells' sizes only. Cells without a height are left out.
    """

    def along(start: Column, size: Column, name: str) -> tuple[Column, Column]:
        """The range of target cells, and of one of them the share between ``start`` and ``start + size``."""
        first, last = F.floor(start / target), F.ceil((start + size) / target) - 1
        low, high = F.col(name) * target, (F.col(name) + 1) * target
        return F.explode(F.sequence(first, F.greatest(first, last))).alias(name), F.greatest(F.lit(0.0), F.least(high, start + size) - F.greatest(low, start)) / target

    x, y = F.col("west") - west, north - F.col("north")
    each_x, share_x = along(x, F.col("wide"), "gx")
    each_y, share_y = along(y, F.col("high"), "gy")
    known = cells.filter(F.col("h").isNotNull() & ~F.isnan(F.col("h").cast("double")) & (F.col("wide") > 0) & (F.col("high") > 0))
    spread = known.select("source", "west", "north", "wide", "high", "h", each_x).select("*", each_y)
    return spread.select("source", "gx", "gy", "h", (share_x * share_y).alias("share")).filter(F.col("share") > LEAST_SHARE)


def reprojected(cells: DataFrame, target: float, west: float = -180.0, north: float = 90.0) -> DataFrame:
    """The cells (gx, gy, h) of a grid from its north-western corner: of each source the mean by shares of what overlaps, the later source before the earlier."""
    dealt = overlaps(cells, target, west, north).groupBy("gx", "gy", "source").agg(F.sum("share").alias("share"), F.sum(F.col("share") * F.col("h")).alias("mass"))
    return dealt.groupBy("gx", "gy").agg(F.max_by(F.col("mass") / F.col("share"), "source").alias("h"))


def fan(observers: DataFrame, cell_deg: float, tile: int, west: float, north: float, rays: int = 72, step: float = 8_000.0, reach: float = 200_000.0) -> DataFrame:
    """Of each observer (id, lat, lon) the samples (id, ray, d, tx, ty) of a fan of rays with the tile each lies in."""
    rows = spread(observers.select("id", "lat", "lon"), "id")
    rows = rows.select("id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(int(reach // step))))).withColumn("d", F.col("d") * step)
    to = geo.destination(F.col("lat"), F.col("lon"), F.col("ray") * (2 * math.pi / rays), F.col("d"))
    return rows.select("id", "ray", "d", F.floor((to[1] - west) / cell_deg / tile).alias("tx"), F.floor((north - to[0]) / cell_deg / tile).alias("ty"))


def prefetch_keys(observers: DataFrame, cell_deg: float, tile: int, west: float, north: float, **options) -> DataFrame:
    """Of each observer the tiles that a fan of rays about it meets, for reading only those."""
    return fan(observers, cell_deg, tile, west, north, **options).select("id", "tx", "ty").distinct()


def last_covered(samples: DataFrame, tiles: DataFrame) -> DataFrame:
    """Of each ray (id, ray) of a fan the farthest sample that lies in a tile which is there; rays without any are left out."""
    return samples.join(tiles, ["tx", "ty"], "left_semi").groupBy("id", "ray").agg(F.max("d").alias("last_d"))
