"""Rasters and tile pyramids as tables (survey A7, A8, M10, M14, T5, W11, W14, M15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def downsample(raster: DataFrame, factor: int) -> DataFrame:
    """Mean of the cells that have a height in each block."""
    block = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return raster.groupBy(block("gx"), block("gy")).agg(F.avg("h").alias("h"))


def quantise(raster: DataFrame, quant: float) -> DataFrame:
    """Heights in steps of ``quant``, halves to even, held to 16 bits."""
    q = F.rint(F.col("h") / quant)
    return raster.withColumn("q", F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), q)).cast("int"))


def row_deltas(raster: DataFrame) -> DataFrame:
    """Difference from the cell before in the row, the first from 0."""
    along = Window.partitionBy("gy").orderBy("gx")
    return raster.withColumn("delta", F.col("q") - F.lag("q", 1, 0).over(along))


def relief_stats(raster: DataFrame, tile: int) -> DataFrame:
    """0.5 and 99.5 percentiles, mean and relief of each tile."""
    cut = F.percentile("h", F.array(F.lit(0.005), F.lit(0.995)))
    by = raster.groupBy(F.floor(F.col("gx") / tile).cast("long").alias("tx"), F.floor(F.col("gy") / tile).cast("long").alias("ty"))
    return by.agg(cut.alias("p"), F.avg("h").alias("mean")).select("tx", "ty", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "mean", (F.col("p")[1] - F.col("p")[0]).alias("relief"))


#: Cells that one task sums up, about; the most blocks of them; cells sampled for each block's bound.
CELLS_BLOCK, MOST_BLOCKS, SAMPLED = 100_000, 1000, 20


def _blocks(kept: DataFrame) -> Column:
    """The block of a cell: blocks follow each other in the order of priority, relief from high to low, and cell."""
    key = [(-F.col("priority")).cast("long"), F.col("relief").cast("double"), (-F.col("cell")).cast("long")]
    blocks = min(MOST_BLOCKS, -(-kept.count() // CELLS_BLOCK))
    if blocks <= 1:
        return F.lit(0)
    # a few cells of each block, chosen by a hash; their order on the driver gives the bounds
    sample = kept.orderBy(F.xxhash64("cell"), "cell").limit(SAMPLED * blocks).select(F.struct(*[k.alias(x) for k, x in zip(key, "prc", strict=True)]).alias("key"))
    ranked = [tuple(r["key"]) for r in sample.orderBy(F.desc("key")).collect()]
    bounds = [ranked[i * len(ranked) // blocks] for i in range(1, blocks)]
    literals = [F.struct(*[F.lit(v).cast(t).alias(x) for v, t, x in zip(bound, ("long", "double", "long"), "prc", strict=True)]) for bound in bounds]
    return F.size(F.filter(F.array(*literals), lambda bound: bound >= F.struct(*[k.alias(x) for k, x in zip(key, "prc", strict=True)])))


def select_cells(cells: DataFrame, least_relief: float, budget: int) -> DataFrame:
    """Cells of enough relief for their priority, best first, while the bytes before them are under the budget.

    The running sum is taken over blocks of the order first (at most ``MOST_BLOCKS`` rows)
    and then within each.
    """
    boost = F.when(F.col("priority") == 1, 4.0).when(F.col("priority") == 2, 3.0).when(F.col("priority") == 3, 2.0).when(F.col("priority") == 4, 1.5).otherwise(1.0)
    kept = cells.filter(F.col("relief") * boost >= least_relief)
    kept = kept.withColumn("block", _blocks(kept))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = kept.groupBy("block").agg(F.sum("bytes").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    within = Window.partitionBy("block").orderBy(F.asc_nulls_last("priority"), F.desc("relief"), F.asc_nulls_last("cell")).rowsBetween(Window.unboundedPreceding, -1)
    rows = kept.join(F.broadcast(bases), "block").withColumn("used", F.col("base") + F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    return rows.filter(F.col("used") < budget).drop("base", "block")


def tile_keys(boxes: DataFrame, degrees: float) -> DataFrame:
    """The tiles of a grid from (-180, 90) that a box touches, its parts across the antimeridian included."""
    from vistaspark.operators.regions import split_boxes

    span = lambda a, b: F.explode(F.sequence(F.floor(a / degrees).cast("long"), (F.ceil(b / degrees) - 1).cast("long")))
    rows = split_boxes(boxes).withColumn("tx", span(F.col("part.lo") + 180, F.col("part.hi") + 180))
    return rows.withColumn("ty", span(90 - F.col("max_lat"), 90 - F.col("min_lat"))).select("ord", "tx", "ty").distinct()
