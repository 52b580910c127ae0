"""How many bytes tiles of steps take, by predictor and code (survey M30).

Cells are rows (gx, gy, q) of full tiles. A predictor leaves a residual in each cell, a code
counts the bits of residuals; all is arithmetic on rows, windows within a tile and sums, so
the bench of a whole pyramid is one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.operators.tiles import paeth

# The parameters a Rice code may have, the longest run of ones, the bits of a value beyond it, the bytes
# of a tile's head and of a plane.
PARAMETERS, LONGEST, ESCAPED, HEAD_BYTES, PLANE_BYTES = 16, 47, 69, 4, 12
TILE = ["tx", "ty"]


def in_tiles(cells: DataFrame, side: int) -> DataFrame:
    """Cells with their tile (tx, ty)."""
    return cells.withColumn("tx", F.floor(F.col("gx") / side)).withColumn("ty", F.floor(F.col("gy") / side))


def left_residuals(cells: DataFrame, side: int) -> DataFrame:
    """What is left of each cell after its left neighbour in the tile."""
    along = Window.partitionBy("tx", "gy").orderBy("gx")
    return in_tiles(cells, side).withColumn("residual", F.col("q") - F.coalesce(F.lag("q").over(along), F.lit(0)))


def paeth_residuals(cells: DataFrame, side: int) -> DataFrame:
    """What is left after the nearest of left, above and left + above - corner."""
    return paeth(cells, side)


def plane_residuals(cells: DataFrame, side: int) -> DataFrame:
    """What Paeth leaves of what the least-squares plane of the tile leaves.

    On a full tile the middled columns and rows are orthogonal, so the slopes are two sums
    over one, and the plane comes out of one aggregation.
    """
    x, y = (F.pmod(F.col(c), F.lit(side)) - (side - 1) / 2 for c in ("gx", "gy"))
    spread = side * sum((k - (side - 1) / 2) ** 2 for k in range(side))
    rows = in_tiles(cells, side)
    planes = rows.groupBy(*TILE).agg((F.sum(x * F.col("q")) / spread).alias("a"), (F.sum(y * F.col("q")) / spread).alias("b"), F.avg("q").alias("c"))
    left = rows.join(planes, TILE).withColumn("q", F.col("q") - F.rint(F.col("a") * x + F.col("b") * y + F.col("c")).cast("long"))
    return paeth(left.select("gx", "gy", "q"), side)


def level_residuals(cells: DataFrame, parents: DataFrame, side: int, ratio: int, quant_ratio: float = 1.0) -> DataFrame:
    """What Paeth leaves of what the coarser level (px, py, q) leaves, drawn in straight lines between its points.

    ``ratio``: cells of this level to a cell of the coarser one; ``quant_ratio``: its step by
    this level's. A point that is missing is taken as the one before; cells without any
    coarser point keep their value.
    """

    def following(column: str, along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        return F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(column).over(w)).otherwise(F.col(column))

    quads = parents.select("px", "py", F.col("q").alias("p00")).withColumn("p10", following("p00", "px", "py"))
    quads = quads.withColumn("p01", following("p00", "py", "px")).withColumn("p11", following("p10", "py", "px"))
    at = cells.withColumn("px", F.floor(F.col("gx") / ratio)).withColumn("py", F.floor(F.col("gy") / ratio)).join(quads, ["px", "py"], "left")
    u, v = (F.pmod(F.col(c), F.lit(ratio)) / ratio for c in ("gx", "gy"))
    top, low = F.col("p00") * (1 - u) + F.col("p10") * u, F.col("p01") * (1 - u) + F.col("p11") * u
    guess = F.coalesce(F.rint((top * (1 - v) + low * v) * quant_ratio).cast("long"), F.lit(0))
    return paeth(at.select("gx", "gy", (F.col("q") - guess).alias("q")), side)


def _zigzag() -> Column:
    return F.when(F.col("residual") >= 0, F.col("residual") * 2).otherwise(-F.col("residual") * 2 - 1)


def rice_bytes(residuals: DataFrame, side: int, rows: int) -> DataFrame:
    """tx, ty, bytes of a Rice code whose parameter is the best one of each block of ``rows`` rows."""
    z = _zigzag()

    def bits(k: int) -> Column:
        ones = F.shiftright(z, k)
        return F.sum(F.when(ones > LONGEST, ESCAPED).otherwise(ones + 1 + k))

    block = F.floor(F.pmod(F.col("gy"), F.lit(side)) / rows).alias("block")
    blocks = residuals.groupBy(*TILE, block).agg(F.least(*[bits(k) for k in range(PARAMETERS)]).alias("bits"))
    return blocks.groupBy(*TILE).agg((HEAD_BYTES + F.count(F.lit(1)) + F.floor((F.sum("bits") + 7) / 8)).alias("bytes"))


def golomb_bytes(residuals: DataFrame) -> DataFrame:
    """tx, ty, bytes of an exponential Golomb code."""
    bits = 2 * (F.length(F.bin(_zigzag() + 1)) - 1) + 1
    return residuals.groupBy(*TILE).agg((HEAD_BYTES + F.floor((F.sum(bits) + 7) / 8)).alias("bytes"))


def bench(cells: DataFrame, parents: DataFrame, side: int, ratio: int, rows: int = 16) -> DataFrame:
    """tx, ty, predictor, code, bytes: every predictor with every code."""
    predictors: dict[str, Callable[[], DataFrame]] = {
        "left": lambda: left_residuals(cells, side),
        "paeth": lambda: paeth_residuals(cells, side),
        "plane": lambda: plane_residuals(cells, side),
        "level": lambda: level_residuals(cells, parents, side, ratio),
    }
    out = None
    for name, of in predictors.items():
        more = F.lit(PLANE_BYTES if name == "plane" else 0)
        for code, counted in (("rice", rice_bytes(of(), side, rows)), ("golomb", golomb_bytes(of()))):
            part = counted.select(*TILE, F.lit(name).alias("predictor"), F.lit(code).alias("code"), (F.col("bytes") + more).cast("long").alias("bytes"))
            out = part if out is None else out.union(part)
    return out


def best_codec(benched: DataFrame) -> DataFrame:
    """tx, ty, predictor, code, bytes of the least bytes, the first by name of equal ones."""
    best = F.min(F.struct("bytes", "predictor", "code")).alias("b")
    return benched.groupBy(*TILE).agg(best).select(*TILE, "b.predictor", "b.code", "b.bytes")
