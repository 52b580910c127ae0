"""Peaks: isolation, the search index, and the map's selection (survey J1, W7, W8, W10, T3, M3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.functions import scores
from vistaspark.functions.geo import DEGREE_M

# Fixed value: isolation is not sought beyond this distance.
ISOLATION_CAP_M = 36000.0


#: Side of the cells in which a nearer answer is sought first.
NEAR_M = 6000.0


def _nearest_above(askers: DataFrame, higher: DataFrame, keys: list[str], side: float) -> DataFrame:
    """id, d2: squared metres to the nearest higher peak in the asker's cell of that side and the eight around it."""
    cell = lambda c: F.floor(F.col(c) / side)
    spread = higher.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("id", "h", "x", "y")], cell("x").alias("cx"), cell("y").alias("cy"))
    spread = spread.withColumn("cx", F.explode(F.array(*[F.col("cx") + i for i in (-1, 0, 1)]))).withColumn("cy", F.explode(F.array(*[F.col("cy") + i for i in (-1, 0, 1)])))
    above = (F.col("o_h") > F.col("h")) | ((F.col("o_h") == F.col("h")) & (F.col("o_id") < F.col("id")))
    near = askers.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(spread, [*keys, "cx", "cy"]).filter(above)
    return near.groupBy("id").agg(F.min(F.pow(F.col("o_x") - F.col("x"), 2) + F.pow(F.col("o_y") - F.col("y"), 2)).alias("d2"))


def isolation(peaks: DataFrame, group: str | None = None) -> DataFrame:
    """``iso_m``, metres to the nearest peak that ranks higher by (height, order of id).

    Positions are planar about the mean latitude of the group. A peak first asks the cells
    of 6 km around it, by an equi-join; an answer within 6 km holds. Only peaks without one,
    of which few fit into an area, ask the cells as wide as the cap. Peaks without a height
    stop nobody.
    """
    keys = [group] if group else []
    means = peaks.groupBy(*keys).agg(F.avg("lat").alias("mean_lat"))
    # a row a group, joined by key; without groups one row
    placed = peaks.join(means, group) if group else peaks.crossJoin(F.broadcast(means))
    placed = placed.select(
        *keys,
        "id",
        F.coalesce("ele", F.lit(0)).alias("h"),
        F.col("ele").isNotNull().alias("has_ele"),
        (F.col("lon") * DEGREE_M * F.cos(F.radians("mean_lat"))).alias("x"),
        (F.col("lat") * DEGREE_M).alias("y"),
    )
    higher = placed.filter("has_ele")
    settled = _nearest_above(placed, higher, keys, NEAR_M).filter(F.col("d2") <= NEAR_M * NEAR_M)
    answers = settled.union(_nearest_above(placed.join(settled, "id", "left_anti"), higher, keys, ISOLATION_CAP_M))
    iso = F.coalesce(F.least(F.sqrt("d2"), F.lit(ISOLATION_CAP_M)), F.lit(ISOLATION_CAP_M))
    return peaks.join(answers, "id", "left").withColumn("iso_m", iso).drop("d2")


def search_index(peaks: DataFrame, per_region: int = 400) -> DataFrame:
    """The best named peaks of each region; the number is taken before the nameless go."""
    known = F.col("wikidata").isNotNull()
    if "wikipedia" in peaks.columns:
        known = known | F.col("wikipedia").isNotNull()
    ranked = peaks.withColumn("score", scores.index_score(F.col("ele"), F.col("iso_m"), known))
    best = Window.partitionBy("region").orderBy(F.desc(F.round("score", 6)), "id")
    return ranked.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= per_region) & F.col("name").isNotNull())


def select_for_map(peaks: DataFrame, zoom: float, limit: int = 400) -> DataFrame:
    """The highest-scored peaks, one a name below zoom 14; nameless ones are kept."""
    score = F.round(scores.label_score(F.col("ele"), F.lit(0.0), F.col("iso_m")), 6)
    scored = peaks.withColumn("score", score)
    if zoom < 14:
        blank = F.coalesce(F.trim("name"), F.lit("")).isin("", "—")
        first = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("ele"), "id")
        named = scored.filter(~blank).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
        scored = named.unionByName(scored.filter(blank))
    return scored.orderBy(F.desc("score"), F.desc_nulls_last("ele"), "id").limit(limit)
