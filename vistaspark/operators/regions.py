"""Regions: boxes that contain a point, are near it, or take it in (survey J2-J5, G9, G13, G15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.functions import geo

# Priority of a region that names none, reach of the nearest-region search, degrees of a grid cell.
NO_PRIORITY, REACH_M, CELL = 9, 200000.0, 2.0


def split_boxes(regions: DataFrame) -> DataFrame:
    """Boxes across the antimeridian as two."""
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.col("min_lon"), F.col("max_lon")
    parts = F.when(lo <= hi, F.array(part(lo, hi))).otherwise(F.array(part(lo, F.lit(180.0)), part(F.lit(-180.0), hi)))
    return regions.withColumn("part", F.explode(parts))


def containing(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Every pair of a point and a region that contains it, met in grid cells."""
    cells = split_boxes(regions)
    span = lambda a, b: F.explode(F.sequence(F.floor(a / CELL), F.floor(b / CELL)))
    cells = cells.withColumn("gx", span(F.col("part.lo"), F.col("part.hi"))).withColumn("gy", span(F.col("min_lat"), F.col("max_lat"))).drop("part")
    cells = cells.dropDuplicates(["ord", "gx", "gy"])
    placed = points.withColumn("gx", F.floor(F.col("lon") / CELL)).withColumn("gy", F.floor(F.col("lat") / CELL))
    return placed.join(cells, ["gx", "gy"]).filter(geo.in_bbox(F.col("lat"), F.col("lon"))).drop("gx", "gy")


def _reached(regions: DataFrame) -> DataFrame:
    """The grid cells that a box widened by the reach touches; columns wrap around the globe."""
    margin = REACH_M / geo.DEGREE_M + 0.01
    south, north = F.greatest(F.lit(-90.0), F.col("min_lat") - margin), F.least(F.lit(90.0), F.col("max_lat") + margin)
    side = F.least(F.lit(180.0), F.lit(margin) / F.greatest(F.lit(0.01), F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))))
    columns = int(360 / CELL)
    first, last = F.floor((F.col("part.lo") - side) / CELL), F.floor((F.col("part.hi") + side) / CELL)
    rows = split_boxes(regions).withColumn("gx", F.explode(F.sequence(first, F.least(last, first + columns - 1)))).withColumn("gx", F.pmod("gx", F.lit(columns)))
    return rows.withColumn("gy", F.explode(F.sequence(F.floor(south / CELL), F.floor(north / CELL)))).drop("part").dropDuplicates(["ord", "gx", "gy"])


def region_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The containing region of the best priority, else the nearest within reach.

    Points meet only the boxes that touch their grid cell, as they are for the containing
    and widened by the reach for the nearest; only points that no box contains ask for that.
    """
    boxes = regions.select("ord", F.col("region").alias("found"), "min_lon", "max_lon", "min_lat", "max_lat", F.coalesce("priority", F.lit(NO_PRIORITY)).alias("priority"))
    places = points.select("id", "lat", "lon")
    own = containing(places, boxes).groupBy("id").agg(F.min(F.struct("priority", "ord", "found")).alias("own"))
    outside = places.join(own, "id", "left_anti").withColumn("gx", F.pmod(F.floor(F.col("lon") / CELL), F.lit(int(360 / CELL)))).withColumn("gy", F.floor(F.col("lat") / CELL))
    away = F.round(geo.bbox_distance_m(F.col("lat"), F.col("lon")), 3)
    near = outside.join(_reached(boxes), ["gx", "gy"]).withColumn("d", away).filter(F.col("d") <= REACH_M)
    near = near.groupBy("id").agg(F.min(F.struct("d", "priority", "ord", "found")).alias("near"))
    best = places.select("id").join(own, "id", "left").join(near, "id", "left")
    return best.select("id", F.coalesce("own.found", "near.found").alias("region"), F.col("own").isNotNull().alias("inside"), F.col("near.d").alias("distance_m"))
