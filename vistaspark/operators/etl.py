"""From tagged map nodes to peaks (survey F1-F7, F14, A17, J7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaspark.functions import geo
from vistaspark.operators.regions import split_boxes

# Tags of summits, and the tags that are kept.
SUMMITS = ("peak", "volcano")
WANTED = ("natural", "name", "name:ru", "name:en", "ele", "wikidata")


def _tag(tags: Column, key: str) -> Column:
    """A tag, an empty one as none."""
    return F.nullif(tags[key], F.lit(""))


def pick_name(tags: Column) -> Column:
    """F1."""
    return F.coalesce(_tag(tags, "name:ru"), _tag(tags, "name"), _tag(tags, "name:en"))


def parse_ele(raw: Column) -> Column:
    """metres written with commas or a unit; null for anything else."""
    cleaned = F.trim(F.translate(raw, ",m", ""))
    return F.when(cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cleaned.try_cast("double"))


def wanted_tags(tags: Column) -> Column:
    """F4."""
    return F.map_filter(tags, lambda k, v: k.isin(*WANTED))


def summits(nodes: DataFrame) -> DataFrame:
    """the nodes (lat, lon, tags) that are peaks or volcanoes."""
    return nodes.filter(F.col("tags")["natural"].isin(*SUMMITS)).withColumn("tags", wanted_tags(F.col("tags")))


def peaks_of(nodes: DataFrame) -> DataFrame:
    """summits with a name, as peaks; other columns stay."""
    tags = F.col("tags")
    rows = summits(nodes).withColumn("name", pick_name(tags)).filter("name IS NOT NULL")
    return (
        rows.withColumn("name_ru", _tag(tags, "name:ru"))
        .withColumn("name_en", _tag(tags, "name:en"))
        .withColumn("ele", F.bround(parse_ele(tags["ele"]), 0).cast("int"))
        .withColumn("wikidata", _tag(tags, "wikidata"))
        .withColumn("volcano", tags["natural"] == "volcano")
        .withColumn("lat", F.round("lat", 6))
        .withColumn("lon", F.round("lon", 6))
        .drop("tags")
    )


def counts(nodes: DataFrame, box: tuple[float, float, float, float], by: list[str] = ()) -> DataFrame:
    """What became of the summits: outside the box, without a name, without a height, volcanoes, written.

    Counts of parts are added up by Spark's partial aggregation; ``by`` gives them by key.
    """
    low_lon, low_lat, high_lon, high_lat = (F.lit(float(v)) for v in box)
    rows = summits(nodes).select("*", low_lon.alias("min_lon"), low_lat.alias("min_lat"), high_lon.alias("max_lon"), high_lat.alias("max_lat"))
    tags, inside = F.col("tags"), geo.in_bbox(F.col("lat"), F.col("lon"))
    named = inside & pick_name(tags).isNotNull()
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("peaks"),
        F.count_if(~inside).alias("outside"),
        F.count_if(inside & pick_name(tags).isNull()).alias("no_name"),
        F.count_if(named & parse_ele(tags["ele"]).isNull()).alias("no_ele"),
        F.count_if(named & (tags["natural"] == "volcano")).alias("volcanoes"),
        F.count_if(named).alias("written"),
    )


def cell_priorities(cells: DataFrame, regions: DataFrame, default: int) -> DataFrame:
    """Of each cell of one degree (lat, lon: its south-western corner) the best priority of the regions that overlap it.

    Regions are cut at the antimeridian and dealt to the cells that they touch: an equi-join.
    """
    boxes = split_boxes(regions)
    span = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), (F.ceil(b) - 1).cast("int")))
    touched = boxes.withColumn("lon", span(F.col("part.lo"), F.col("part.hi"))).withColumn("lat", span(F.col("min_lat"), F.col("max_lat")))
    best = touched.groupBy("lat", "lon").agg(F.min(F.coalesce("priority", F.lit(default))).alias("priority"))
    return cells.join(best, ["lat", "lon"], "left").withColumn("priority", F.coalesce("priority", F.lit(default)))


def wanted_cells(cells: DataFrame, regions: DataFrame | None = None, priorities: list[int] | None = None) -> DataFrame:
    """cells that overlap one of the regions, and of the wanted priorities."""
    if regions is not None:
        cells = _overlapping(cells, regions)
    return cells if priorities is None else cells.filter(F.col("priority").isin(*priorities))


def _overlapping(cells: DataFrame, regions: DataFrame) -> DataFrame:
    hit = cell_priorities(cells.select("lat", "lon").distinct(), regions.withColumn("priority", F.lit(0)), -1).filter("priority = 0")
    return cells.join(hit.select("lat", "lon"), ["lat", "lon"], "left_semi")
