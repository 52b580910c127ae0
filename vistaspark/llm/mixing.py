"""Mixing sources to target weights.

Words are added up per source, targets found by filling to a common level with a cap per
source, and a document is taken ``floor(rate)`` times plus once more with the probability
of the fraction. That last copy is a Bernoulli draw from a hash of the document's id and a
seed. Each source takes, of ``SEEDS`` seeds, the one whose draws come nearest its target:
the sums for all seeds come out of one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.llm.common import WORD, materialise, small_side, text_of

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Eight draws of 32 bits come from each SHA-256.
BLOCKS = 4
SEEDS = 8 * BLOCKS


def word_count(column: str = "text"):
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def draw(seed: int):
    """The seed's draw for a document: 8 hex digits, uniform, compared as text."""
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed // 8))), 256)
    return F.substring(digest, 1 + 8 * (seed % 8), 8)


def source_targets(sized: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, whole, threshold) from rows (source, size).

    Sources in code-point order, null last, get the weights in turn. A target stops at
    ``most_repeats`` times the source's size and its excess goes to the others by weight,
    until none is above: with sources in the order of cap per weight, the first whose share
    fits under its cap fixes the level for all that follow. The windows run over one row
    per source.
    """
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("place") - 1, F.lit(n)) + 1).cast("int"))
    by_source = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most_repeats)
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = by_source.withColumn("level_here", left.cast("double") / weights_left)
    fits = F.col("level_here") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct(F.col("cap").cast("double") / F.col("weight"), "place", "level_here"))).over(everything)
    return (
        levels.withColumn("level", level["level_here"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("rate", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("threshold", F.lpad(F.lower(F.hex(F.floor((F.col("rate") - F.col("whole")) * F.lit(4294967296.0)).cast("long"))), 8, "0"))
        .select("source", "source_size", "target", "whole", "threshold")
    )


def mixing_rates(sized: DataFrame, **options) -> DataFrame:
    """The targets with the seed of each source. ``sized``: doc_id, source, size."""
    targets = source_targets(sized, **options).withColumnRenamed("source", "mix_source")
    targets = F.broadcast(targets) if _few_sources(sized) else targets
    pairs = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
    sums = pairs.groupBy("source").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.first("whole").alias("whole"),
        F.first("threshold").alias("threshold"),
        *[F.sum(F.when(draw(k) < F.col("threshold"), F.col("size")).otherwise(0)).alias(f"extra_{k}") for k in range(SEEDS)],
    )
    off = F.array_min(F.array(*[F.struct(F.abs(F.col("source_size") * F.col("whole") + F.col(f"extra_{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))
    return sums.withColumn("seed", off["seed"]).select("source", "source_size", "target", "whole", "threshold", "seed")


def _few_sources(sized: DataFrame) -> bool:
    return sized.select("source").distinct().count() <= 100_000


def with_copies(df: DataFrame, rates: DataFrame) -> DataFrame:
    """``df`` with source_size, target and copies; one narrow join by source, broadcast when the counted sources are few."""
    r = rates.withColumnRenamed("source", "mix_source")
    drawn = F.element_at(F.array(*[draw(k) for k in range(SEEDS)]), F.col("seed") + 1)
    return (
        df.join(small_side(r), F.col("source").eqNullSafe(F.col("mix_source")), "left")
        .withColumn("copies", F.col("whole") + (drawn < F.col("threshold")).cast("long"))
        .drop("mix_source", "whole", "threshold", "seed")
    )


def mix_plan(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null texts have size 0, a null source is a source of its own, repeated rows are drawn
    alike, and an empty table gives an empty result. Other columns are not read.
    """
    sized = materialise(df.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    rates = materialise(mixing_rates(sized), "mix-rates")
    return with_copies(sized, rates).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(df: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as its source's rate says, columns unchanged."""
    sized = materialise(df.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    rates = materialise(mixing_rates(sized), "mix-rates")
    whole_rows = df.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = with_copies(whole_rows, rates).filter("copies > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


_DRAWS = ",\n".join(
    f"sum(CASE WHEN substr(sha256(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{k // 8}'), {1 + 8 * (k % 8)}, 8) < threshold THEN size ELSE 0 END) AS extra_{k}"
    for k in range(SEEDS)
)
_OFFS = ", ".join(f"{{'off': abs(source_size * whole + extra_{k} - target), 'seed': {k}}}" for k in range(SEEDS))
_PICK = " ".join(
    f"WHEN {k} THEN substr(sha256(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{k // 8}'), {1 + 8 * (k % 8)}, 8)" for k in range(SEEDS)
)
#: The mix of a relation named ``mix_docs`` (doc_id, text, source) as CTEs ending in ``mixed`` (doc_id, size, source_size, target, copies).
MIX_CTES = rf"""
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM mix_docs
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM by_source
), levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level_here
  FROM weighted
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT level_here AS level FROM levels WHERE level_here * weight <= cap ORDER BY ratio, place LIMIT 1
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target FROM levels, level
), rates AS (
  SELECT *, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0) AS rate FROM targets
), cut AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS whole,
         lpad(printf('%x', CAST(floor((rate - floor(rate)) * 4294967296.0) AS BIGINT)), 8, '0') AS threshold
  FROM rates
), sums AS (
  SELECT c.source, any_value(c.source_size) AS source_size, any_value(c.target) AS target, any_value(c.whole) AS whole,
         any_value(c.threshold) AS threshold, {_DRAWS}
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source GROUP BY c.source
), seeded AS (
  SELECT *, list_sort([{_OFFS}])[1].seed AS seed FROM sums
), mixed AS (
  SELECT doc_id, size, source_size, target,
         whole + CASE WHEN (CASE seed {_PICK} END) < threshold THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN seeded r ON s.source IS NOT DISTINCT FROM r.source
)
"""
SQL = f"""
WITH mix_docs AS (SELECT doc_id, text, source FROM documents), {MIX_CTES}
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed
"""
