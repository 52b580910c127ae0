"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort puts equal
ones next to each other, and the window compares neighbours in full. Splitters are drawn
over a short prefix and a 64-bit hash of the text, so what the sample brings to the driver
has a fixed width however long the texts are; equal texts share both and stay together.
A group that holds more than ``1 / HOT_SHARE`` of all rows gets a salt, so that the sort
deals it to many tasks; its few local winners are then compared by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.llm.common import ASCII_SPACE, materialise, small_side, text_of

#: A group is hot when it has more than this share of the rows; so there are at most as many hot groups.
HOT_SHARE = 2048
#: Smallest count of a hot group.
HOT_LEAST = 200
#: Salts of a hot group at least, and its rows that one salt has at most, about.
SALTS, SALT_ROWS = 64, 50_000


def normalised(column: str = "text"):
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(text_of(column), ASCII_SPACE, "")


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with most code points in the original text stays,
    then the one with the smallest id (null ids last). Null texts count as empty and are
    equal to each other; of wholly repeated rows exactly one has ``kept``. An empty table
    gives an empty result. Other columns of ``df`` are not read.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.length(text_of(text_col)).cast("long").alias("code_points"),
        normalised(text_col).alias("norm"),
    ).withColumn("hash", F.xxhash64("norm"))
    hot_rows = max(HOT_LEAST, df.count() // HOT_SHARE)
    # at most HOT_SHARE rows, since the counts add up to the rows of the table
    counted = materialise(rows.groupBy("hash").count().filter(F.col("count") > hot_rows), "content-hot")
    salts = max(salts, -(-(counted.agg(F.max("count")).first()[0] or 0) // SALT_ROWS))
    hot = counted.select("hash", F.lit(True).alias("hot"))
    salted = (
        rows.join(F.broadcast(hot), "hash", "left")
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(0).cast("int"))
        .withColumn("prefix", F.substring("norm", 1, 16))
    )
    equal = Window.partitionBy("prefix", "hash", "salt", "norm")
    best_first = equal.orderBy(F.desc("code_points"), F.asc_nulls_last("doc_id"))
    local = materialise(
        salted.repartitionByRange("prefix", "hash", "salt").select(
            "doc_id",
            "code_points",
            "hot",
            "salt",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.row_number().over(best_first).alias("place"),
            F.first("doc_id").over(best_first).alias("local_keep"),
            F.count(F.lit(1)).over(equal).alias("local_size"),
        ),
        "content-sort",
    )
    # of the hot groups, one winner a salt: at most HOT_SHARE * salts rows, merged to HOT_SHARE rows
    merged = (
        local.filter("hot AND place = 1")
        .groupBy("text_sha256")
        .agg(
            F.min(F.struct((-F.col("code_points")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "salt")).alias("best"),
            F.sum("local_size").alias("all_size"),
        )
        .select("text_sha256", F.col("best.doc_id").alias("best_id"), F.col("best.salt").alias("best_salt"), "all_size")
    )
    joined = local.join(F.broadcast(merged), "text_sha256", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("hot"), F.col("best_id")).otherwise(F.col("local_keep")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("local_size")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | (F.col("salt") == F.col("best_salt")))).alias("kept"),
        "text_sha256",
    )


def one_of_each(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (doc_id, text, ...) that stay, columns unchanged, one for each normalised text.

    Rows that go are told by id. Where an id is null or stands on several rows, by id and
    digest, and of the rows alike in both the first with most code points stays.
    """
    found = materialise(content_sort(df), "content-kept")
    several = materialise(found.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")), "content-several")
    gone = materialise(found.filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct(), "content-gone")
    plain = df.filter("doc_id IS NOT NULL").join(small_side(several), F.col("doc_id") == F.col("__id"), "left_anti")
    plain = plain.join(small_side(gone), F.col("doc_id") == F.col("__id"), "left_anti")
    odd = df.join(small_side(several), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    odd = odd.withColumn("__sha", F.sha2(normalised().cast("binary"), 256))
    alike = Window.partitionBy("doc_id", "__sha").orderBy(F.desc(F.length(text_of())))
    odd = odd.withColumn("__place", F.row_number().over(alike)).filter("__place = 1")
    stays = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept_sha"))
    odd = odd.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
    return plain.select(*[f"`{c}`" for c in df.columns]).union(odd.select(*[f"`{c}`" for c in df.columns]))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER best AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER best = 1 AS kept
  FROM d
  WINDOW best AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256
FROM w
"""
