"""Filter interaction audit over the lattice of subsets of filters.

Whatever the order of the filters, a document meets a filter with some set of others already
applied: an edge of the lattice of subsets. What a document does on an edge depends on which
filters it fails alone, so documents are counted by the set they fail (and part and labels),
the counts give the edges, and every step of every order is one edge of its path.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.llm.common import WORD, materialise, text_of

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(column: str = "text") -> Column:
    """The filters A to D that a text fails, as bits 1, 2, 4, 8."""
    text = text_of(column)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def failures(df: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: how many documents fail exactly the filters of ``mask`` (bits 1 to 16 for A to E).

    Rows are counted by text before anything looks for the smallest id of a text, so many
    copies of a text are a few rows.
    """
    read = df.select(
        "doc_id",
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.xxhash64(text_of()).alias("h1"),
        F.xxhash64(F.lit(7), text_of()).alias("h2"),
        text_failures().alias("mask"),
    )
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    kind = ["h1", "h2", "part", "mask", "good", "toxic", "no_id"]
    rows = read.join(marked, "doc_id", "left").fillna(False, ["good", "toxic"]).withColumn("no_id", F.col("doc_id").isNull())
    by_id = rows.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("c"))
    by_text = by_id.groupBy(*kind).agg(F.sum("c").alias("n"), F.min(F.struct("doc_id", "c")).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("h1", "h2"))
    first_ones = F.when(F.col("no_id"), F.col("n")).when(F.col("first.doc_id") == smallest, F.col("first.c")).otherwise(0)
    split = by_text.withColumn("kept_ones", first_ones)
    out = F.explode(F.array(F.struct("mask", F.col("kept_ones").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept_ones")).alias("n"))))
    return split.select("part", "good", "toxic", out.alias("x")).groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def lattice_edges(masks: DataFrame) -> DataFrame:
    """part, applied, filter and the counts of the 80 edges (set already applied, next filter) a part, zeros included.

    ``orders``: how many of the 120 orders pass the edge.
    """
    edges = [(s, 1 << f) for f in range(5) for s in range(32) if not s >> f & 1]
    lattice = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(math.factorial(s.bit_count()) * math.factorial(4 - s.bit_count())).alias("orders")) for s, f in edges]))
    each = masks.select("*", lattice.alias("edge")).select("*", "edge.*")
    before, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(F.col("filter")) != 0
    count = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    return each.groupBy("part", "applied", "filter", "orders").agg(
        count(~before & ~fails).alias("kept"),
        count(~before & fails).alias("removed"),
        count(before & fails).alias("redundant"),
        count(F.col("mask") == F.col("filter")).alias("unique_fails"),
        count(~before & fails & F.col("good")).alias("good_lost"),
        count(~before & fails & F.col("toxic")).alias("toxic_lost"),
    )


def audit(df: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step (1 to 5), the counts of the step's edge, and shapley: 600 rows a part.

    ``df``: doc_id, text, lang; ``labels``: doc_id, quality, toxic. A null text is empty, a
    null lang the part of the empty string. A null id is neither smaller than another nor
    labelled, so such rows pass E; rows that repeat the smallest id of their text pass it,
    too. A document with several label rows is good or toxic if any of them says so. Texts are
    read whole, however long. Empty ``df``: no part, no row. Other columns are not read.
    """
    edges = lattice_edges(materialise(failures(df, labels), "audit-masks"))
    of_filter = Window.partitionBy("part", "filter")
    edges = edges.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(of_filter))
    paths = [
        (sum(1 << LETTERS.index(x) for x in order[:i]), 1 << LETTERS.index(order[i]), "".join(order), i + 1)
        for order in itertools.permutations(LETTERS) for i in range(5)
    ]
    steps = df.sparkSession.createDataFrame(paths, "applied int, filter int, filter_order string, step int")
    return edges.join(F.broadcast(steps), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), masked AS (
  SELECT t.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN labels l ON t.doc_id = l.doc_id
), letters AS (
  SELECT chr(CAST(65 + range AS INT)) AS letter, CAST(1 << range AS INT) AS bit FROM range(5)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, CAST(range + 1 AS INT) AS step, bits[range + 1] AS filter, coalesce(list_sum(bits[1:range]), 0)::INT AS applied FROM orders, range(5)
), counted AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM masked GROUP BY ALL
), out AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN mask & (applied | filter) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & applied = 0 AND mask & filter <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & applied <> 0 AND mask & filter <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = filter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN good AND mask & applied = 0 AND mask & filter <> 0 THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN toxic AND mask & applied = 0 AND mask & filter <> 0 THEN n ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM out
"""
