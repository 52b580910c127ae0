"""Target-distribution importance resampling over hashed word runs.

Counts of the buckets come out of one pass, the gains of the buckets are an array of fixed
length, and a second pass scores every document with it. An integer score has noise of the
document's id in it; the highest scores are the draw. Which those are comes out of the exact
histogram of scores: the counts above a score are its rank offset, and within a score the
rows are numbered by id, so nothing sorts the whole table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.llm.common import materialise, small_side

BUCKETS, LEAST_WORDS, SEED = 10_000, 20, 2024
#: Bytes split to words at a time, words whose bucket a task remembers, scores that one window sums up, about, and windows.
PIECE, REMEMBERED, WINDOW_SCORES, WINDOWS = 1 << 20, 500_000, 50_000, 256
#: A-Z become a-z; what is in no word becomes a space. All bytes from 0x80 on are in words.
_READ = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """The bucket of a feature, by the CRC-32 of its bytes."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length; a word is never cut."""
    data, at = text.translate(_READ), 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = cut if cut > at else data.find(b" ", end)
            end = cut if cut >= 0 else len(data)
        yield data[at:end].split()
        at = end


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        whole = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        yield batch, [x.as_py() or b"" for x in whole]


def feature_buckets(text: bytes, runs: int, known: _Buckets) -> Iterator[np.ndarray]:
    """The buckets of all runs of 1 to ``runs`` consecutive words, piece by piece."""
    before: list[bytes] = []
    for words in pieces(text):
        yield np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if runs > 1:
            tail, have = before + words, len(before)
            for n in range(2, runs + 1):
                ends = range(max(n, have + 1), len(tail) + 1)
                yield np.fromiter((known[b" ".join(tail[e - n : e])] for e in ends), np.int64, len(ends))
            before = tail[len(tail) - min(len(tail), runs - 1) :]


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of ``texts`` (text) each bucket has; a task sends one row a bucket, and the driver gets ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for _, found in _texts(batches, "text"):
            for text in found:
                for ids in feature_buckets(text, runs, known):
                    total += np.bincount(ids, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket 1000 times the log of how much likelier the target has it, rounded down; both sides smoothed by one."""
    k = len(source)
    s_all, t_all = int(source.sum()) + k, int(target.sum()) + k
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(of_bucket: np.ndarray, runs: int):
    buckets = len(of_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch, texts in _texts(batches, "text"):
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                for ids in feature_buckets(text, runs, known):
                    n[i] += len(ids)
                    weight[i] += of_bucket[ids].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"])

    return run


def noise(seed: int = SEED):
    """1000 times a Gumbel draw from the hash of the id (a null id counts as an empty one), rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def rank_offsets(histogram: DataFrame) -> DataFrame:
    """score, n, above: how many rows have a higher score. ``histogram``: score, n, a materialised table of distinct scores.

    Splitters cut the scores to windows of about equal length; a window's own offset is the
    sum of those above it, at most ``WINDOWS`` rows.
    """
    windows = max(1, min(WINDOWS, histogram.count() // WINDOW_SCORES))
    cuts = []
    if windows > 1:
        cuts = histogram.agg(F.percentile_approx("score", [i / windows for i in range(1, windows)], 100_000)).first()[0]
    block = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("score"))) if cuts else F.lit(0)
    dealt = histogram.withColumn("block", block)
    sums = dealt.groupBy("block").agg(F.sum("n").alias("all"))
    higher = sums.select("block", F.coalesce(F.sum("all").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(higher), "block").select("score", "n", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("above"))


def resample(
    df: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = 10, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``df`` (doc_id, text), drawn after ``target`` (text).

    Rank counts the drawn rows from 1, highest score first, ties to the smaller id (null ids
    last); rows not drawn have none. Null and empty texts have no features and weight 0, and
    fewer than ``least`` features keep a row out of the draw. Repeated rows are scored alike
    and each has a rank of its own. Texts of any length are read in pieces. An empty ``df``
    gives an empty result, an empty ``target`` equal targets for all buckets. Other columns
    are not read.
    """
    gain = gains(bucket_counts(df, runs, buckets), bucket_counts(target, runs, buckets))
    weighed = df.select("doc_id", "text").mapInArrow(_weights(gain, runs), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_features long, weight long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(seed)), "resample-scores")
    histogram = materialise(scored.filter(F.col("n_features") >= least).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "resample-histogram")
    draws = (histogram.agg(F.sum("n")).first()[0] or 0) * percent // 100
    offsets = materialise(rank_offsets(histogram).filter(F.col("above") < draws).select(F.col("score").alias("cut_score"), "above"), "resample-offsets")
    placed = scored.join(small_side(offsets), (F.col("n_features") >= least) & (F.col("score") == F.col("cut_score")), "left")
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    ranked = placed.filter("above IS NOT NULL").select(*out, place.alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return ranked.union(placed.filter("above IS NULL").select(*out, F.lit(None).cast("long").alias("rank")))


SQL = r"""
WITH RECURSIVE table_steps AS (
  SELECT range AS place, range AS value, 0 AS step FROM range(256)
  UNION ALL
  SELECT place, CASE WHEN value % 2 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, step + 1 FROM table_steps WHERE step < 8
), lookup AS (
  SELECT list(value ORDER BY place) AS crc_table FROM table_steps WHERE step = 8
), words AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (
  SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL
), bucketed AS (
  SELECT word, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(strlen(word) AS BIGINT)),
             lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 1, 1)) * 16 - 16 + strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 2, 1)) - 1 AS BIGINT))),
           lambda c, b: xor(c >> 8, crc_table[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), lookup
), sums AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted JOIN bucketed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
                                     / CAST((coalesce(s, 0) + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM sums
), weighed AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM counted JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
