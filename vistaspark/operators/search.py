"""Search by name: exact and partial hits, typos when there are none, one hit a place (survey X8-X11, W9, M4, T2, U1, U2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistaspark.functions import scores, text


def restricted_distance(a: str, b: str, most: int) -> int:
    """Edits between two words, neighbours changing places as one, no letter edited twice; over ``most``: one more."""
    if a == b or abs(len(a) - len(b)) > most:
        return 0 if a == b else most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _least_typos(candidates, typed: str, most: int):
    """The least distance from what was typed to one of the candidates."""

    @F.pandas_udf("int")
    def least(rows: pd.Series) -> pd.Series:
        return pd.Series([min((restricted_distance(typed, c, most) for c in row), default=most + 1) for row in rows], dtype="int32")

    return least(candidates)


def _near(candidates, typed: str, most: int):
    """The forms that can lie within ``most`` edits: of like length, and by twice as many plain edits."""
    wanted = F.lit(typed)
    return F.filter(candidates, lambda c: (F.abs(F.length(c) - len(typed)) <= most) & (F.levenshtein(c, wanted, 2 * most) >= 0))


def _typed(spark: SparkSession, typed: str) -> tuple[str, str]:
    r = spark.range(1).select(text.normalised(F.lit(typed)).alias("q"), text.plain(F.lit(typed)).alias("p")).first()
    return r["q"], r["p"]


NAMES = ("name", "name_ru", "name_en")


def _names(peaks: DataFrame) -> list:
    return [F.col(c) if c in peaks.columns else F.lit(None).cast("string") for c in NAMES]


def exact_hits(peaks: DataFrame, wanted: str) -> DataFrame:
    """Peaks a name of which equals or contains what is wanted; nothing is contained by an empty wish."""
    quality = text.match_quality(_names(peaks), F.lit(wanted)) if wanted else F.lit(None).cast("boolean")
    return peaks.withColumn("exact", quality).filter("exact IS NOT NULL").withColumn("typos", F.lit(0))


def fuzzy_hits(peaks: DataFrame, wanted: str, plain: str) -> DataFrame:
    """X11: peaks a spelling of which lies within the typos that the length of the typed name allows."""
    most = 0 if len(plain) < 5 else 1 if len(plain) <= 8 else 2
    if not wanted or not most:
        return peaks.limit(0).withColumn("exact", F.lit(False)).withColumn("typos", F.lit(0))
    known = [F.coalesce(n, F.lit("")) for n in _names(peaks)]
    as_typed = F.filter(F.flatten(F.array(*[text.forms(n) for n in known])), lambda c: c != "")
    latin = F.filter(F.flatten(F.array(*[text.forms(n, latin=True) for n in known])), lambda c: c != "")
    rows = peaks.withColumn("forms", as_typed).filter(F.exists("forms", lambda c: F.length(c) <= len(plain) + most))
    rows = rows.withColumn("forms", _near(F.col("forms"), plain, most)).withColumn("latin", _near(latin, wanted, most))
    rows = rows.filter((F.size("forms") > 0) | (F.size("latin") > 0))
    typos = F.least(_least_typos(F.col("forms"), plain, most), _least_typos(F.col("latin"), wanted, most))
    return rows.withColumn("typos", typos).drop("forms", "latin").filter(F.col("typos") <= most).withColumn("exact", F.lit(False))


def merged(hits: DataFrame, lat: float, lon: float, limit: int = 12) -> DataFrame:
    """Of each place the best hit (exact, fewest typos, first source), by score; ties in the order of arrival."""
    km = F.hypot((F.col("lat") - lat) * 111.32, (F.col("lon") - lon) * 111.32 * F.cos(F.radians(F.lit(lat))))
    key = Window.partitionBy(text.hit_key(F.col("lat"), F.col("lon")))
    arrival = F.struct("source", "id")
    one = hits.withColumn("n", F.row_number().over(key.orderBy(F.desc("exact"), "typos", "source", "id"))).withColumn("arrived", F.min(arrival).over(key)).filter("n = 1").drop("n")
    scored = one.withColumn("score", F.round(scores.hit_score(F.col("ele"), F.col("exact"), F.col("typos"), km), 4))
    return scored.orderBy(F.desc("score"), "arrived").limit(limit).drop("arrived")


def search(sources: list[DataFrame], typed: str, lat: float, lon: float, limit: int = 12) -> DataFrame:
    """Hits over all sources (id, lat, lon, ele, name, name_ru, name_en) in their order of precedence.

    Typos are looked for only where nothing fits as typed: whether something does is one
    short job.
    """
    peaks = None
    for i, source in enumerate(sources):
        part = source.withColumn("source", F.lit(i))
        peaks = part if peaks is None else peaks.unionByName(part, allowMissingColumns=True)
    wanted, plain = _typed(peaks.sparkSession, typed)
    hits = exact_hits(peaks, wanted)
    if not hits.agg(F.count(F.lit(1))).first()[0]:
        hits = fuzzy_hits(peaks, wanted, plain)
    return merged(hits, lat, lon, limit)
