"""Sensor events: sessions, means, latest request, windows with watermarks (survey ST2, ST8-ST13, ST15, ST17)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visits(events: DataFrame, minutes: int = 30) -> DataFrame:
    """ST11 in batch: runs of a device's events with gaps under ``minutes``."""
    along = Window.partitionBy("device").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(along))
    opens = F.coalesce(gap >= minutes * 60_000_000, F.lit(True)).cast("int")
    return events.withColumn("opens", opens).groupBy("device").agg(F.sum("opens").cast("long").alias("visits"), F.count(F.lit(1)).alias("events"))


def circular_mean_of_five(events: DataFrame) -> DataFrame:
    """The mean direction of a device's last five samples, which the follow filter of ST2 takes in."""
    last = Window.partitionBy("device").orderBy("ts", "event_id").rowsBetween(-4, 0)
    a = F.radians("azimuth_deg")
    mean = F.atan2(F.avg(F.sin(a)).over(last), F.avg(F.cos(a)).over(last))
    return events.withColumn("mean_rad", F.when(mean < 0, mean + 2 * math.pi).otherwise(mean))


def latest_request(requests: DataFrame) -> DataFrame:
    """ST8, ST9: of each channel the newest request."""
    return requests.groupBy("channel").agg(F.max("request").alias("request"), F.max_by("payload", "request").alias("payload"))


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """ST15: events and their mean value in tumbling windows; a stream drops what is later than ``late``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """ST15, ST11: a device's events without a longer gap between them, as Spark's session windows."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "device").agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, width: str = "10 minutes", step: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    """ST15: counts in windows that overlap."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width, step).alias("w"), "device").agg(F.count(F.lit(1)).alias("n"))


def without_repeats(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """ST15: each event once; a stream forgets ids when the watermark has passed them."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def best_position(fixes: DataFrame) -> DataFrame:
    """ST10: of each device the position by precedence: of the address, the last one, a cached fix of at most five minutes, the receiver, the fallback. The last one and the fallback aren't trusted.

    ``fixes``: device, kind (url, last, cached, receiver, fallback), age_s, lat, lon.
    """
    kinds = ("url", "last", "cached", "receiver", "fallback")
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    good = (rank > 0) & ((F.col("kind") != "cached") | (F.col("age_s") <= 300))
    best = fixes.filter(good).groupBy("device").agg(F.min_by(F.struct("lat", "lon", "kind"), rank).alias("p"))
    return best.select("device", "p.*", F.col("p.kind").isin("url", "cached", "receiver").alias("trusted"))


def with_expiry(flags: DataFrame, seconds: float = 15.0) -> DataFrame:
    """ST12, ST13: each raising of a flag (device, t) with the time it falls by itself, later if it was raised again before."""
    along = Window.partitionBy("device").orderBy("t")
    again = F.lead("t").over(along)
    return flags.withColumn("falls", F.when(again - F.col("t") > seconds, F.col("t") + seconds).when(again.isNull(), F.col("t") + seconds))


def still_current(replies: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """ST9, ST17: the replies whose request is still the one that is asked for."""
    return replies.join(requests.select(*keys), keys, "left_semi")
