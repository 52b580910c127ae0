"""Filters over sensor readings, each query with its SQL: a recursion over a device's readings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.plans import fixtures as fx
from vistaspark.plans.registry import query
from vistaspark.streaming import filters, stateful

TURN = repr(2 * math.pi)
#: Some readings say nothing: null or NaN. ``known_az`` and ``known_roll`` hold the others, numbered by themselves.
READINGS = """readings AS (SELECT event_id, user_id AS device, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 17 = 3 THEN NULL WHEN event_id % 17 = 5 THEN CAST('nan' AS DOUBLE) ELSE radians((value * 7.3e0) % 360) END AS az,
  CASE WHEN event_id % 19 = 4 THEN NULL WHEN event_id % 19 = 7 THEN CAST('nan' AS DOUBLE) ELSE radians((value * 3.7e0) % 200 - 100) END AS roll, CASE WHEN event_id % 19 = 4 THEN NULL WHEN event_id % 19 = 7 THEN CAST('nan' AS DOUBLE) ELSE (value * 3.7e0) % 200 - 100 END AS roll_deg, event_type = 'click' AS flag,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
known_az AS (SELECT * EXCLUDE (n), n AS place, row_number() OVER (PARTITION BY device ORDER BY n) AS n FROM readings WHERE isfinite(az)),
known_roll AS (SELECT * EXCLUDE (n), n AS place, row_number() OVER (PARTITION BY device ORDER BY n) AS n FROM readings WHERE isfinite(roll))"""


def filled(columns: str) -> str:
    """What stands at a reading that says nothing: the last that did. ``f`` has event_id and the columns."""
    each = ", ".join(f"last_value(f.{c} IGNORE NULLS) OVER (PARTITION BY r.device ORDER BY r.n) AS {c}" for c in columns.split(", "))
    return f"filled AS (SELECT r.event_id, {each} FROM readings r LEFT JOIN f USING (event_id))"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v, k = fx.table(spark, sf_dir, "events"), F.col("value"), F.col("event_id")
    some = lambda reading, n, null, nan: F.when(k % n == null, F.lit(None)).when(k % n == nan, F.lit(float("nan"))).otherwise(reading)
    return e.select(
        "event_id", F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), some(F.radians(v * F.lit(7.3) % 360), 17, 3, 5).alias("az"),
        some(F.radians(v * F.lit(3.7) % 200 - 100), 19, 4, 7).alias("roll"), some(v * F.lit(3.7) % 200 - 100, 19, 4, 7).alias("roll_deg"), (F.col("event_type") == "click").alias("flag"),
    )


def short(a: str) -> str:
    """Into (-pi, pi]."""
    return f"({a} - {TURN} * ceil(({a} - pi()) / {TURN}))"


def norm(a: str) -> str:
    return f"({a} - {TURN} * floor({a} / {TURN}))"


OFF = short("(m.mean - f.az)")


@query(f"""WITH RECURSIVE {READINGS}, m AS (SELECT *, atan2(avg(sin(az)) OVER w, avg(cos(az)) OVER w) AS mean FROM known_az WINDOW w AS (PARTITION BY device ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
f(device, n, event_id, az) AS (SELECT device, n, event_id, {norm('mean')} FROM m WHERE n = 1 UNION ALL SELECT m.device, m.n, m.event_id, {norm(f'(f.az + {OFF} * least(1e0, greatest(0.12e0, abs({OFF}) / 0.14e0)))')} FROM f JOIN m ON m.device = f.device AND m.n = f.n + 1),
{filled("az")} SELECT event_id, round(sin(az), 6) AS s, round(cos(az), 6) AS c FROM filled""")
def followed_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: the mean of the last readings, followed the faster the farther it is off."""
    made = filters.folded(readings(spark, sf_dir), lambda state, row: {"followed": filters.follow_step(state, row["az"])}, "followed double", reads=["az"])
    return made.select("event_id", F.round(F.sin("followed"), 6).alias("s"), F.round(F.cos("followed"), 6).alias("c"))


@query(f"""WITH RECURSIVE {READINGS}, f(device, n, event_id, t, roll) AS (SELECT device, n, event_id, t, roll FROM known_roll WHERE n = 1 UNION ALL
  SELECT m.device, m.n, m.event_id, m.t, CASE WHEN m.t > f.t THEN f.roll + {short('(m.roll - f.roll)')} * (1 - exp(-least(0.5e0, m.t - f.t) / 0.25e0)) ELSE m.roll END FROM f JOIN known_roll m ON m.device = f.device AND m.n = f.n + 1),
{filled("roll")} SELECT event_id, round(roll, 6) AS roll FROM filled""")
def smoothed_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: an exponential mean of the roll."""
    made = filters.folded(readings(spark, sf_dir), lambda state, row: {"smoothed": filters.roll_step(state, row["t"], row["roll"])}, "smoothed double", reads=["t", "roll"])
    return made.select("event_id", F.round("smoothed", 6).alias("roll"))


SIDE = "CASE WHEN m.roll_deg > 75 THEN 1 WHEN m.roll_deg < -75 THEN -1 ELSE f.side END"
FORM = "CASE WHEN f.form = 'landscape' THEN CASE WHEN abs(m.roll_deg) < 40 THEN 'portrait' ELSE 'landscape' END WHEN abs(m.roll_deg) > 75 THEN 'landscape' ELSE 'portrait' END"
FLIPS = f"(({FORM}) <> f.form OR ({FORM}) = 'landscape' AND ({SIDE}) <> f.side) AND m.t - f.t >= 0.6e0"


@query(f"""WITH RECURSIVE {READINGS}, f(device, n, event_id, t, form, side) AS (SELECT device, n, event_id, t, CASE WHEN abs(roll_deg) > 75 THEN 'landscape' ELSE 'portrait' END, CASE WHEN roll_deg > 75 THEN 1 WHEN roll_deg < -75 THEN -1 ELSE 0 END FROM known_roll WHERE n = 1 UNION ALL
  SELECT m.device, m.n, m.event_id, CASE WHEN {FLIPS} THEN m.t ELSE f.t END, CASE WHEN {FLIPS} THEN {FORM} ELSE f.form END, CASE WHEN {FLIPS} THEN {SIDE} ELSE f.side END FROM f JOIN known_roll m ON m.device = f.device AND m.n = f.n + 1),
{filled("form, side")} SELECT event_id, coalesce(form, 'portrait') AS form, CAST(coalesce(side, 0) AS INT) AS side FROM filled""")
def held_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, W17: portrait or landscape with hysteresis and a pause between changes."""
    made = filters.folded(readings(spark, sf_dir), lambda state, row: dict(zip(("form", "side"), filters.form_step(state, row["t"], row["roll_deg"]), strict=True)), "form string, side long", reads=["t", "roll_deg"])
    return made.select("event_id", "form", F.col("side").cast("int").alias("side"))


@query(f"""WITH RECURSIVE {READINGS}, told AS (SELECT * EXCLUDE (az, roll), CASE WHEN isfinite(az) THEN az END AS az, CASE WHEN isfinite(roll) THEN roll END AS roll FROM readings),
past AS (SELECT *, last_value(az IGNORE NULLS) OVER b AS a, last_value(roll IGNORE NULLS) OVER b AS r, lag(flag) OVER (PARTITION BY device ORDER BY n) AS fl FROM told WINDOW b AS (PARTITION BY device ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f(device, n, event_id, t, said) AS (SELECT device, n, event_id, t, true FROM past WHERE n = 1 UNION ALL
  SELECT m.device, m.n, m.event_id, CASE WHEN coalesce(abs({short('(m.az - m.a)')}) > 0.0017e0, false) OR coalesce(abs({short('(m.roll - m.r)')}) > 0.0017e0, false) OR m.t - f.t > 0.1e0 OR m.fl <> m.flag THEN m.t ELSE f.t END,
  coalesce(abs({short('(m.az - m.a)')}) > 0.0017e0, false) OR coalesce(abs({short('(m.roll - m.r)')}) > 0.0017e0, false) OR m.t - f.t > 0.1e0 OR m.fl <> m.flag FROM f JOIN past m ON m.device = f.device AND m.n = f.n + 1) SELECT event_id, said FROM f""")
def emitted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: states that are passed on."""
    made = filters.folded(readings(spark, sf_dir), lambda state, row: {"said": filters.emit_step(state, row["t"], row["az"], row["roll"], row["flag"])}, "said boolean", reads=["t", "az", "roll", "flag"])
    return made.select("event_id", "said")


@query(f"""WITH RECURSIVE {READINGS}, f(device, n, t, visit) AS (SELECT device, n, t, 1 FROM readings WHERE n = 1 UNION ALL
  SELECT m.device, m.n, CASE WHEN m.t - f.t >= 1800 THEN m.t ELSE f.t END, CASE WHEN m.t - f.t >= 1800 THEN 1 ELSE 0 END FROM f JOIN readings m ON m.device = f.device AND m.n = f.n + 1)
SELECT device, CAST(sum(visit) AS BIGINT) AS visits, count(*) AS events FROM f GROUP BY device""")
def counted_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: visits that begin half an hour after the last one that was counted."""
    made = filters.folded(readings(spark, sf_dir), lambda state, row: {"visit": filters.visit_step(state, row["t"])}, "visit boolean", reads=["t"])
    return made.groupBy("device").agg(F.count_if("visit").alias("visits"), F.count(F.lit(1)).alias("events"))


def fused_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST4: gyroscope and compass together. No SQL; the tests hold it against a plain loop."""
    rows = readings(spark, sf_dir).withColumn("kind", F.when(F.col("event_id") % 3 == 0, "gyroscope").otherwise("compass")).withColumn("absolute", F.col("event_id") % 4 != 0).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("roll") / 10).otherwise(F.col("az")))
    return filters.folded(rows, filters.fused_step, "azimuth double", reads=["t", "kind", "absolute", "value"]).select("event_id", F.round("azimuth", 6).alias("azimuth"))


def overlay_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST16: when the drawn overlay is made anew. No SQL; the tests hold it against a plain loop."""
    made = filters.folded(readings(spark, sf_dir), lambda state, row: {"drawn": filters.overlay_step(state, *(None if row[c] is None else row[c] / 50 for c in ("az", "roll")), 900.0, 200.0)}, "drawn boolean", reads=["az", "roll"])
    return made.select("event_id", "drawn")


CALLS = "calls AS (SELECT user_id AS device, ts, lag(ts) OVER w AS past, lead(ts) OVER w AS next FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts))"


@query(f"""WITH {CALLS} SELECT device, epoch_us(ts) AS at_us, true AS raised FROM calls WHERE past IS NULL OR past + INTERVAL 1 HOUR <= ts
UNION ALL SELECT device, epoch_us(ts + INTERVAL 1 HOUR), false FROM calls WHERE next IS NULL OR ts + INTERVAL 1 HOUR <= next""")
def calibration_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: when the flag of each device rises and falls by itself, an hour after the last call."""
    calls = fx.table(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"))
    return stateful.calls_over(calls, 3600.0).select("device", F.unix_micros("at").alias("at_us"), "raised")


@query("""WITH f AS (SELECT user_id AS device, ts, CASE event_type WHEN 'purchase' THEN 'cached' WHEN 'error' THEN 'receiver' WHEN 'signup' THEN 'last' ELSE 'start' END AS kind, value * 5 AS age_s, value % 80 AS lat, value * 1.5e0 % 170 AS lon FROM events),
g AS (SELECT *, kind <> 'start' AND (kind <> 'cached' OR age_s <= 300) AS good FROM f), b AS (SELECT device, min(ts) AS start, min({'ts': ts, 'rank': CASE kind WHEN 'last' THEN 2 WHEN 'cached' THEN 3 ELSE 4 END, 'kind': kind, 'lat': lat, 'lon': lon}) FILTER (good) AS fix FROM g GROUP BY device)
SELECT device, CASE WHEN coalesce(fix.ts < start + INTERVAL 10 HOUR, false) THEN fix.kind ELSE 'fallback' END AS kind, round(CASE WHEN coalesce(fix.ts < start + INTERVAL 10 HOUR, false) THEN fix.lat ELSE 50e0 END, 6) AS lat, coalesce(fix.ts < start + INTERVAL 10 HOUR, false) AND fix.kind <> 'last' AS trusted FROM b""")
def first_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: the first usable position of every device, or the fallback."""
    v, t = F.col("value"), F.col("event_type")
    kind = F.when(t == "purchase", "cached").when(t == "error", "receiver").when(t == "signup", "last").otherwise("start")
    fixes = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (v * 5).alias("age_s"), (v % 80).alias("lat"), (v * 1.5 % 170).alias("lon"))
    return stateful.positions_over(fixes, (50.0, 10.0), 36_000.0).select("device", "kind", F.round("lat", 6).alias("lat"), "trusted")


#: Queries without SQL.
WITHOUT_SQL = {"fused_azimuth": fused_azimuth, "overlay_refreshes": overlay_refreshes}
