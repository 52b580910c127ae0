"""Filters over readings: against plain loops, and over a stream as over a table."""

import math

import pytest
from pyspark.sql import functions as F

from vistaspark.plans import sensors as plans
from vistaspark.streaming import filters, sensors

SF = "/root/testdata/sf0.001"
STEP = {"followed double": lambda state, row: {"followed": filters.follow_step(state, row["az"])}}


def test_follow_filter_damps_and_turns():
    state = {}
    for _ in range(20):
        filters.follow_step(state, 1.0)
    small = filters.follow(1.0, 1.01)
    assert small == pytest.approx(1.0012) and filters.follow(1.0, 2.0) == pytest.approx(2.0)
    assert filters.follow(0.001, 2 * math.pi - 0.1) > 6


NOTHING = [None, math.nan, math.inf]


@pytest.mark.parametrize("nothing", NOTHING)
def test_readings_that_say_nothing_change_nothing(nothing):
    assert filters.follow(1.0, nothing) == 1.0 and filters.follow(nothing, 1.0) == 1.0 and filters.follow(nothing, nothing) == 0.0
    state, plain = {}, {}
    assert filters.follow_step(state, nothing) is None
    for azimuth in (0.1, nothing, 0.4, nothing, nothing, 0.5):
        made = filters.follow_step(state, azimuth)
        if azimuth is not nothing:
            wanted = filters.follow_step(plain, azimuth)
        assert made == wanted
    roll = {}
    assert filters.roll_step(roll, 0.0, nothing) is None and filters.roll_step(roll, 1.0, 0.2) == 0.2 == filters.roll_step(roll, 1.1, nothing)
    assert filters.roll_step(roll, 1.5, 0.4) == pytest.approx(0.2 + 0.2 * (1 - math.exp(-2)))
    form = {}
    assert filters.form_step(form, 0.0, nothing) == ("portrait", 0) and filters.form_step(form, 1.0, 80) == ("landscape", 1) == filters.form_step(form, 9.0, nothing)
    said = {}
    assert filters.emit_step(said, 0.0, nothing, 0.0, False) and not filters.emit_step(said, 0.01, 1.0, nothing, False)
    assert not filters.emit_step(said, 0.02, nothing, 0.0, False) and filters.emit_step(said, 0.03, 1.1, 0.0, False)
    fused = {}
    assert filters.compass_step(fused, 0.0, nothing) is None and filters.turn_step(fused, 0.0, nothing) is None
    filters.turn_step(fused, 0.1, 0.0)
    first = filters.compass_step(fused, 0.12, 1.0)
    assert filters.compass_step(fused, 0.14, nothing) == first and filters.turn_step(fused, 0.15, nothing) is None
    assert filters.compass_step(fused, 0.16, 1.0) == first
    drawn = {}
    assert filters.overlay_step(drawn, nothing, 0.0, 900.0, 200.0) and not filters.overlay_step(drawn, 0.0, nothing, 900.0, 200.0)


def test_fused_azimuth_against_a_loop(spark):
    rows = plans.readings(spark, SF).orderBy("device", "ts", "event_id").collect()
    states, want = {}, {}
    for r in rows:
        k, state = r["event_id"], states.setdefault(r["device"], {})
        gyro = k % 3 == 0
        made = filters.fused_step(state, {"t": r["t"], "kind": "gyroscope" if gyro else "compass", "absolute": k % 4 != 0, "value": (r["roll"] if r["roll"] is None else r["roll"] / 10) if gyro else r["az"]})
        if made:
            want[k] = round(made["azimuth"], 6)
    got = {r["event_id"]: r["azimuth"] for r in plans.fused_azimuth(spark, SF).collect()}
    assert got == pytest.approx(want)


def test_compass_jumps_are_taken_over_only_when_they_last():
    state = {}
    filters.turn_step(state, 0.0, 0.0)
    filters.compass_step(state, 0.05, 1.0)
    for k in range(1, 3):
        filters.turn_step(state, 0.05 + k * 0.02, 0.0)
        assert abs(filters.compass_step(state, 0.06 + k * 0.02, 2.0) - 1.0) < 0.1
    filters.turn_step(state, 0.115, 0.0)
    assert filters.compass_step(state, 0.12, 2.0) == pytest.approx(2.0)
    assert filters.takes_reading(state := {}, 0.0, True) and not filters.takes_reading(state, 5.0, False) and filters.takes_reading(state, 11.0, False)


def test_form_holds_between_its_thresholds():
    state, out = {}, []
    for k, roll in enumerate([0, 60, 80, 60, 45, 39, 80, -80]):
        out.append(filters.form_step(state, k * 1.0, roll)[0][0])
    assert "".join(out) == "pplllpll"
    assert filters.form_step(state, 7.1, 0)[0] == "landscape"


def test_overlay_is_drawn_anew_on_drift_and_every_thirty_frames():
    state, drawn = {}, []
    for k in range(40):
        drawn.append(filters.overlay_step(state, 1.0, 0.0, 900.0, 200.0))
    assert [k for k, x in enumerate(drawn) if x] == [0, 30]
    assert filters.overlay_step(state, 1.0 + 150 / 900, 0.0, 900.0, 200.0)


def test_stream_as_table(spark, tmp_path):
    table = plans.readings(spark, SF)
    table.repartition(1).sortWithinPartitions("ts", "event_id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    (made, step), = STEP.items()
    query = filters.folded_stream(stream, step, made).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rounded = lambda v: None if v is None else round(v, 9)
    got = {r["event_id"]: rounded(r["followed"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["event_id"]: rounded(r["followed"]) for r in filters.folded(table, step, made).collect()}
    assert got == want and len(got) == table.count()


def arriving(spark, path, rows):
    """A stream in which each row arrives by itself."""
    for k, (i, ts) in enumerate(rows):
        df = spark.createDataFrame([(i, "d", ts, "click", 1.0)], "event_id long, device string, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(spark.read.parquet(f"{path}/000").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def ended(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    rows = [(1, "2026-01-01 00:01:00"), (2, "2026-01-01 00:02:00"), (3, "2026-01-01 03:00:00"), (7, "2026-01-01 04:00:00"), (4, "2026-01-01 00:03:00"), (5, "2026-01-01 06:00:00"), (6, "2026-01-01 09:00:00")]
    got = {r["w"]["start"].strftime("%H:%M"): r["n"] for r in ended(spark, sensors.windowed_counts(arriving(spark, tmp_path, rows)), "late")}
    assert got["00:00"] == 2 and got["03:00"] == 1


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    rows = [(1, "2026-01-01 00:01:00"), (1, "2026-01-01 00:02:00"), (2, "2026-01-01 00:03:00"), (2, "2026-01-01 00:03:00")]
    assert sorted(r["event_id"] for r in ended(spark, sensors.without_repeats(arriving(spark, tmp_path, rows)), "once")) == [1, 2]


def test_positions_by_precedence(spark):
    rows = [("a", "fallback", 0.0, 1.0, 1.0), ("a", "cached", 400.0, 2.0, 2.0), ("b", "cached", 20.0, 3.0, 3.0), ("b", "receiver", 0.0, 4.0, 4.0), ("c", "url", 0.0, 5.0, 5.0), ("c", "last", 0.0, 6.0, 6.0), ("d", "last", 0.0, 7.0, 7.0)]
    got = {r["device"]: (r["lat"], r["trusted"]) for r in sensors.best_position(spark.createDataFrame(rows, "device string, kind string, age_s double, lat double, lon double")).collect()}
    assert got == {"a": (1.0, False), "b": (3.0, True), "c": (5.0, True), "d": (7.0, False)}


def test_flags_fall_by_themselves(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 100.0)], "device string, t double")
    assert [r["falls"] for r in sensors.with_expiry(rows).orderBy("t").collect()] == [None, 25.0, 115.0]
    asked = spark.createDataFrame([("a", 3)], "channel string, request int")
    replies = spark.createDataFrame([("a", 2, "old"), ("a", 3, "new")], "channel string, request int, body string")
    assert [r["body"] for r in sensors.still_current(replies, asked, ["channel", "request"]).collect()] == ["new"]


def test_sessions_and_sliding_windows(spark):
    rows = spark.createDataFrame([(1, "d", 0), (2, "d", 1700), (3, "d", 4000), (4, "e", 10)], "event_id long, device string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("value", F.lit(1.0))
    assert sorted((r["device"], r["n"]) for r in sensors.sessions(rows).collect()) == [("d", 1), ("d", 2), ("e", 1)]
    assert sensors.sliding_counts(rows).agg(F.sum("n")).first()[0] == 8
