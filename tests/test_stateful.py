"""Label memory, timers and the skyline tracker: streams that restart against the same over tables."""

import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
import pytest

from vistaspark.streaming import stateful

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """run(rows in batches, schema, operator): what a stream gives that is stopped and started again between the batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(batches, schema, operator, empty_batches):
        # a state that ends by the clock asks for batches without data for ever
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(empty_batches).lower())
        base = tmp_path_factory.mktemp("stream")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i:03d}")
            made = operator(spark.readStream.schema(schema).parquet(f"{base}/in/*"))
            q = made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
        return spark.read.parquet(f"{base}/out").collect()

    yield run
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


LABEL = "view long, frame long, key string, text string, x double, y double, rank int"


def plain_labels(rows):
    """The same by a plain loop over boxes."""
    out = []
    for view in sorted({r[0] for r in rows}):
        memory = {}
        for frame in sorted({r[1] for r in rows if r[0] == view}):
            items = sorted((r for r in rows if r[:2] == (view, frame)), key=lambda r: (r[2] not in memory, r[6], r[2]))
            boxes, fresh = [], {}
            for _, _, key, text, x, y, _ in items:
                wide = min(148, 6.5 * len(text) + 8)
                order = [memory[key][0]] if key in memory else []
                for a in order + [a for a in (0, 1, 2) if a not in order]:
                    shift = (0, wide / 2 + 10, -wide / 2 - 10)[a]
                    box = (x + shift - wide / 2 - 2, y - 16 - (14 if a else 0) - 2, x + shift + wide / 2 + 2, y + 2)
                    if all(box[0] >= b[2] or box[2] <= b[0] or box[1] >= b[3] or box[3] <= b[1] for b in boxes):
                        boxes.append(box)
                        out.append((view, frame, key, a, shift))
                        fresh[key] = (a, 0)
                        break
                else:
                    if key in memory and memory[key][1] < 29:
                        fresh[key] = (memory[key][0], memory[key][1] + 1)
            memory = fresh
    return out


def moving_labels(frames):
    rng = np.random.default_rng(5)
    at = rng.uniform(0, 220, (2, 14, 2))
    return [(v, f, f"k{i}", f"Peak {i}", float(at[v, i, 0] + 25 * math.sin(f / 3 + i)), float(at[v, i, 1] + f), int(i * 5 % 14)) for v in range(2) for f in range(frames) for i in range(14) if (f + i) % 11]


def rows_of(found):
    return sorted((r["view"], r["frame"], r["key"], r["anchor"], round(r["shift"], 6)) for r in found)


def test_labels_keep_their_anchor(spark):
    rows = moving_labels(45)
    got = rows_of(stateful.labels_over(spark.createDataFrame(rows[::-1], LABEL)).collect())
    assert got == sorted((*r[:4], round(float(r[4]), 6)) for r in plain_labels(rows))
    assert len({(v, k, a) for v, _, k, a, _ in got}) > 40
    odd = [(None, 1, "a", "t", 0.0, 0.0, 1), (1, 1, None, "t", 0.0, 0.0, 1), (1, 1, "a", None, 0.0, 0.0, 1)]
    assert stateful.labels_over(spark.createDataFrame(odd, LABEL)).count() == 0


def blocked(frames):
    """A label on its right anchor, then in the way of two remembered ones for some frames, then free again."""
    wall = [(0, f, k, "W" * 20, x, 100.0, 0) for f in range(1, frames + 1) for k, x in (("left", 20.0), ("mid", 130.0), ("right", 240.0))]
    first = [(0, 0, "left", "W" * 20, 20.0, 100.0, 0), (0, 0, "mid", "W" * 20, 130.0, 40.0, 0), (0, 0, "right", "W" * 20, 240.0, 40.0, 0), (0, 0, "low", "low", 100.0, 100.0, 9)]
    return first + wall + [(0, f, "low", "low", 130.0, 100.0, 9) for f in range(1, frames + 1)] + [(0, frames + 1, "low", "low", 400.0, 100.0, 9)]


@pytest.mark.parametrize("missed, anchor", [(1, 1), (29, 1), (30, 0)])
def test_a_label_without_room_is_remembered_for_some_frames(missed, anchor):
    frames = pd.DataFrame(blocked(missed), columns=[c.split()[0] for c in LABEL.split(", ")])
    memory, seen = None, {}
    for f, rows in frames.groupby("frame"):
        placed, memory = stateful.place_frame(rows, {"low": (1, 0)} if f == 0 else memory)
        seen |= {(f, p[2]): p[3] for p in placed}
    assert seen[0, "low"] == 1 and (1, "low") not in seen and seen[missed + 1, "low"] == anchor


def test_labels_over_a_stream_that_restarts(spark, stream):
    rows = moving_labels(9)
    batches = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 3), (3, 4), (4, 9))]
    assert rows_of(stream(batches, LABEL, stateful.labels_stream, False)) == rows_of(stateful.labels_over(spark.createDataFrame(rows, LABEL)).collect())


def test_the_flag_falls_by_itself(spark, stream):
    start = dt.datetime(2024, 5, 1, 12)
    at = lambda s: start + dt.timedelta(seconds=s)
    schema = "device long, ts timestamp"
    batches = [[(1, at(0)), (2, at(1)), (2, at(9))], [(1, at(10))], [(3, at(60))], [(3, at(61)), (2, at(62))], [(4, at(200))], [(4, at(201))]]
    every = [r for b in batches for r in b]
    seen = {(r["device"], (r["at"] - start).total_seconds(), r["raised"]) for r in stream(batches, schema, stateful.calls_stream, True)}
    # device 1 calls at 0 and 10 and never again: its flag falls at 25, when the others' time has passed that
    assert {(1, 0, True), (1, 25, False), (2, 1, True), (2, 24, False), (2, 62, True), (2, 77, False), (3, 60, True), (3, 76, False)} <= seen
    table = {(r["device"], (r["at"] - start).total_seconds(), r["raised"]) for r in stateful.calls_over(spark.createDataFrame([*every, (None, at(1)), (9, None)], schema)).collect()}
    # the last device's flag still stands in the stream
    assert table - seen == {(4, 216, False)} and seen <= table


def test_a_position_is_waited_for(spark, stream):
    start = dt.datetime(2024, 5, 1, 12)
    at = lambda s: start + dt.timedelta(seconds=s)
    schema, nan = "device long, ts timestamp, kind string, age_s double, lat double, lon double", float("nan")
    first = [(1, at(0), "start", None, None, None), (2, at(0), "start", None, None, None), (3, at(0), "url", None, 43.0, 42.0), (3, at(0), "receiver", None, 1.0, 1.0), (4, at(1), "cached", 900.0, 5.0, 5.0), (5, at(1), "url", None, 99.0, 42.0), (6, at(1), "start", None, None, None)]
    second = [(1, at(10), "receiver", None, 44.0, 41.0), (4, at(9), "last", None, 6.0, 6.0), (5, at(3), "cached", 100.0, 7.0, 7.0), (6, at(40), "receiver", None, 3.0, 3.0)]
    third = [(3, at(60), "receiver", None, 2.0, 2.0), (9, at(100), "start", None, None, None)]
    fourth = [(9, at(101), "url", None, nan, 1.0)]
    got = stream([first, second, third, fourth], schema, lambda f: stateful.positions_stream(f, (50.0, 10.0)), True)
    seen = {r["device"]: ((r["at"] - start).total_seconds(), r["kind"], r["lat"], r["lon"], r["trusted"]) for r in got}
    assert len(got) == len(seen) == 6
    assert seen == {1: (10, "receiver", 44, 41, True), 2: (30, "fallback", 50, 10, False), 3: (0, "url", 43, 42, True), 4: (9, "last", 6, 6, False), 5: (3, "cached", 7, 7, True), 6: (31, "fallback", 50, 10, False)}
    every = [*first, *second, *third, *fourth, (None, at(1), "url", None, 1.0, 1.0), (8, None, "url", None, 1.0, 1.0)]
    table = {r["device"]: ((r["at"] - start).total_seconds(), r["kind"], r["lat"], r["lon"], r["trusted"]) for r in stateful.positions_over(spark.createDataFrame(every, schema), (50.0, 10.0)).collect()}
    assert table == {**seen, 9: (130, "fallback", 50, 10, False)}


PROFILE = "session long, frame long, ys array<double>"


def profiles(frames):
    rng = np.random.default_rng(11)
    base = 0.5 + 0.2 * np.sin(np.arange(70) / 6) + 0.05 * np.sin(np.arange(70) / 1.7)
    out = []
    for s in range(3):
        for f in range(frames):
            shake = int(rng.integers(-5, 6))
            y = base[3 + shake : 67 + shake] if 0 <= 3 + shake and 67 + shake <= 70 else base[3:67]
            y = y + rng.normal(0, 0.004, 64) + np.where(np.arange(64) % 13 == s, rng.normal(0, 0.3), 0)
            out.append((s, f, [None if rng.random() < 0.15 or f == 4 and s == 1 else float(v) for v in y]))
    return out


def plain_track(rows):
    out = {}
    for s in {r[0] for r in rows}:
        buffer, ref = [], None
        for _, f, raw in sorted(r for r in rows if r[0] == s):
            shift, best = 0, math.inf
            for k in range(-6, 7) if ref else ():
                pairs = [(raw[x + k], ref[x]) for x in range(64) if 0 <= x + k < 64 and raw[x + k] is not None and ref[x] is not None]
                err = sum((a - b) ** 2 for a, b in pairs) / len(pairs) if len(pairs) >= 20 else math.inf
                if err < best - 1e-12:
                    shift, best = k, err
            buffer = [*buffer, [raw[x + shift] if 0 <= x + shift < 64 else None for x in range(64)]][-10:]
            ys, variances = [], []
            for x in range(64):
                seen = sorted(b[x] for b in buffer if b[x] is not None)
                if len(buffer) == 1:
                    ys.append(buffer[0][x])
                    variances.append(None if buffer[0][x] is None else 0.0)
                    continue
                if len(seen) < 3:
                    ys.append(None)
                    variances.append(None)
                    continue
                middle = statistics.median_high(seen)
                variances.append(sum((v - middle) ** 2 for v in seen) / len(seen))
                ys.append(middle if math.sqrt(variances[-1]) <= 0.03 else None)
            if sum(y is not None for y in ys) >= 8:
                ref = ys
            out[s, f] = shift, ys, variances
    return out


def same(a, b):
    return all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)) for x, y in zip(a, b, strict=True))


def test_the_tracker_is_a_plain_loop(spark):
    rows = profiles(25)
    got = stateful.tracked_over(spark.createDataFrame([*rows[::-1], (None, 1, [0.5]), (5, 1, None)], PROFILE)).collect()
    want = plain_track(rows)
    assert len(got) == len(want)
    for r in got:
        shift, ys, variances = want[r["session"], r["frame"]]
        assert r["shift"] == shift and same(r["ys"], ys) and same(r["variances"], variances)
    assert len({r["shift"] for r in got}) > 4


def test_the_tracker_over_a_stream_that_restarts(spark, stream):
    rows = profiles(14)
    batches = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 5), (5, 12), (12, 14))]
    got = stream(batches, PROFILE, stateful.tracked_stream, False)
    want = {(r["session"], r["frame"]): r for r in stateful.tracked_over(spark.createDataFrame(rows, PROFILE)).collect()}
    assert len(got) == len(want)
    for r in got:
        w = want[r["session"], r["frame"]]
        assert r["shift"] == w["shift"] and same(r["ys"], w["ys"]) and same(r["variances"], w["variances"])


def test_tracked_columns_are_the_window_of_ten(spark):
    """Without shake the tracker is the median over the nine frames before and this one."""
    rng = np.random.default_rng(2)
    base = rng.random(40)
    rows = [(1, f, [float(v) for v in base + rng.normal(0, 0.003, 40)]) for f in range(30)]
    got = {r["frame"]: r for r in stateful.tracked_over(spark.createDataFrame(rows, PROFILE)).collect()}
    for f in range(2, 30):
        seen = np.array([r[2] for r in rows[max(0, f - 9) : f + 1]])
        assert got[f]["shift"] == 0 and got[f]["ys"] == pytest.approx(np.sort(seen, axis=0)[len(seen) // 2])
