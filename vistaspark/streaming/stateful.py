"""Operators with a state that ends (survey L1, ST7, ST10, ST12, ST13): label memory, timers, first positions, the skyline tracker.

Each has a core that takes one frame or event and what is remembered. ``..._over`` folds it
over a table; the stateful processors run the same core over a stream, with the memory in
Spark's typed state: a map with a time to live, a list, a value, timers. A stream needs the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from vistaspark.operators.dealing import spread
from vistaspark.operators.layout import GAP, HEIGHT, LETTER, LIFT, MOST, PAD, SIDE_GAP

# Frames that a label without room is remembered; seconds that a call for calibration stands; frames of
# the tracker, the shifts it tries, columns that two profiles share, frames in which a column is seen, its jitter, and
# columns of a profile that others are aligned to.
REMEMBERED, CALL_S = 30, 15.0
# Seconds that a position is waited for, and that a cached one may be old.
POSITION_S, CACHED_S = 30.0, 300.0
#: A settled position's state ends after a day.
FORGET_MS = 86_400_000
FRAMES, MOST_SHIFT, LEAST_COMMON, LEAST_SEEN, JITTER, LEAST_REFERENCE = 10, 6, 20, 3, 0.03, 8


def frames_of(key: str, step: Callable[[pd.DataFrame, object], tuple[list[tuple], object]], columns: list[str]):
    """A function over Arrow batches sorted by key and frame: ``step`` takes the rows of a frame and what is remembered of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, memory, now = None, None, None

        def end() -> list[tuple]:
            nonlocal memory
            out, memory = step(held, memory)
            return out

        for batch in batches:
            rows = batch.to_pandas()
            out: list[tuple] = []
            cuts = np.flatnonzero((rows[[key, "frame"]] != rows[[key, "frame"]].shift()).any(axis=1))
            for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                part = rows.iloc[a:b]
                this = part[key].iloc[0], part["frame"].iloc[0]
                if held is not None and this == now:
                    held = pd.concat([held, part])
                    continue
                if held is not None:
                    out += end()
                    memory = memory if this[0] == now[0] else None
                held, now = part, this
            yield _batch(out, columns)
        if held is not None:
            yield _batch(end(), columns)

    return run


def _batch(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*[c.split() for c in columns], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(names), types, strict=True)], list(names))


# Labels that keep their place.

LABELS = ["view long", "frame long", "key string", "anchor int", "shift double"]


def place_frame(rows: pd.DataFrame, memory: dict[str, tuple[int, int]] | None) -> tuple[list[tuple], dict[str, tuple[int, int]]]:
    """L1, ST13: the labels of a frame (view, frame, key, text, x, y, rank) with a place, and what is remembered: key to (anchor, frames missed).

    Remembered labels come first, on their anchor if it is free; then by rank; over the point,
    right of it or left of it. One that has no room is remembered for ``REMEMBERED`` frames;
    one that isn't in the frame is forgotten.
    """
    memory, taken, out, kept = memory or {}, np.empty((0, 4)), [], {}
    rows = rows.assign(new=~rows["key"].isin(memory.keys())).sort_values(["new", "rank", "key"], kind="stable")
    for r in rows.itertuples():
        wide = min(MOST, LETTER * len(r.text) + PAD)
        shifts = (0.0, wide / 2 + SIDE_GAP, -(wide / 2 + SIDE_GAP))
        past = memory.get(r.key)
        first = [past[0]] if past else []
        for anchor in [*first, *(a for a in range(3) if a not in first)]:
            x, lift = r.x + shifts[anchor], LIFT if anchor else 0.0
            box = np.array([x - wide / 2 - GAP, r.y - HEIGHT - lift - GAP, x + wide / 2 + GAP, r.y + GAP])
            if not ((box[0] < taken[:, 2]) & (box[2] > taken[:, 0]) & (box[1] < taken[:, 3]) & (box[3] > taken[:, 1])).any():
                taken = np.vstack([taken, box])
                out.append((int(r.view), int(r.frame), r.key, anchor, shifts[anchor]))
                kept[r.key] = anchor, 0
                break
        else:
            if past and past[1] + 1 < REMEMBERED:
                kept[r.key] = past[0], past[1] + 1
    return out, kept


def labels_over(labels: DataFrame) -> DataFrame:
    """L1, ST13 over a table (view, frame, key, text, x, y, rank): view, frame, key, anchor, shift.

    A view's frames pass in order through one task, which holds one frame and its memory. Rows
    without a key, text or place are left out.
    """
    rows = labels.select("view", "frame", "key", "text", "x", "y", "rank").dropna(subset=["view", "frame", "key", "text", "x", "y"])
    ordered = spread(rows, "view").sortWithinPartitions("view", "frame", "rank", "key")
    return ordered.mapInArrow(frames_of("view", place_frame, LABELS), ", ".join(LABELS))


class LabelMemory(StatefulProcessor):
    """The same over a stream keyed by view. The anchors are a map whose entries end ``ttl_ms`` after they were last written."""

    def __init__(self, ttl_ms: int = 600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchors = handle.getMapState("anchors", "key string", "anchor int, missed int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        memory = {k[0]: (v[0], v[1]) for k, v in self.anchors.iterator()}
        before, out = dict(memory), []
        for _, frame in pd.concat(list(rows)).sort_values(["frame", "rank", "key"]).groupby("frame"):
            placed, memory = place_frame(frame, memory)
            out += placed
        for k in before.keys() - memory.keys():
            self.anchors.removeKey((k,))
        for k, v in memory.items():
            self.anchors.updateValue((k,), v)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LABELS])

    def close(self) -> None:
        pass


def labels_stream(labels: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """L1, ST13 over a stream of labels; the frames of a view must come in order from batch to batch."""
    rows = labels.select("view", "frame", "key", "text", "x", "y", "rank").dropna(subset=["view", "frame", "key", "text", "x", "y"])
    return rows.groupBy("view").transformWithStateInPandas(LabelMemory(ttl_ms), ", ".join(LABELS), "Append", "ProcessingTime")


# A flag that falls by itself.


def calls_over(calls: DataFrame, seconds: float = CALL_S) -> DataFrame:
    """ST12 over a table of calls (device, ts): device, at, raised: each rise, and the fall ``seconds`` after the last call of a run."""
    along = Window.partitionBy("device").orderBy("ts")
    late = F.make_dt_interval(secs=F.lit(seconds))
    rows = calls.filter("device IS NOT NULL AND ts IS NOT NULL").withColumn("again", F.lead("ts").over(along)).withColumn("before", F.lag("ts").over(along))
    rises = rows.filter(F.col("before").isNull() | (F.col("before") + late <= F.col("ts"))).select("device", F.col("ts").alias("at"), F.lit(True).alias("raised"))
    return rises.union(rows.filter(F.col("again").isNull() | (F.col("ts") + late <= F.col("again"))).select("device", (F.col("ts") + late).alias("at"), F.lit(False)))


class CallTimer(StatefulProcessor):
    """ST12: a call raises the flag of its device, a timer lowers it; a further call sets the timer anew."""

    def __init__(self, seconds: float = CALL_S):
        self.wait_ms = round(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out, until = [], self.until.get()[0] if self.until.exists() else None
        for ts in sorted(t for part in rows for t in part["ts"]):
            at = round(ts.timestamp() * 1000)
            if until is not None and until <= at:
                out.append((key[0], pd.Timestamp(until, unit="ms"), False))
                until = None
            if until is None:
                out.append((key[0], pd.Timestamp(at, unit="ms"), True))
            until = at + self.wait_ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.until.update((until,))
        self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["device", "at", "raised"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield pd.DataFrame([(key[0], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), False)], columns=["device", "at", "raised"])

    def close(self) -> None:
        pass


def calls_stream(calls: DataFrame, seconds: float = CALL_S, late: str = "0 seconds") -> DataFrame:
    """ST12 over a stream of calls (device, ts) in event time: the flag falls when the watermark passes its time, without a further call of the device."""
    rows = calls.select("device", "ts").dropna().withWatermark("ts", late)
    return rows.groupBy("device").transformWithStateInPandas(CallTimer(seconds), f"device {dict(calls.dtypes)['device'].replace('bigint', 'long')}, at timestamp, raised boolean", "Append", "EventTime")


# A first position, waited for.

POSITIONS = "at timestamp, kind string, lat double, lon double, trusted boolean"
KINDS, TRUSTED = ("url", "last", "cached", "receiver"), ("url", "cached", "receiver")


def _usable() -> Column:
    """Whether a fix says where the device is: of a known kind, in range, and of cached ones not too old."""
    inside = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return F.coalesce(F.col("kind").isin(*KINDS) & inside & ((F.col("kind") != "cached") | (F.col("age_s") <= CACHED_S)), F.lit(False))


def positions_over(fixes: DataFrame, fallback: tuple[float, float], seconds: float = POSITION_S) -> DataFrame:
    """ST10 over a table of a device's events (device, ts, kind, age_s, lat, lon): device, at, kind, lat, lon, trusted.

    The first event starts the wait; the first usable fix within ``seconds`` ends it, by kind
    where several come at once, else the fallback does.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    limit = F.make_dt_interval(secs=F.lit(seconds))
    rows = fixes.filter("device IS NOT NULL AND ts IS NOT NULL").withColumn("good", _usable())
    fix = F.when(F.col("good"), F.struct("ts", rank.alias("rank"), "kind", "lat", "lon"))
    best = rows.groupBy("device").agg(F.min("ts").alias("start"), F.min(fix).alias("fix"))
    timely = F.coalesce(F.col("fix.ts") < F.col("start") + limit, F.lit(False))
    pick = lambda c, other: F.when(timely, F.col(f"fix.{c}")).otherwise(other).alias("at" if c == "ts" else c)
    found = best.select("device", pick("ts", F.col("start") + limit), pick("kind", F.lit("fallback")), pick("lat", F.lit(fallback[0])), pick("lon", F.lit(fallback[1])))
    return found.withColumn("trusted", F.col("kind").isin(*TRUSTED))


class PositionWait(StatefulProcessor):
    """The same over a stream in event time: a timer gives the fallback to a device of which nothing usable comes."""

    def __init__(self, fallback: tuple[float, float], seconds: float = POSITION_S):
        self.fallback, self.wait_ms = fallback, round(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long, settled boolean")

    def _row(self, key, at: int, kind: str, lat: float, lon: float) -> pd.DataFrame:
        return pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), kind, lat, lon, kind in TRUSTED)], columns=["device", "at", "kind", "lat", "lon", "trusted"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        until, settled = self.until.get() if self.until.exists() else (None, False)
        if settled:
            return
        events = pd.concat(list(rows))
        events = events.assign(ms=[round(t.timestamp() * 1000) for t in events["ts"]], rank=events["kind"].map(dict(zip(KINDS, range(len(KINDS)), strict=True))))
        if until is None:
            until = int(events["ms"].min()) + self.wait_ms
            self.handle.registerTimer(until)
        fixes = events[events["good"] & (events["ms"] < until)].sort_values(["ms", "rank"])
        if len(fixes):
            first = fixes.iloc[0]
            self.handle.deleteTimer(until)
            self.handle.registerTimer(until + FORGET_MS)
            settled = True
            yield self._row(key, int(first["ms"]), first["kind"], float(first["lat"]), float(first["lon"]))
        self.until.update((until, settled))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[1]:
            self.until.clear()  # a device that comes again later waits again
            return
        self.until.update((at, True))
        self.handle.registerTimer(at + FORGET_MS)
        yield self._row(key, at, "fallback", *self.fallback)

    def close(self) -> None:
        pass


def positions_stream(fixes: DataFrame, fallback: tuple[float, float], seconds: float = POSITION_S, late: str = "0 seconds") -> DataFrame:
    """ST10 over a stream of a device's events."""
    rows = fixes.withColumn("good", _usable()).select("device", "ts", "kind", "lat", "lon", "good").dropna(subset=["device", "ts"]).withWatermark("ts", late)
    kind = dict(fixes.dtypes)["device"].replace("bigint", "long")
    return rows.groupBy("device").transformWithStateInPandas(PositionWait(fallback, seconds), f"device {kind}, {POSITIONS}", "Append", "EventTime")


# The skyline of a shaking camera.

TRACKED = ["session long", "frame long", "shift int", "ys array<double>", "variances array<double>"]


def aligned(raw: np.ndarray, shift: int) -> np.ndarray:
    """``raw`` moved by a shift of columns, NaN where it has none."""
    out = np.full(len(raw), np.nan)
    n = len(raw)
    out[max(0, -shift) : n - max(0, shift)] = raw[max(0, shift) : n + min(0, shift)]
    return out


def shift_against(raw: np.ndarray, reference: np.ndarray) -> int:
    """The shift of columns at which a profile differs least from the reference; the first of equal ones, 0 if too few columns are common."""
    best = (math.inf, 0)
    for s in range(-MOST_SHIFT, MOST_SHIFT + 1):
        off = aligned(raw, s) - reference
        off = off[np.isfinite(off)]
        if len(off) >= LEAST_COMMON:
            best = min(best, (round(float((off**2).mean()), 12), s))
    return best[1]


def track(raw: np.ndarray, buffer: list[np.ndarray], reference: np.ndarray | None, jitter: float = JITTER) -> tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray | None]:
    """ST7: one more profile: its shift, the median profile, the variances, and the last ``FRAMES`` aligned profiles and the next reference.

    Columns seen in fewer than ``LEAST_SEEN`` frames have neither, those that move more than
    ``jitter`` no median; the first profile stands as it is.
    """
    shift = 0 if reference is None else shift_against(raw, reference)
    buffer = [*buffer, aligned(raw, shift)][-FRAMES:]
    if len(buffer) == 1:
        ys, variances = buffer[0].copy(), np.where(np.isfinite(buffer[0]), 0.0, np.nan)
    else:
        stack = np.sort(np.stack(buffer), axis=0)  # NaN last
        n = np.isfinite(stack).sum(axis=0)
        middle = np.take_along_axis(stack, np.minimum(n // 2, len(buffer) - 1)[None], axis=0)[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            variances = np.where(n >= LEAST_SEEN, np.nansum((stack - middle) ** 2, axis=0) / n, np.nan)
            ys = np.where((n >= LEAST_SEEN) & (np.sqrt(variances) <= jitter), middle, np.nan)
    return shift, ys, variances, buffer, ys if np.isfinite(ys).sum() >= LEAST_REFERENCE else reference


def _numbers(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], float)


def _nulls(values: np.ndarray) -> list:
    return [None if math.isnan(v) else float(v) for v in values]


def _track_rows(rows: pd.DataFrame, memory: tuple | None, jitter: float) -> tuple[list[tuple], tuple]:
    buffer, reference = memory or ([], None)
    out = []
    for r in rows.itertuples():
        shift, ys, variances, buffer, reference = track(_numbers(r.ys), buffer, reference, jitter)
        out.append((int(r.session), int(r.frame), shift, _nulls(ys), _nulls(variances)))
    return out, (buffer, reference)


def tracked_over(profiles: DataFrame, jitter: float = JITTER) -> DataFrame:
    """ST7 over a table of profiles (session, frame, ys with nulls): session, frame, shift, ys, variances. All profiles of a session are as long."""
    rows = profiles.select("session", "frame", "ys").dropna(subset=["session", "frame", "ys"]).repartition("session").sortWithinPartitions("session", "frame")
    return rows.mapInArrow(frames_of("session", lambda r, m: _track_rows(r, m, jitter), TRACKED), ", ".join(TRACKED))


class SkylineTracker(StatefulProcessor):
    """The same over a stream keyed by session: the buffer is a list of the last profiles, the reference a value."""

    def __init__(self, jitter: float = JITTER, ttl_ms: int = 600_000):
        self.jitter, self.ttl_ms = jitter, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "ys array<double>", self.ttl_ms)
        self.reference = handle.getValueState("reference", "ys array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        reference = self.reference.get() if self.reference.exists() else None
        memory = [_numbers(v[0]) for v in self.buffer.get()], None if reference is None else _numbers(reference[0])
        out, (buffer, reference) = _track_rows(pd.concat(list(rows)).sort_values("frame"), memory, self.jitter)
        self.buffer.put([(_nulls(v),) for v in buffer])
        if reference is not None:
            self.reference.update((_nulls(reference),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED])

    def close(self) -> None:
        pass


def tracked_stream(profiles: DataFrame, jitter: float = JITTER, ttl_ms: int = 600_000) -> DataFrame:
    """ST7 over a stream of profiles; the frames of a session must come in order from batch to batch. A session unseen for ``ttl_ms`` is forgotten."""
    rows = profiles.select("session", "frame", "ys").dropna(subset=["session", "frame", "ys"])
    return rows.groupBy("session").transformWithStateInPandas(SkylineTracker(jitter, ttl_ms), ", ".join(TRACKED), "Append", "ProcessingTime")
