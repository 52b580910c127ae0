"""Filters over a device's readings that carry a state from one to the next (survey ST1-ST6, ST11, ST16).

A step takes the state (a small dict, empty at first) and a reading, changes the state and
returns what comes out. ``folded`` runs a step over a table: the readings of a device lie in
one partition in the order of time and pass one by one, so memory holds one state, however
long the device has been watched. ``folded_stream`` runs the same step over a stream, with
the state kept by Spark.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values of the filters: samples of the mean, least share and angle of following, seconds of the
# decays, the jump that is taken over and how often it must be seen, limits of gaps in time.
MEAN_OF, LEAST_FOLLOW, FOLLOW_RAD = 5, 0.12, 0.14
ROLL_S, ROLL_GAP_S, GYRO_S, GYRO_GAP_S, GYRO_ALIVE_S, ABSOLUTE_LOST_S = 0.25, 0.5, 1.5, 0.1, 0.5, 10.0
SNAP_RAD, SNAP_SEEN, MUTE_AFTER, MUTE_WINDOW_S = 0.35, 3, 3, 10.0
EMIT_RAD, EMIT_S = 0.0017, 0.1
LANDSCAPE_DEG, PORTRAIT_DEG, FLIP_S = 75.0, 40.0, 0.6
REVISIT_S = 1800.0
TURN = 2 * math.pi


def _norm(a: float) -> float:
    return a % TURN


def _short(a: float) -> float:
    """Into (-pi, pi]."""
    a = math.fmod(a, TURN)
    return a - TURN if a > math.pi else a + TURN if a <= -math.pi else a


def _told(x: float | None) -> bool:
    """Whether a reading says something: sensors give null or NaN where they have nothing."""
    return x is not None and math.isfinite(x)


def follow(past: float | None, target: float | None) -> float:
    """ST2: the picture follows the compass, the more the farther it is off; a side that says nothing leaves it to the other."""
    if not _told(target):
        return _norm(past) if _told(past) else 0.0
    if not _told(past):
        return _norm(target)
    off = _short(target - past)
    return _norm(past + off * min(1.0, max(LEAST_FOLLOW, abs(off) / FOLLOW_RAD)))


def follow_step(state: dict, azimuth: float | None) -> float | None:
    """ST2: the circular mean of the last samples, followed. A reading that says nothing changes nothing; None before the first that does."""
    if not _told(azimuth):
        return state.get("az")
    last = state["last"] = [*state.get("last", []), azimuth][-MEAN_OF:]
    mean = math.atan2(sum(map(math.sin, last)) / len(last), sum(map(math.cos, last)) / len(last))
    state["az"] = follow(state["az"], mean) if "az" in state else _norm(mean)
    return state["az"]


def roll_step(state: dict, t: float, roll: float | None) -> float | None:
    """ST3: a light exponential mean; the first reading as it is. A reading that says nothing changes nothing."""
    if not _told(roll):
        return state.get("roll")
    gap = min(ROLL_GAP_S, t - state["t"]) if "t" in state else 0.0
    state["roll"] = state["roll"] + _short(roll - state["roll"]) * (1 - math.exp(-gap / ROLL_S)) if gap > 0 else roll
    state["t"] = t
    return state["roll"]


def form_step(state: dict, t: float, roll_deg: float | None) -> tuple[str, int]:
    """ST6: portrait or landscape, and the side, changing past a threshold and not again for a while; portrait before any roll is known."""
    if not _told(roll_deg):
        return state.get("form", "portrait"), state.get("side", 0)
    side = 1 if roll_deg > LANDSCAPE_DEG else -1 if roll_deg < -LANDSCAPE_DEG else state.get("side", 0)
    lying = abs(roll_deg) >= PORTRAIT_DEG if state.get("form") == "landscape" else abs(roll_deg) > LANDSCAPE_DEG
    form = "landscape" if lying else "portrait"
    first = "form" not in state
    changed = first or form != state["form"] or form == "landscape" and side != state["side"]
    if changed and (first or t - state["t"] >= FLIP_S):
        state.update(form=form, side=side, t=t)
    return state["form"], state["side"]


def visit_step(state: dict, t: float) -> bool:
    """ST11: a new visit, counted from the last one that was counted."""
    if "t" in state and t - state["t"] < REVISIT_S:
        return False
    state["t"] = t
    return True


def emit_step(state: dict, t: float, azimuth: float | None, roll: float | None, uncalibrated: bool) -> bool:
    """ST5: whether a state is passed on: it turned, some time has gone by, or its flag changed. An angle that says nothing stays what it was."""
    past = state.get("past")
    known = [now if _told(now) else was for now, was in zip((azimuth, roll), past or (None, None), strict=False)]
    state["past"] = [*known, uncalibrated]
    turned = past is not None and any(_told(was) and abs(_short(now - was)) > EMIT_RAD for now, was in zip(known, past, strict=False))
    said = past is None or turned or t - state["t"] > EMIT_S or past[2] != uncalibrated
    if said:
        state["t"] = t
    return said


def takes_reading(state: dict, t: float, absolute: bool) -> bool:
    """ST4: relative readings count only while no absolute one has come, or not for some seconds."""
    if absolute:
        state["absolute_t"] = t
    return absolute or "absolute_t" not in state or t - state["absolute_t"] > ABSOLUTE_LOST_S


def _snap(state: dict, t: float, off: float) -> bool:
    """ST1: a large jump to one side is taken over once it was seen some times in a row; the gyroscope is muted after a few."""
    side = 0 if abs(off) <= SNAP_RAD else 1 if off > 0 else -1
    state["run"] = 0 if not side else state.get("run", 0) + 1 if side == state.get("side") else 1
    state["side"] = side
    if state["run"] < SNAP_SEEN:
        return False
    state.update(run=0, side=0, snaps=[x for x in state.get("snaps", []) if t - x < MUTE_WINDOW_S] + [t])
    state["muted"] = state.get("muted", False) or len(state["snaps"]) >= MUTE_AFTER
    return True


def turn_step(state: dict, t: float, rate: float | None) -> float | None:
    """ST1: the gyroscope's turn (radians a second to the right), added up; None while there is nothing to add to, or for a rate that says nothing."""
    if not _told(rate):
        return None
    gap = min(t - state["gyro_t"], GYRO_GAP_S) if "gyro_t" in state else GYRO_GAP_S
    state["gyro_t"] = t
    if state.get("muted") or gap <= 0 or ("fused" not in state and "az" not in state):
        return None
    state["fused"] = _norm(state.get("fused", state.get("az")) + rate * gap)
    return state["fused"]


def compass_step(state: dict, t: float, azimuth: float | None) -> float | None:
    """ST1: the compass slowly draws the gyroscope's sum; without a live gyroscope it is followed by itself. A reading that says nothing changes nothing."""
    if not _told(azimuth):
        return state.get("fused", state.get("az"))
    gap = t - state["compass_t"] if "compass_t" in state else 0.0
    state["compass_t"] = t
    if state.get("muted") or t - state.get("gyro_t", -math.inf) >= GYRO_ALIVE_S:
        if "fused" in state:
            state.setdefault("az", state.pop("fused"))
        return follow_step(state, azimuth)
    if "fused" not in state:
        state.update(fused=azimuth, run=0, side=0)
    else:
        off = _short(azimuth - state["fused"])
        taken = _snap(state, t, off)
        state["fused"] = _norm(azimuth) if taken else _norm(state["fused"] + off * (1 - math.exp(-max(0.0, gap) / GYRO_S)))
    state.pop("az", None)
    state.pop("last", None)
    return state["fused"]


def fused_step(state: dict, reading: dict) -> dict | None:
    """ST1, ST4: one reading of either sensor (t, kind, absolute, value): an azimuth, or a rate of turn."""
    t = reading["t"]
    if reading["kind"] == "gyroscope":
        out = turn_step(state, t, reading["value"])
    else:
        out = compass_step(state, t, reading["value"]) if takes_reading(state, t, reading["absolute"]) else None
    return None if out is None else {"azimuth": out}


def overlay_step(state: dict, azimuth: float | None, tilt: float | None, px_per_rad: float, margin_px: float) -> bool:
    """ST16: whether the drawn overlay is made anew: it drifted too far, a motion ended, or many frames have passed.

    While the view moves from frame to frame only the edge of the margin counts.
    """
    past, anchor = state.get("past"), state.get("anchor")
    azimuth, tilt = (now if _told(now) else was for now, was in zip((azimuth, tilt), past or (0.0, 0.0), strict=True))
    step = abs(_short(azimuth - past[0])) * px_per_rad if past else 0.0, abs(tilt - past[1]) * px_per_rad if past else 0.0
    was = state.get("moving", 0) >= 3
    state["moving"] = state.get("moving", 0) + 1 if past and max(step) > 1.5 else 0
    moving = state["moving"] >= 3
    state.update(past=[azimuth, tilt], frame=state.get("frame", 0) + 1)
    drawn = anchor is None
    if not drawn:
        off = abs(_short(azimuth - anchor[0])) * px_per_rad, abs(tilt - anchor[1]) * px_per_rad
        far = off[0] > margin_px * 0.85 or off[1] > margin_px * 0.5 if moving else off[0] > margin_px * 0.5 or off[1] > 4
        drawn = far or was and not moving or state["frame"] - state["drawn"] >= 30
    if drawn:
        state.update(anchor=[azimuth, tilt], drawn=state["frame"])
    return drawn


_KINDS = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def folded(readings: DataFrame, step: Callable[[dict, dict], dict | None], made: str, key: str = "device", order: tuple[str, ...] = ("ts", "event_id"), reads: list[str] | None = None) -> DataFrame:
    """``readings`` with what the step makes of each (columns ``made``), those of which it makes nothing left out.

    The step sees the columns ``reads`` (all, if not said); the others stay in Arrow.
    """
    kinds = dict(readings.dtypes)
    made_kinds = dict(x.split() for x in made.split(", "))
    seen = list(dict.fromkeys([key, *(reads if reads is not None else kinds)]))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in kinds.items()], made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = {}, None
        for batch in batches:
            keep, out = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in seen]
            for i, values in enumerate(zip(*columns, strict=True)):
                if values[0] != now:
                    state, now = {}, values[0]
                result = step(state, dict(zip(seen, values, strict=True)))
                if result is not None:
                    keep.append(i)
                    out.append(result)
            if keep:
                rest = batch if len(keep) == batch.num_rows else batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rest.columns, *[pa.array([r[c] for r in out], _KINDS[t]) for c, t in made_kinds.items()]], [*kinds, *made_kinds])

    return readings.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def folded_stream(readings: DataFrame, step: Callable[[dict, dict], dict | None], made: str, key: str = "device", order: tuple[str, ...] = ("ts", "event_id"), forget_ms: int = 6 * 3_600_000) -> DataFrame:
    """The same over a stream; within a micro-batch readings are taken in order.

    The state is one JSON text a device, dropped when the device was silent for ``forget_ms``.
    """
    kinds = dict(readings.dtypes)
    names = [x.split()[0] for x in made.split(", ")]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in kinds.items()], made])

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else {}
        rows = pd.concat(list(frames)).sort_values(list(order))
        out = []
        for row in rows.to_dict("records"):
            result = step(state, row)
            if result is not None:
                out.append({**row, **result})
        held.update((json.dumps(state),))
        held.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=[*kinds, *names])

    return readings.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
