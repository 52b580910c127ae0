"""Labels of a panorama without overlaps (survey L2).

All labels of a picture stand at one angle, so in axes along the text (u) and across it (v) a
line of text is an interval of u on a lane of v. A label that is lifted moves along a line in
those axes, so every line that stands already forbids an interval of lifts, and the least lift
that is free comes out of sorted intervals: no lanes are tried one by one. Where a label's
lines can go in more than one form, each form gets its own least lift and the best one stays.
Labels are placed in the order of their rank, so a picture is one row for Arrow; pictures are
many and go to many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.operators.layout import parts_between

# Fixed values, in units of the interface's scale: the angle of the text; the distance of lanes, of a label from its
# point, of labels on a lane, of labels from the ridge; half the height of letters; the width of a letter; the most lines;
# how far labels of hidden peaks are moved out of the ridge, and by what step; the labels below which hidden peaks get one.
ANGLE = math.radians(60)
LANE, LEAD, GAP, CLEAR, HALF_LETTER, LETTER, MOST_LINES = 15.0, 7.0, 8.0, 5.0, 9.0, 6.5, 4
HIDDEN_MOST, HIDDEN_STEP, HIDDEN_BUDGET = 260.0, 5.0, 6
# The most lift in lanes; steps of a lane and tries where a leader is in the way; the price of a lane of lift, of the
# mirrored side, of a line that leaves the picture, of a label that does; samples of a line over the ridge and of a leader.
MOST_LIFT, STEPS, TRIES, LIFT_PRICE, MIRROR_PRICE, HANG_PRICE, CUT_PRICE, SAMPLES, LEADER_STEPS = 3, 4, 12, 100.0, 1.0, 2.0, 5.0, 9, 24
SEPARATOR = " · "
U, V = np.array([math.cos(ANGLE), -math.sin(ANGLE)]), np.array([math.sin(ANGLE), math.cos(ANGLE)])
(UX, UY), (VX, VY) = U.tolist(), V.tolist()
#: How the place of a label in (u, v) changes with its lift: straight across the text, or mirrored to the right.
PLAIN = (0.0, -1.0)
MIRROR = (float(V[0] * U[0] - V[1] * U[1]), float(V[0] ** 2 - V[1] ** 2))
#: What the best of a form can score less than this is no better by, however the numbers are rounded.
SLACK = 1e-9


def forbidden_lifts(lines: Sequence, boxes: Sequence, way: tuple[float, float], lane: float, gap: float) -> list[tuple[float, float]]:
    """Of each line (v, u0, u1) and box (v, u0, u1) the open interval of lifts along ``way`` at which they meet; empty ones left out."""

    def between(at: float, speed: float, low: float, high: float) -> tuple[float, float]:
        if abs(speed) < 1e-12:
            return (-math.inf, math.inf) if low < at < high else (math.inf, -math.inf)
        a, b = (low - at) / speed, (high - at) / speed
        return (a, b) if a < b else (b, a)

    out, (along, across) = [], way
    for v, u0, u1 in lines:
        wide = u1 - u0
        for box_v, box_0, box_1 in boxes:
            u_from, u_to = between(u0, along, box_0 - gap - wide, box_1 + gap)
            if u_to <= 0 or u_from >= u_to:
                continue
            v_from, v_to = between(v, across, box_v - lane, box_v + lane)
            low, high = max(u_from, v_from, 0.0), min(u_to, v_to)
            if low < high:
                out.append((low, high))
    return out


def least_free(intervals: list[tuple[float, float]]) -> float:
    """The least lift from 0 on that lies in none of the open intervals."""
    lift = 0.0
    for low, high in sorted(intervals):
        if low > lift + 1e-9:
            break
        lift = max(lift, high)
    return lift


def meet_boxes(segments: Sequence, boxes: Sequence, half: float) -> bool:
    """Whether any segment (u, v, u, v) touches any box (v, u0, u1), boxes being ``half`` high on both sides of v."""
    for u, v, to_u, to_v in segments:
        way_u, way_v = to_u - u, to_v - v
        still_u, still_v = abs(way_u) < 1e-12, abs(way_v) < 1e-12
        for box_v, low_u, high_u in boxes:
            low_v, high_v, enter, leave = box_v - half, box_v + half, 0.0, 1.0
            for at, way, still, low, high in ((u, way_u, still_u, low_u, high_u), (v, way_v, still_v, low_v, high_v)):
                if still:
                    if not low <= at <= high:
                        break
                else:
                    a, b = (low - at) / way, (high - at) / way
                    enter, leave = max(enter, min(a, b)), min(leave, max(a, b))
                    if enter > leave:
                        break
            else:
                return True
    return False


def cross(one: Sequence, others: Sequence) -> bool:
    """Whether a segment crosses any of the others within both."""
    ax, ay, bx, by = one
    for cx, cy, dx, dy in others:
        s, t = (cx - ax) * (by - ay) - (cy - ay) * (bx - ax), (dx - ax) * (by - ay) - (dy - ay) * (bx - ax)
        if (s < 0 < t) or (t < 0 < s):
            s, t = (ax - cx) * (dy - cy) - (ay - cy) * (dx - cx), (bx - cx) * (dy - cy) - (by - cy) * (dx - cx)
            if (s < 0 < t) or (t < 0 < s):
                return True
    return False


@dataclass
class Line:
    """A line of text: its parts, the places along it where they end, separators included, and the same as sums of their widths."""

    parts: list[str]
    ends: list[float]
    edges: list[float]

    @classmethod
    def of(cls, parts: list[str], scale: float) -> Line:
        ends = list(accumulate((LETTER * scale * (len(p) + (len(SEPARATOR) if k else 0)) for k, p in enumerate(parts)), initial=0.0))
        return cls(parts, ends, list(accumulate((b - a for a, b in pairwise(ends)), initial=0.0)))


@dataclass
class Drawn:
    """A label as it may stand: of each line the text, first part and last part; its boxes (v, u0, u1); lines that leave the picture."""

    lines: list[tuple[str, int, int]]
    boxes: Sequence
    hanging: int = 0


@dataclass
class Placed:
    key: object
    form: str
    lift: float
    mirrored: bool
    drawn: Drawn
    leader: np.ndarray


class Picture:
    """One picture with the labels placed so far. ``ridge``: the visible ridge's y at equal steps from side to side, NaN where none is."""

    def __init__(self, width: float, height: float, scale: float = 1.0, roll: float = 0.0, ridge=None):
        self.width, self.height, self.scale = width, height, scale
        self.frame = math.cos(roll), math.sin(roll), width / 2, height / 2, HALF_LETTER * scale
        self.ridge = None if ridge is None or len(ridge) < 2 else np.asarray(ridge, float)
        self.boxes, self.leaders, self.placed = [], [], []
        self.lane, self.gap, self.most = LANE * scale, GAP * scale, MOST_LIFT * LANE * scale

    def _corners(self, u: float, v: float, length: float) -> Iterator[bool]:
        """Of each of the four corners of a line of text whether it is in the picture after the turn about its centre."""
        cos, sin, cx, cy, half = self.frame
        for a in (u + length, u):
            ax, ay = a * UX, a * UY
            for b in (v - half, v + half):
                x, y = ax + b * VX - cx, ay + b * VY - cy
                yield 0 <= cx + x * cos - y * sin <= self.width and 0 <= cy + x * sin + y * cos <= self.height

    def _inside(self, u: float, v: float, length: float) -> bool:
        """``all(self._corners(...))``, written out as it is asked most."""
        cos, sin, cx, cy, half = self.frame
        width, height, low, high, end = self.width, self.height, v - half, v + half, u + length
        ax, ay, bx, by, tx, ty = end * UX, end * UY, low * VX, low * VY, high * VX, high * VY
        x, y = ax + bx - cx, ay + by - cy
        if not (0 <= cy + x * sin + y * cos <= height and 0 <= cx + x * cos - y * sin <= width):
            return False
        x, y = ax + tx - cx, ay + ty - cy
        if not (0 <= cy + x * sin + y * cos <= height and 0 <= cx + x * cos - y * sin <= width):
            return False
        ax, ay = u * UX, u * UY
        x, y = ax + bx - cx, ay + by - cy
        if not (0 <= cy + x * sin + y * cos <= height and 0 <= cx + x * cos - y * sin <= width):
            return False
        x, y = ax + tx - cx, ay + ty - cy
        return 0 <= cy + x * sin + y * cos <= height and 0 <= cx + x * cos - y * sin <= width

    def ridge_at(self, x: np.ndarray) -> np.ndarray:
        """The ridge's y, NaN beyond the sides and where there is none."""
        if self.ridge is None:
            return np.full(np.shape(x), np.nan)
        return np.interp(x, np.linspace(0, self.width, len(self.ridge)), self.ridge, left=np.nan, right=np.nan)

    def over_ridge(self, u: float, v: float, length: float) -> bool:
        points = (u + np.linspace(0, length, SAMPLES))[:, None] * U + v * V
        return not (points[:, 1] > self.ridge_at(points[:, 0]) - CLEAR * self.scale).any()

    def leader(self, point: np.ndarray, foot: tuple[float, float], hidden: bool) -> tuple[float, float, float, float]:
        """In (u, v), the line from a peak to the first letter; of a hidden peak only what is over the ridge."""
        x, y = point.tolist()
        if hidden:
            foot_at = np.array(foot)
            way = foot_at + np.linspace(0, 1, LEADER_STEPS + 1)[:, None] * (point - foot_at)
            depth = way[:, 1] - self.ridge_at(way[:, 0])
            below = np.flatnonzero(depth > 0)
            if len(below):
                k = int(below[0])
                share = 0.0 if k == 0 or not np.isfinite(depth[k - 1]) else depth[k - 1] / (depth[k - 1] - depth[k])
                x, y = (way[k - 1] + share * (way[k] - way[k - 1]) if k else foot_at).tolist()
        return x * UX + y * UY, x * VX + y * VY, foot[0] * UX + foot[1] * UY, foot[0] * VX + foot[1] * VY

    def meets(self, box: tuple[float, float, float]) -> bool:
        (v, u0, u1), lane, gap = box, self.lane, self.gap
        return any(abs(at - v) < lane and u0 < high + gap and u1 > low - gap for at, low, high in self.boxes)

    def leader_is_free(self, leader: Sequence, boxes: Sequence) -> bool:
        half = HALF_LETTER * self.scale
        return not (meet_boxes([leader], self.boxes, half) or cross(leader, self.leaders) or meet_boxes(self.leaders, boxes, half))

    def settle(self, lines: list[Line], u: float, v: float, hidden: bool, hang_first: bool, hang_last: bool) -> Drawn | None:
        """Lines from top to bottom with the bottom one at (u, v), cut to the picture; None if the first has no room.

        Parts beyond the picture go; a line without any goes, with those under it, unless it may
        hang out of the picture. The others are centred under the first where that is free, the
        bottom one never to the left of its foot.
        """
        bottom, cut = len(lines) - 1, []
        for i, line in enumerate(lines[:MOST_LINES]):
            lane = v - (bottom - i) * self.lane
            kept = parts_between(line.edges, lambda a, b, lane=lane: self._inside(u + a, lane, b - a))
            if kept is None:
                may = (i == 0 and hang_first) or (i == bottom and hang_last)
                if not may or not any(self._corners(u, lane, line.ends[-1])):
                    break
                cut.append((line, lane, 0, len(line.parts) - 1, True))
            else:
                cut.append((line, lane, *kept, False))
        if not cut:
            return None
        length = lambda line, first, last: line.ends[last + 1] - line.ends[first]
        out, boxes = [], []
        for i, (line, lane, first, last, hangs) in enumerate(cut):
            start, wide = u + line.ends[first], length(line, first, last)
            off = math.floor((length(*cut[0][:1], *cut[0][2:4]) - wide) / 2 + 0.5) if i else 0
            off = max(0, off) if hidden or i == len(cut) - 1 else off
            box = (lane, start + off, start + off + wide)
            if off and not hangs and (self.meets(box) or not self._inside(box[1], lane, wide)):
                box = (lane, start, start + wide)
            if self.meets(box):
                if i == 0:
                    return None
                shorter = range(last - 1, first - 1, -1) if hang_last and i == len(cut) - 1 else ()
                ends = ((k, (lane, start, start + length(line, first, k))) for k in shorter)
                found = next(((k, b) for k, b in ends if not self.meets(b)), None)
                if found is None:
                    break
                last, box = found
            boxes.append(box)
            out.append((SEPARATOR.join(line.parts[first : last + 1]), first, last))
        return Drawn(out, boxes, sum(c[4] for c in cut))

    def whole(self, line: Line, u: float, v: float) -> Drawn | None:
        """One line uncut, if any of it is in the picture and it is free."""
        box = (v, u, u + line.ends[-1])
        if not any(self._corners(u, v, line.ends[-1])) or self.meets(box):
            return None
        return Drawn([(SEPARATOR.join(line.parts), 0, len(line.parts) - 1)], [box])

    def lifts(self, rows: list[tuple[float, float, float]], most: float) -> Iterator[tuple[float, bool]]:
        """Lifts to try up to ``most``, lowest first, and whether mirrored: from the least that is free on either side on, in steps."""
        steps = lambda way, free: [free + k * self.lane / STEPS for k in range(TRIES + 1)]
        plain = steps(PLAIN, least_free(forbidden_lifts(rows, self.boxes, PLAIN, self.lane, self.gap)))
        at = 0
        if plain[0] == 0.0 <= most:  # nothing is lower, so the other side needn't be known for it
            yield 0.0, False
            at = 1
        mirror = steps(MIRROR, least_free(forbidden_lifts(rows, self.boxes, MIRROR, self.lane, self.gap)))
        for lift, mirrored in sorted([*((x, False) for x in plain[at:]), *((x, True) for x in mirror)]):
            if lift > most:
                break
            yield lift, mirrored

    def lowest(self, lines: list[Line], u: float, v: float, point: np.ndarray, hidden: bool, settle: Callable, most: float) -> tuple[float, bool, Drawn, tuple] | None:
        """The least lift up to ``most``, on either side, at which the lines settle and no leader is in the way: lift, mirrored, drawn, leader."""
        rows = [(v - (len(lines) - 1 - i) * self.lane, u, u + line.ends[-1]) for i, line in enumerate(lines)]
        for lift, mirrored in self.lifts(rows, min(most, self.most)):
            way = MIRROR if mirrored else PLAIN
            drawn = settle(u + lift * way[0], v + lift * way[1])
            if drawn is None:
                continue
            foot_v, foot_u, _ = drawn.boxes[-1]
            leader = self.leader(point, (foot_u * UX + foot_v * VX, foot_u * UY + foot_v * VY), hidden)
            if not self.leader_is_free(leader, drawn.boxes):
                continue
            if hidden and not all(self.over_ridge(b[1], b[0], b[2] - b[1]) for b in drawn.boxes):
                continue
            return lift, mirrored, drawn, leader
        return None

    def forms(self, name: str, info: list[str], u: float, v: float) -> Iterator[tuple[str, list[Line], bool, bool]]:
        """The forms of a label: A in one line, B the name over the rest, C the name in two or three lines over the rest."""
        line = lambda *parts: Line.of([p for p in parts if p], self.scale)
        yield "A", [line(name, *info)], False, False
        if info:
            yield "B", [line(name), line(*info)], True, True
        fits = lambda text: self._inside(u, v, LETTER * self.scale * len(text))
        if fits(name):
            return
        breaks = name_breaks(name)
        tail = [line(*info)] if info else []
        for i in range(len(breaks) - 1, -1, -1):
            if fits(name[: breaks[i][0]]):
                head, rest = name[: breaks[i][0]], breaks[i][1]
                yield f"C{i}", [line(head), line(name[rest:]), *tail], False, True
                for j in range(i + 1, len(breaks)):
                    yield f"C{i}", [line(head), line(name[rest : breaks[j][0]]), line(name[breaks[j][1] :]), *tail], False, True

    def foot(self, point: np.ndarray, length: float, hidden: bool) -> np.ndarray | None:
        """Where the first letter stands without any lift; of hidden peaks the first place over the ridge."""
        lead, most = LEAD * self.scale, HIDDEN_MOST * self.scale if hidden else LEAD * self.scale
        while lead <= most:
            at = point + lead * U
            if at[1] < self.lane:
                return None
            if not hidden or self.over_ridge(at @ U, at @ V, length):
                return at
            lead += HIDDEN_STEP * self.scale
        return None

    def place(self, key, x: float, y: float, name: str, info: list[str], hidden: bool) -> bool:
        """Give a label the best form that has room; False if none has."""
        point = np.array([x, y])
        if y < 0 or (y > self.height and not hidden):
            return False
        full = Line.of([name, *info], self.scale)
        foot = self.foot(point, full.ends[-1], hidden)
        if foot is None:
            return False
        u, v = float(foot @ U), float(foot @ V)
        best, best_score, broken = None, -1.0, None

        def consider(form: str, found: tuple, of_name: int, of_info: int, price: float) -> None:
            nonlocal best, best_score
            lift, mirrored, drawn, leader = found
            score = 100 * of_name + 10 * of_info - price - lift / self.lane * LIFT_PRICE - MIRROR_PRICE * mirrored - len(drawn.lines)
            if score > best_score:
                best, best_score = Placed(key, form[0], lift, mirrored, drawn, leader), score

        def worth(lines: int, price: float = 0.0) -> float:
            """The lift up to which a label of so many lines that shows all may be better than the best so far."""
            return (200 + 10 * len(info) - price - lines - best_score + SLACK) / LIFT_PRICE * self.lane

        for form, lines, hang_first, hang_last in self.forms(name, info, u, v):
            if broken not in (None, form):
                break  # of the places to break a name the last that works is enough
            most = worth(min(2, len(lines)))
            if form[0] == "C" and most >= 0:
                most = self.most  # one that works ends the search, be it the best or not
            if most < 0:
                break  # all others have two lines too, or more
            found = self.lowest(lines, u, v, point, hidden, lambda a, b, n=lines, f=hang_first, t=hang_last: self.settle(n, a, b, hidden, f, t), most)
            if found is None:
                continue
            drawn = found[2]
            if form == "A":
                first, last = drawn.lines[0][1:]
                consider(form, found, 2 if first == 0 else 0, last if first == 0 else last - first + 1, 0.0)
                continue
            of_info = drawn.lines[-1][2] - drawn.lines[-1][1] + 1 if info and len(drawn.lines) == len(lines) else 0
            names = len(lines) - bool(info)
            consider(form, found, 2 if len(drawn.lines) >= names else 1, of_info, HANG_PRICE * drawn.hanging)
            broken = form if form[0] == "C" else broken
        most = worth(1, CUT_PRICE)
        found = self.lowest([full], u, v, point, hidden, lambda a, b: self.whole(full, a, b), most) if most >= 0 else None
        if found is not None:
            consider("D", found, 2, len(info), CUT_PRICE)
        if best is None:
            return False
        self.boxes += best.drawn.boxes
        self.leaders.append(best.leader)
        best.drawn.boxes, best.leader = np.array(best.drawn.boxes), np.array(best.leader)
        self.placed.append(best)
        return True


def name_breaks(name: str, most: int = 7) -> list[tuple[int, int]]:
    """Where a name may be broken: the end of one line and the start of the next; a hyphen stays, a space goes."""
    out = []
    for i, c in enumerate(name):
        if c in " -" and 0 < i < len(name) - 1:
            out.append((i, i + 1) if c == " " else (i + 1, i + 1))
    return out[:most]


SCHEMA = "frame long, key long, form string, lift double, mirrored boolean, line int, text string, u0 double, u1 double, v double, leader array<double>"


def panorama_labels(labels: DataFrame, frames: DataFrame) -> DataFrame:
    """L2: the lines of the labels that get a place: frame, key, form, lift, mirrored, line, text, its place along and across the text, leader.

    ``labels``: frame, key, x, y, name, info (array of strings), hidden, rank. ``frames``:
    frame, width, height, scale, roll, ridge (array of y, null if there is none). Visible peaks
    come first, by rank, then hidden ones while less than ``HIDDEN_BUDGET`` labels stand.
    Labels without a name or a place are left out, and so are those far beyond the sides.
    """
    reach = 400 * F.col("scale") + F.col("width") * (1 - F.cos("roll")) / 2 + F.col("height") * F.abs(F.sin("roll")) / 2
    there = labels.filter("x IS NOT NULL AND y IS NOT NULL AND name IS NOT NULL AND name <> ''")
    label = F.struct(F.coalesce("hidden", F.lit(False)).alias("hidden"), "rank", "key", "x", "y", "name", "info")
    # a picture costs much more than its bytes say, so its partitions are not to be put together; its ridge goes to its labels once, not to each
    spread = there.repartition(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame")
    whole = spread.groupBy("frame").agg(F.sort_array(F.collect_list(label)).alias("labels"))
    # pictures hold arrays, of which Spark knows no size: guessed small, they would be broadcast through the driver
    whole = whole.join(frames.hint("merge"), "frame").withColumn("labels", F.filter("labels", lambda x: x["x"].between(-reach, F.col("width") + reach)))
    whole = whole.filter(F.size("labels") > 0).select("frame", "labels", "width", "height", "scale", "roll", "ridge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                picture, budget = Picture(r["width"], r["height"], r["scale"], r["roll"], r["ridge"]), None
                for x in r["labels"]:
                    if x["hidden"] and budget is None:
                        budget = max(0, HIDDEN_BUDGET - len(picture.placed))
                    if budget == 0:
                        break
                    done = picture.place(x["key"], x["x"], x["y"], x["name"], [i for i in x["info"] or [] if i], x["hidden"])
                    budget = budget - 1 if done and x["hidden"] else budget
                for p in picture.placed:
                    rows += [
                        (r["frame"], p.key, p.form, p.lift, p.mirrored, k, text, box[1], box[2], box[0], p.leader.tolist())
                        for k, ((text, _, _), box) in enumerate(zip(p.drawn.lines, p.drawn.boxes.tolist(), strict=True))
                    ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)

    return whole.mapInArrow(run, SCHEMA)
