"""Packing documents into sequences by best-two-fit.

How full the sequences get depends on the lengths alone, and those have at most ``capacity``
values. So Spark counts the pieces of each length, the driver packs that histogram (a few
thousand numbers whatever the corpus holds) into patterns of lengths with a number of
sequences each, and Spark deals the pieces to the places of their length by rank.

A pattern starts from the longest length left and is filled greedily with the longest that
fits. Then its smallest document is replaced by the two unpacked ones that fit the expanded
gap most tightly, as long as that leaves less empty.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.llm.common import materialise, text_of, tidy, with_slots
from vistaspark.llm.shingles import PIECE, span_hashes

CAPACITY = 2048
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Chunks and ids that a worker keeps, 24 and 4 bytes each; beyond, those that came first stay, to half of the ids.
KEPT_CHUNKS, KEPT_IDS = 400_000, 3_000_000
#: Bytes of texts whose ids are held at a time, unless one text is longer.
GROUP_BYTES = 2 << 20
#: Bytes that no chunk is cut beside: white space and what may be a part of it in UTF-8.
_CLOSED = np.zeros(256, bool)
_CLOSED[[*range(33), 0x7F]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[ord(x) for x in ",.;:!?"]] = True


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut: before a space and on both sides of a line end that stand
    between two characters that are no white space, and between a letter and a mark.

    A byte-level pre-tokenizer starts a new piece there and looks at nothing beyond, so the
    ids of a text are those of its chunks in a row. Beside characters of the UTF-8 ranges
    that hold the other kinds of white space nothing is cut.
    """
    at = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
    before, after = data[at - 1], data[at + 1]
    at = at[~_CLOSED[before] & ~_CLOSED[after] & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))]
    wide = data[at - 1] >= 0x80
    second, third = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    at = at[~(wide & ((second == 0xC2) | np.isin(third, (0xE1, 0xE2, 0xE3))))]
    marks = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    return np.concatenate([at, at[data[at] == 10] + 1, marks])


class ChunkIds:
    """Ids of chunks; a worker encodes each chunk it meets once, as far as it keeps them.

    Chunks are known by 64-bit hashes of their bytes and length, in sorted arrays. These
    stay from task to task, some 20 MB; the tokenizer, which is larger, only for a task.
    """

    def __init__(self):
        self.tokenizer = None
        self.hashes = np.empty(0, np.uint64)
        self.places = np.empty((0, 2), np.int64)  # start and number of the ids of each chunk
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _halve(self) -> None:
        """Keep what came first, mostly the common chunks: ids lie in the order of coming."""
        old = self.places.sum(1) <= self.used // 2
        self.hashes, self.places = self.hashes[old], self.places[old]
        self.used = int(self.places.sum(1).max(initial=0))
        self.ids = self.ids[: self.used].copy()

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        new = int(lengths.sum())
        if self.used + new > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(new, self.used // 2), np.uint32)])
        self.ids[self.used : self.used + new] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, new)
        ends = self.used + np.cumsum(lengths)
        self.used += new
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, np.stack([ends - lengths, lengths], axis=1)[order], axis=0)

    def _spans(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of each span); the spans begin at ``starts``."""
        if len(self.hashes) > KEPT_CHUNKS or self.used > KEPT_IDS:
            self._halve()
        which, distinct = pd.factorize(span_hashes(data, starts))
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)] == distinct
        if not known.all():
            first = np.empty(len(distinct), np.int64)
            first[which[::-1]] = np.arange(len(starts))[::-1]
            missing = first[~known]
            raw, ends = data.tobytes(), np.append(starts[1:], len(data))
            self._learn(distinct[~known], [raw[a:b].decode() for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)])
        places = self.places[np.searchsorted(self.hashes, distinct)][which]
        lengths = places[:, 1]
        total = np.cumsum(lengths)
        return self.ids[np.repeat(places[:, 0] - (total - lengths), lengths) + np.arange(total[-1])], lengths

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that stand in a row, and where each begins and the last ends; ``bounds``: the same of their bytes."""
        ids, starts, lengths, at, size = [], [], [], 0, PIECE
        while at < len(data):
            end = min(len(data), at + size)
            starts_here = np.zeros(end - at, bool)
            starts_here[0] = starts_here[chunk_starts(data[at:end])] = True
            starts_here[bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, end)] - at] = True
            here = np.flatnonzero(starts_here)
            if end < len(data) and len(here) < 2:
                size *= 2
                continue
            if end - at > PIECE:  # its first chunk is that long, and goes alone
                end, here = at + int(here[1]) if len(here) > 1 else end, here[:1]
            elif end < len(data):  # the last chunk may go on
                end, here = at + int(here[-1]), here[:-1]
            if end - at > PIECE:
                part = np.array(self.tokenizer.encode(data[at:end].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                n = np.array([len(part)])
            else:
                part, n = self._spans(data[at:end], here)
            ids.append(part), starts.append(here + at), lengths.append(n)
            at, size = end, PIECE
        if not ids:
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        total = np.append(0, np.cumsum(np.concatenate(lengths)))
        return np.concatenate(ids), total[np.searchsorted(np.concatenate(starts), bounds)]


@functools.lru_cache(1)
def chunk_ids_of(path: str) -> ChunkIds:
    return ChunkIds()


def pieces_of(path: str, capacity: int, keep_ids: bool, end_id: int = 0):
    """mapInArrow function: (doc_id, text) to the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        chunk_ids = chunk_ids_of(path)
        chunk_ids.tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            # some texts at a time, so that the ids of a whole batch are never held
            group = (bounds[:-1] - bounds[0]) // GROUP_BYTES if len(text) else np.empty(0, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(text)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high > low:
                    yield pieces(chunk_ids, batch.column(0).slice(low, high - low), data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
        chunk_ids.tokenizer = None

    def pieces(chunk_ids: ChunkIds, doc_ids: pa.Array, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        ids, at = chunk_ids.of(data, bounds)
        ends = at[1:] + np.arange(len(at) - 1)
        whole, own = np.full(len(ids) + len(ends), end_id, "<u4"), np.ones(len(ids) + len(ends), bool)
        own[ends] = False
        whole[own] = ids
        raw = memoryview(whole).cast("B")
        at = at + np.arange(len(at))
        sizes = np.diff(at)
        count = -(-sizes // capacity)
        owner = np.repeat(np.arange(len(sizes)), count)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        end = sizes[owner] - (count[owner] - 1 - piece) * capacity
        start = np.where(piece > 0, end - capacity, 0)
        cuts = [raw[4 * a : 4 * b] for a, b in zip((at[owner] + start).tolist(), (at[owner] + end).tolist(), strict=True)]
        columns = [doc_ids.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - start)]
        columns += [pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array([bytes(c) for c in cuts] if keep_ids else [None] * len(cuts), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def best_two(counts: np.ndarray, gap: int, used: dict[int, int]) -> tuple[int, int, int]:
    """(sum, a, b) of the two lengths that together fill ``gap`` most, (0, 0, 0) if none fit."""
    free = counts[: gap + 1].copy()
    for length, n in used.items():
        if length <= gap:
            free[length] -= n
    there = np.flatnonzero(free > 0)
    if not len(there):
        return 0, 0, 0
    fits = there[np.maximum(np.searchsorted(there, gap - there, "right") - 1, 0)]
    single = (fits == there) & (free[there] < 2)  # one document can't stand for both
    if single.any():
        lower = np.searchsorted(there, there[single]) - 1
        fits[single] = np.where(lower >= 0, there[np.maximum(lower, 0)], gap + 1)
    sums = np.where(there + fits <= gap, there + fits, 0)
    k = int(sums.argmax())
    return (int(sums[k]), int(there[k]), int(fits[k])) if sums[k] else (0, 0, 0)


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: times}, sequences)`` that use up ``counts[length]`` exactly."""
    counts, out = np.array(counts, dtype=np.int64), []
    while len(left := np.flatnonzero(counts)):
        pattern, gap = {int(left[-1]): 1}, capacity - int(left[-1])
        smallest = None
        while gap > 0:
            fitting = np.flatnonzero(counts[: gap + 1])
            best = next((int(x) for x in fitting[::-1] if counts[x] > pattern.get(int(x), 0)), 0)
            if not best:
                break
            # as many as fit and are there
            times = min(gap // best, int(counts[best]) - pattern.get(best, 0))
            pattern[best] = pattern.get(best, 0) + times
            gap -= best * times
        while gap > 0 and sum(pattern.values()) > 1:
            smallest = min(pattern)
            kept = {k: n - (k == smallest) for k, n in pattern.items() if n - (k == smallest)}
            total, a, b = best_two(counts, gap + smallest, kept)
            if total <= smallest:
                break
            pattern = kept
            for x in (a, b):
                pattern[x] = pattern.get(x, 0) + 1
            gap += smallest - total
        times = min(int(counts[k]) // n for k, n in pattern.items())
        for k, n in pattern.items():
            counts[k] -= n * times
        out.append((pattern, times))
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and range of its ranks: the first sequence, how many a sequence, and the offset."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            start, n = taken.get(length, 0), pattern[length]
            rows.append((length, start, sequence, n, offset))
            taken[length], offset = start + n * times, offset + n * length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "start", "sequence", "each", "offset"), table.T, strict=True))


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    A document is its ids and an end id. Those longer than ``capacity`` are cut, the first
    piece taking the remainder. Null and empty texts are the end id alone; repeated rows are
    packed as often as they come; an empty table gives an empty result. ``ids`` is null
    unless ``keep_ids``; ``sequences`` puts them together. Other columns are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = materialise(texts.mapInArrow(tidy(pieces_of(tokenizer_path, capacity, keep_ids)), PIECE_SCHEMA), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    table = places(pack_histogram(counts, capacity))
    ranked = with_slots(pieces, "length", ["doc_id", "piece", "ids_crc32"], int(counts.max()))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, slot: pd.Series) -> pd.DataFrame:
        key = table["length"] * (1 << 40) + table["start"]
        at = np.searchsorted(key, length.to_numpy() * (1 << 40) + slot.to_numpy(), "right") - 1
        rank = slot.to_numpy() - table["start"][at]
        each = table["each"][at]
        return pd.DataFrame({"sequence_id": table["sequence"][at] + rank // each, "offset": table["offset"][at] + rank % each * length.to_numpy()})

    return ranked.withColumn("at", place("length", "slot")).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian 32-bit), doc_ids, from pieces packed with ``keep_ids``; at most ``capacity`` ids a row."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(ordered.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda whole, x: F.concat(whole, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"))
