"""Repeated byte strings found with a logarithmic family of suffix arrays.

A suffix array here is sparse and truncated: it has the suffixes that start at minimisers,
by their first ``HEAD`` bytes, in byte order, dealt to buckets. The minimiser of a window of
``LEAST`` bytes hangs on the bytes of the window alone, so equal windows have their suffix at
the same place in them. A new batch of texts gets an array of its own, which is merge-scanned
against the arrays (levels) of the texts before it; a level joins another one of its own size,
so a family of ``b`` batches has at most log2(b) + 1 levels. All arrays have the same buckets:
scans and merges are joins of sorted buckets and exchange nothing.

Suffixes that repeat stand for segments: the windows that share a minimiser. Whole segments
that repeat are repeated windows. What is left, the ends of repeated passages, is compared in
pieces of ``PIECE_WINDOWS`` windows and then window by window, each time by counting digests,
so that copies are added up before they are exchanged and no group is ever held together.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.llm.common import discard, free_shuffles, materialise, scratch_path, text_of, tidy
from vistaspark.llm.shingles import mix

#: Bytes of a repeated string, of the head of a suffix, k-grams of a window, windows of a piece.
LEAST, HEAD = 400, 32
PIECE_WINDOWS = 16
#: Bytes that are read at a time, and keys that a task remembers.
READ, REMEMBERED = 1 << 20, 200_000
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 64 << 20
BATCHES = 4
#: The place within what is read stands in the low bits of a k-gram's hash, so that of equal k-grams the first is least.
_PLACE = np.uint64((1 << 21) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(int(_BASE), 2 * READ), _powers(pow(int(_BASE), -1, 1 << 64), 2 * READ)


def minimisers(data: np.ndarray, least: int) -> np.ndarray:
    """Of each window of ``least`` bytes the place of its least k-gram, the first of equal ones. At most ``2 * READ`` bytes."""
    n, width = len(data), least - HEAD + 1
    if n < least:
        return np.empty(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[:n], out=sums[1:])
    grams = n - HEAD + 1
    keys = (mix((sums[HEAD:] - sums[:-HEAD]) * _DOWN[:grams]) & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    padded = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - least + 1
    return (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _PLACE).astype(np.int64)


def _cut(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal places."""
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    return starts, np.diff(np.append(starts, len(places)))


def segments(text: bytes, least: int = LEAST) -> Iterator[tuple[int, list[int], list[int], list[int]]]:
    """(offset, starts, lengths, minimisers) of the segments of a text, ``READ`` bytes at a time.

    The last segment of a part is read again with the next part, so none is cut.
    """
    at = 0
    while len(text) - at >= least:
        part = np.frombuffer(text, np.uint8, min(len(text) - at, READ + least), at)
        places = minimisers(part, least)
        starts, lengths = _cut(places)
        over = at + len(part) < len(text)
        keep = len(starts) - over
        yield at, starts[:keep].tolist(), lengths[:keep].tolist(), places[starts[:keep]].tolist()
        if not over:
            return
        at += int(starts[-1])


def _many(texts: list[bytes], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, start, windows, minimiser) of all segments of several texts; short ones are read together."""
    lot, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > READ:
            for at, *found in segments(text, least):
                yield from ((i, at + s, n, at + a) for s, n, a in zip(*found, strict=True))
            continue
        if size + len(text) > READ:
            yield from _together(lot, texts, least)
            lot, size = [], 0
        lot.append(i)
        size += len(text)
    yield from _together(lot, texts, least)


def _together(lot: list[int], texts: list[bytes], least: int) -> Iterator[tuple[int, int, int, int]]:
    data = np.frombuffer(b"".join(texts[i] for i in lot), np.uint8)
    places = minimisers(data, least)
    if not len(places):
        return
    ends = np.cumsum([len(texts[i]) for i in lot])
    owner = np.searchsorted(ends, np.arange(len(places)), side="right")
    inside = np.arange(len(places)) + least <= ends[owner]
    # windows over the end of a text get a place that no window has
    starts, lengths = _cut(np.where(inside, places, -1 - owner))
    good = inside[starts]
    starts, lengths = starts[good], lengths[good]
    own = owner[starts]
    base = np.append(0, ends[:-1])[own]
    yield from zip(np.asarray(lot)[own].tolist(), (starts - base).tolist(), lengths.tolist(), (places[starts] - base).tolist(), strict=True)


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts, each once; one row without text says that it came again."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        ids, take = batch.column(0).to_pylist(), np.zeros(batch.num_rows, np.int8)
        for i, key in enumerate(ids):
            times = seen.get(key, 0)
            if times < 2:
                take[i] = 1 + times
                seen[key] = times + 1
        if len(seen) > REMEMBERED:
            seen.clear()
        keep = np.flatnonzero(take)
        again = pa.array(take[keep] == 2)
        texts = batch.column(1).take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.compute.if_else(again, pa.scalar(None, texts.type), texts)], ["id", "text"])


def _merge_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text, out of rows sorted by id; ``several``: it came more than once."""
    last, text, rows = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([text], pa.large_binary()).cast(pa.binary()), pa.array([rows > 1])], ["id", "text", "several"])

    for batch in batches:
        done = []
        ids = batch.column(0).to_pylist()
        for i, key in enumerate(ids):
            if key != last:
                if rows:
                    done.append((last, text, rows > 1))
                last, text, rows = key, None, 0
            rows += 1
            if text is None and batch.column(1)[i].is_valid:
                text = batch.column(1)[i].as_py()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["id", "text", "several"])
    if rows:
        yield out()


def text_id(column: str = "text"):
    return F.unhex(F.md5(text_of(column).cast("binary")))


def _bucketed(df: DataFrame, name: str, key: str, buckets: int, by: str | None = None) -> DataFrame:
    """``df`` as a table of the shared folder whose files are buckets of ``key``, in its order."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, name)).option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).format("parquet").saveAsTable(table)
    free_shuffles(spark)
    return spark.table(table)


def distinct_texts(df: DataFrame, least: int, batches: int) -> tuple[DataFrame, int]:
    """id, text (bytes), several, batch: the different texts of at least ``least`` bytes, in buckets of id; and how many buckets."""
    rows = df.filter(F.octet_length(text_of()) >= least).select(text_id().alias("id"), F.col("text").cast("binary").alias("text"))
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    dealt = rows.mapInArrow(tidy(_once), "id binary, text binary").repartition(buckets, "id").sortWithinPartitions("id")
    merged = dealt.mapInArrow(tidy(_merge_texts), "id binary, text binary, several boolean")
    return _bucketed(merged.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "suffix_texts", "id", buckets, "batch"), buckets


def _suffixes(least: int, whole: bool):
    """Rows of the suffixes of a task. ``whole``: with the digest of their segment, else each head once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, start, n, at in _many(texts, least):
                text = texts[i]
                head = text[at : at + HEAD]
                if whole:
                    rows.append((head, _digest(text[start : start + n + least - 1]), ids[i], start, n, at - start))
                else:
                    times = seen.get(head, 0)
                    if times < 2:
                        seen[head] = times + 1
                        rows.append((head, ids[i], at, times > 0))
                if len(rows) >= 50_000:
                    yield _table(rows, whole)
                    rows = []
            if len(seen) > REMEMBERED:
                seen.clear()
            if rows:
                yield _table(rows, whole)

    return run


ARRAY, SEGMENT = "head binary, id binary, place int, several boolean", "head binary, span binary, id binary, start int, n int, lead int"


def _table(rows: list[tuple], whole: bool) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = [x.split() for x in (SEGMENT if whole else ARRAY).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [c for c, _ in columns])


class SuffixFamily:
    """Levels of suffix arrays, each over twice the batches of the next, and the heads found more than once."""

    def __init__(self, buckets: int, least: int = LEAST):
        self.buckets, self.least = buckets, least
        self.levels: list[tuple[int, DataFrame]] = []
        self.hits: list[DataFrame] = []

    def add(self, texts: DataFrame) -> None:
        """Index a batch (id, text): build its array, scan the levels, merge levels of one size."""
        rows = texts.select("id", "text").mapInArrow(tidy(_suffixes(self.least, False)), ARRAY).repartition(self.buckets, "head")
        rows = rows.groupBy("head").agg(F.min(F.struct("id", "place")).alias("first"), (F.max("several") | (F.count(F.lit(1)) > 1)).alias("several"))
        array = self._keep(rows.select("head", "first.id", "first.place", "several"))
        self.hits.append(materialise(array.filter("several").select("head"), "suffix-hits"))
        for _, level in self.levels:
            self.hits.append(materialise(array.select("head").join(level.select("head"), "head"), "suffix-hits"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            merged = self._keep(self._merged(other, array))
            discard(other)
            discard(array)
            array, size = merged, 2 * size
        self.levels.append((size, array))

    def repeated_heads(self) -> DataFrame:
        """head: each that two suffixes of the family begin with, once."""
        return materialise(reduce(DataFrame.union, self.hits).distinct(), "suffix-heads")

    def _keep(self, rows: DataFrame) -> DataFrame:
        return _bucketed(rows, "suffix_level", "head", self.buckets)

    @staticmethod
    def _merged(older: DataFrame, newer: DataFrame) -> DataFrame:
        a, b = older.alias("a"), newer.alias("b")
        pick = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("head", "id", "place")]
        both = F.col("a.head").isNotNull() & F.col("b.head").isNotNull()
        return a.join(b, F.col("a.head") == F.col("b.head"), "full").select(*pick, (both | F.coalesce("a.several", "b.several")).alias("several"))


def _pieces(least: int, size: int):
    """Pieces of at most ``size`` windows of the segments of each text, counted from the minimiser, so equal windows are in like pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in wanted:
                    start, end, anchor = x["start"], x["start"] + x["n"], x["start"] + x["lead"]
                    for low in range((anchor - end + 1) // size, (anchor - start) // size + 1):
                        first, last = max(start, anchor - size * low - size + 1), min(end - 1, anchor - size * low)
                        if first > last:
                            continue
                        span = _digest(text[first : last + least])
                        common = anchor - size * low
                        head = _digest(b"%d " % low + text[common : common - size + 1 + least]) if size > 1 else span
                        rows.append((head, span, key, first, last - first + 1, anchor - first))
                        if len(rows) >= 50_000:
                            yield _table(rows, True)
                            rows = []
            if rows:
                yield _table(rows, True)

    return run


def _counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, open) of materialised segments or pieces: the rows that repeat whole, and one of each kind whose head others share."""
    kinds = materialise(rows.groupBy("head", "span").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "start", "n", "lead")).alias("one")), "suffix-kinds")
    # a table of its own, so that the join deals both sides and can split a head that very many share
    heads = materialise(kinds.groupBy("head").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("head"), "suffix-open")
    marks = rows.join(kinds.filter("c > 1").select("head", "span"), ["head", "span"], "left_semi").select("id", "start", "n")
    return marks, kinds.join(heads, "head", "left_semi").select("one.*")


def _removed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, several, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if several:
                    spans = [(0, len(text))]
                else:
                    spans = []
                    for start, n in sorted((x["start"], x["n"]) for x in marks):
                        end = start + n + least - 1
                        if spans and start <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                        else:
                            spans.append((start, end))
                kept, at = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(text[at:start])
                    at = end
                kept.update(text[at:])
                rows.append((key, [{"start": s, "end": e} for s, e in spans], kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["id", "spans", "kept_sha256"])

    return run


def repeated_spans(df: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """id, spans (start, end in bytes), kept_sha256 of each different text of ``df`` (text) that loses bytes.

    Texts come in ``batches`` to the family of suffix arrays, which needs ``least`` over ``HEAD``.
    """
    texts, buckets = distinct_texts(df, least, batches)
    family = SuffixFamily(buckets, least)
    for b in range(batches):
        family.add(texts.filter(F.col("batch") == b))
    every = texts.select("id", "text").mapInArrow(tidy(_suffixes(least, True)), SEGMENT)
    rows = materialise(every.join(family.repeated_heads(), "head", "left_semi"), "suffix-segments")
    for _, level in family.levels:
        discard(level)
    free_shuffles(df.sparkSession)
    marks, open_ones = _counted(rows)
    found = [marks]
    for size in (PIECE_WINDOWS, 1):
        wanted = open_ones.groupBy("id").agg(F.collect_list(F.struct("start", "n", "lead")).alias("wanted"))
        parts = texts.select("id", "text").join(wanted, "id").mapInArrow(tidy(_pieces(least, size)), SEGMENT)
        marks, open_ones = _counted(materialise(parts, "suffix-pieces"))
        found.append(marks)
    of_text = reduce(DataFrame.union, found).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    losing = texts.select("id", "text", "several").join(of_text, "id", "left").filter("several OR marks IS NOT NULL")
    return losing.mapInArrow(tidy(_removed(least)), "id binary, spans array<struct<start: long, end: long>>, kept_sha256 string")


def repeats_removed(df: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``df`` (doc_id, text).

    A byte goes if a string of ``least`` bytes that covers it also starts anywhere else, in the
    same text or another row, as judged on the input. A null text counts as empty, equal texts
    of at least ``least`` bytes go whole, also where rows repeat, shorter texts lose nothing.
    Texts of any length are read in parts, and text itself is exchanged once. An empty table
    gives an empty result. Other columns are not read.
    """
    lost = repeated_spans(df, least, batches).select(
        "id",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )
    rows = df.select("doc_id", text_id().alias("id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(text_of().cast("binary"), 256).alias("whole"))
    nothing = F.lit(0).cast("long")
    return rows.join(lost, "id", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", nothing).alias("n_removed"), F.coalesce("n_spans", nothing).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )
