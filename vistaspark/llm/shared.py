"""Which shingles of a text other texts have too.

A shingle that one class of texts alone has can't be in an intersection, and most shingles
are of that kind. To find them, tasks put texts together to chunks and send each shingle's
hash to a bucket, packed; a bucket answers each chunk which of its hashes others have, and
the answers of a chunk are put together again. What two classes of a chunk share is answered
on the spot and sent once, so however common a shingle is, a bucket gets it once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.llm.common import tidy
from vistaspark.llm.shingles import mix, shingle_set, texts_of

#: Shingles and classes of a chunk; hashes of a bucket.
CHUNK, CLASSES, BUCKET = 1 << 20, 65_535, 1 << 21
#: Stands for a hash that several classes of the chunk have: known to be shared, asked by none.
KNOWN = 65_535
#: ``owners``: places of the classes in their chunk. One row of a chunk brings the classes instead, and no bucket.
ASKED = "bucket long, chunk long, owners binary, hashes binary, classes binary"
#: Of each owner the count of its hashes, and the hashes in the order of owners; or the classes of the chunk.
ANSWERED = "chunk long, owners binary, counts binary, hashes binary, classes binary"


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set; two zeros for the empty one."""
    a = np.bitwise_xor.reduce(mix(shingles + np.uint64(7))) if len(shingles) else np.uint64(0)
    b = np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))) if len(shingles) else np.uint64(0)
    return int(np.int64(a)), int(np.int64(b))


def _chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[dict[int, np.ndarray]]:
    sets, total = {}, 0
    for batch in batches:
        for data in texts_of(batch.column(0)):
            s = shingle_set(data, k)
            if len(s) and (c := class_of(s)[0]) not in sets:
                sets[c] = s
                total += len(s)
                if total >= CHUNK or len(sets) == CLASSES:
                    yield sets
                    sets, total = {}, 0
    if sets:
        yield sets


def _ask(k: int, buckets: int, lists: bool):
    kind = np.uint64 if lists else np.uint32
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, sets in enumerate(_chunks(batches, k)):
            classes = np.fromiter(sets, np.int64, len(sets))
            values = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), list(map(len, sets.values())))
            order = np.argsort(values)
            values, owner = values[order], owner[order]
            first = np.append(True, values[1:] != values[:-1])
            alone = first & np.append(first[1:], True)
            cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
            rows = [(-1, task + number, b"", b"", classes.tobytes())]

            def put(bucket: int, owners: np.ndarray, hashes: np.ndarray) -> None:
                rows.append((bucket, task + number, owners.tobytes(), hashes.astype(kind).tobytes(), None))

            for b, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                v, o, one = values[low:high], owner[low:high], alone[low:high]
                if len(v):
                    asked = first[low:high]
                    put(b, np.where(one, o, np.uint16(KNOWN))[asked], v[asked])
                    if not one.all():
                        put(-2 - b, o[~one], v[~one])
            yield _batch(rows, ASKED)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if t == "long" else pa.binary()) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _answer(lists: bool):
    kind = np.uint64 if lists else np.uint32

    def reply(chunk: int, owners: np.ndarray, hashes: np.ndarray) -> tuple:
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners)
        own = np.flatnonzero(counts).astype(np.uint16)
        return chunk, own.tobytes(), counts[own].astype(np.uint32).tobytes(), hashes[order].tobytes() if lists else b"", None

    def bucket_of(held: list) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([h for _, _, h in held])
        # who asks: the chunk and the owner; a known hash differs from all of them
        askers = np.concatenate([np.where(o == KNOWN, -1, o + (np.int64(i) << 16)) for i, (_, o, _) in enumerate(held)])
        order = np.argsort(hashes)
        askers = askers[order]
        starts = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
        several = np.minimum.reduceat(askers, starts) != np.maximum.reduceat(askers, starts)
        wanted = np.empty(len(hashes), bool)
        wanted[order] = np.repeat(several, np.diff(np.append(starts, len(hashes)))) & (askers >= 0)
        out, at = [], 0
        for chunk, o, h in held:
            mine = wanted[at : at + len(o)]
            at += len(o)
            if mine.any():
                out.append(reply(chunk, o[mine], h[mine]))
        if out:
            yield _batch(out, ANSWERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for i, (bucket, chunk) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if bucket == -1:
                    yield _batch([(chunk, None, None, None, batch.column(4)[i].as_py())], ANSWERED)
                    continue
                owners, hashes = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.uint16), (3, kind)))
                if bucket < 0:
                    yield _batch([reply(chunk, owners, hashes)], ANSWERED)
                    continue
                if bucket != now and held:
                    yield from bucket_of(held)
                    held = []
                now = bucket
                held.append((chunk, owners, hashes))
        if held:
            yield from bucket_of(held)

    return run


def _gather(lists: bool):
    """The answers of each chunk, which come sorted by chunk, as one row a class."""

    def chunk_of(held: list, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held:
            owners, counts = (np.concatenate(x) for x in zip(*[h[:2] for h in held], strict=True))
            total = np.bincount(owners, counts, minlength=len(classes)).astype(np.int64)
            own = np.flatnonzero(total)
            if lists:
                order = np.argsort(np.repeat(owners, counts), kind="stable")
                hashes = np.concatenate([h[2] for h in held])[order]
                offsets = np.append(0, np.cumsum(total[own])).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes))
            else:
                found = pa.array(total[own])
            yield pa.RecordBatch.from_arrays([pa.array(classes[own]), found], ["class", "shingles" if lists else "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, classes, now = [], np.empty(0, np.int64), None
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                if chunk != now:
                    yield from chunk_of(held, classes)
                    held, now = [], chunk
                if batch.column(4)[i].is_valid:
                    classes = np.frombuffer(batch.column(4)[i].as_buffer(), np.int64)
                else:
                    held.append(tuple(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((1, np.uint16), (2, np.uint32), (3, np.int64))))
        yield from chunk_of(held, classes)

    return run


def _exchange(texts: DataFrame, k: int, total: int, lists: bool) -> DataFrame:
    buckets = max(1, -(-total // BUCKET))
    # the rows that wait for no bucket are spread by their chunk
    spread = F.when(F.col("bucket") == -1, -2 - F.col("chunk")).otherwise(F.col("bucket"))
    asked = texts.select("text").mapInArrow(tidy(_ask(k, buckets, lists)), ASKED).repartition(spread).sortWithinPartitions("bucket")
    answered = asked.mapInArrow(tidy(_answer(lists)), ANSWERED).repartition("chunk").sortWithinPartitions("chunk")
    return answered.mapInArrow(tidy(_gather(lists)), "class long, shingles array<long>" if lists else "class long, shared long")


def shared_counts(texts: DataFrame, k: int, total: int) -> DataFrame:
    """class, shared: how many of its shingles other classes of ``texts`` (text) have; never too few.

    ``total``: about how many shingles there are. The exchange tells hashes apart by 32 bits
    within a bucket, and takes copies of a text in another chunk for another class, so it may
    count too many. Classes that share nothing are left out.
    """
    return _exchange(texts, k, total, False).groupBy("class").agg(F.sum("shared").alias("shared"))


def shared_shingles(texts: DataFrame, k: int, total: int) -> DataFrame:
    """class, shingles: those shingles of each class that other texts have, by 64-bit hashes."""
    return _exchange(texts, k, total, True).groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
