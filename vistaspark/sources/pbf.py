"""Map nodes out of a PBF file (survey S1), as a data source of Spark.

    spark.dataSource.register(PbfNodes)
    spark.read.format("pbf-nodes").load("planet.osm.pbf")

The file is a row of blobs, each with a small head. The driver reads the heads alone and deals
runs of blobs to tasks; a task unpacks its blobs one by one. Ways and relations are skipped,
and so are nodes without a tag.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id long, lat double, lon double, tags map<string,string>"
#: Bytes of blobs that one task reads, about.
RUN_BYTES = 64 << 20


def _open(path: str):
    """A file that can be sought, local or in a store that Arrow knows."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")


def varints(data: bytes) -> np.ndarray:
    """The numbers of a packed field."""
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(a < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        here = starts + k <= ends
        out[here] |= (a[starts[here] + k] & np.uint64(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: an integer, or the bytes of what has a length or a fixed width."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < n:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def packed(message: dict[int, list], field: int) -> np.ndarray:
    """The numbers of a repeated field, which may come in several packed parts or one by one."""
    parts = [varints(x) if isinstance(x, bytes) else np.array([x], np.uint64) for x in message.get(field, [])]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def _signed_one(value: int) -> int:
    return int(np.uint64(value).astype(np.int64))


def nodes_of(block: bytes) -> Iterator[tuple[int, float, float, dict[str, str]]]:
    """The tagged nodes of a primitive block."""
    top = _message(block)
    strings = [s.decode("utf-8", "replace") for s in _message(top[1][0]).get(1, [])]
    grain = top.get(17, [100])[0]
    off_lat, off_lon = (_signed_one(top.get(f, [0])[0]) for f in (19, 20))
    place = lambda off, v: 1e-9 * (off + grain * int(v))
    for group in map(_message, top.get(2, [])):
        for node in map(_message, group.get(1, [])):
            keys, values = packed(node, 2), packed(node, 3)
            if len(keys):
                i, lat, lon = (int(signed(np.array([node[f][0]], np.uint64))[0]) for f in (1, 8, 9))
                yield i, place(off_lat, lat), place(off_lon, lon), {strings[k]: strings[v] for k, v in zip(keys.tolist(), values.tolist(), strict=True)}
        for dense in map(_message, group.get(2, [])):
            ids, lats, lons = (np.cumsum(signed(packed(dense, f))) for f in (1, 8, 9))
            pairs = packed(dense, 10).tolist()
            # of each node its keys and values in turn, then a 0; nothing at all where no node has a tag
            at = 0
            for k in range(len(ids) if pairs else 0):
                tags = {}
                while pairs[at]:
                    tags[strings[pairs[at]]] = strings[pairs[at + 1]]
                    at += 2
                at += 1
                if tags:
                    yield int(ids[k]), place(off_lat, lats[k]), place(off_lon, lons[k]), tags


def blobs(file) -> Iterator[tuple[str, int, int]]:
    """(kind, place, size) of the blobs, by their heads."""
    at = 0
    while True:
        file.seek(at)
        head = file.read(4)
        if len(head) < 4:
            return
        (size,) = struct.unpack(">I", head)
        head = _message(file.read(size))
        yield head[1][0].decode(), at + 4 + size, head[3][0]
        at += 4 + size + head[3][0]


class PbfNodes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pbf-nodes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(self.options["path"])


class PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        runs, size = [[]], 0
        with _open(self.path) as file:
            for kind, place, n in blobs(file):
                if kind == "OSMData":
                    if size > RUN_BYTES:
                        runs.append([])
                        size = 0
                    runs[-1].append((place, n))
                    size += n
        return [InputPartition(run) for run in runs]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string()))])
        with _open(self.path) as file:
            for place, size in partition.value:
                file.seek(place)
                blob = _message(file.read(size))
                block = blob[1][0] if 1 in blob else zlib.decompress(blob[3][0])
                rows = list(nodes_of(block))
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.float64()), pa.array(list(columns[2]), pa.float64()), pa.array([list(x.items()) for x in columns[3]], schema.field("tags").type)], schema=schema)
