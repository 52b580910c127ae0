"""GeoTIFF rasters as a Spark data source (survey S6): ``spark.read.format("geotiff")``.

Every row is a tile or strip of a picture with its box and heights. The driver lists files
only; a partition is a run of the tiles of one file, and its task reads the directory, picks
the picture (the whole one or an overview) and reads just the tiles whose box passes the
filters on ``west``, ``east``, ``south`` and ``north`` that Spark pushes down.

Options: ``path`` (a file, folder or pattern), ``factor`` (1: the whole picture; n: the
coarsest overview of at most n, made coarser by means of whole blocks if none fits), ``run``
(bytes of a file that one partition reads, about).

Read are classic and big TIFFs, tiled or in strips, of one sample or the first of several,
without compression or deflated, with no, the horizontal or the floating-point predictor, of
integers or floats, in geographic coordinates (a tie point and a pixel scale).
"""

from __future__ import annotations

import glob
import math
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "file string, factor double, tx int, ty int, west double, south double, east double, north double, width int, height int, heights array<float>"
RUN_BYTES = 64 << 20
# The tags of the directory that are read, the bytes of their types, compressions and predictors.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, SCALE, TIE_POINT, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "2I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, DEFLATE, HORIZONTAL, FLOATING = (1,), (8, 32946), 2, 3


@dataclass
class Picture:
    """One picture of a file."""

    tags: dict[int, tuple]
    order: str
    factor: float = 1.0

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    @property
    def size(self) -> tuple[int, int]:
        return self.one(WIDTH), self.one(HEIGHT)

    @property
    def tile(self) -> tuple[int, int]:
        if TILE_WIDTH in self.tags:
            return self.one(TILE_WIDTH), self.one(TILE_HEIGHT)
        return self.one(WIDTH), min(self.one(STRIP_ROWS, self.one(HEIGHT)), self.one(HEIGHT))

    @property
    def across(self) -> int:
        return -(-self.one(WIDTH) // self.tile[0])

    @property
    def places(self) -> list[tuple[int, int]]:
        tiled = TILE_OFFSETS in self.tags
        return list(zip(self.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], self.tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))

    @property
    def kind(self) -> np.dtype:
        return np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[self.one(FORMAT, 1)] }{self.one(BITS, 8) // 8}")

    def decoded(self, data: bytes, rows: int) -> np.ndarray:
        """The values of one tile, its first sample."""
        compression, samples = self.one(COMPRESSION, 1), self.one(SAMPLES, 1) if self.one(PLANES, 1) == 1 else 1
        if compression in DEFLATE:
            data = zlib.decompress(data)
        elif compression not in PLAIN:
            raise ValueError(f"compression {compression} of a TIFF is not read")
        width, kind = self.tile[0], self.kind
        raw = np.frombuffer(data, np.uint8, rows * width * samples * kind.itemsize).reshape(rows, -1)
        predictor = self.one(PREDICTOR, 1)
        if predictor == FLOATING:
            # differences of bytes, the bytes of a row by their rank, most significant first
            summed = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * samples)
            values = np.ascontiguousarray(summed.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0]
        else:
            values = raw.view(kind)
            if predictor == HORIZONTAL:
                values = np.cumsum(values.reshape(rows, width, samples), axis=1, dtype=kind.newbyteorder("=")).reshape(rows, -1)
        return values.reshape(rows, width, samples)[..., 0].astype(np.float32)


def pictures(file) -> list[Picture]:
    """The directories of an open file."""
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF")
    big = {42: False, 43: True}[struct.unpack(order + "H", head[2:4])[0]]
    count, entry, offset = ("Q", "HHQ8s", "Q") if big else ("H", "HHI4s", "I")
    at = struct.unpack(order + offset, head[8:16] if big else head[4:8])[0]
    out = []
    while at:
        file.seek(at)
        n = struct.unpack(order + count, file.read(struct.calcsize(order + count)))[0]
        size = struct.calcsize(order + entry)
        body = file.read(n * size + struct.calcsize(order + offset))
        tags = {}
        for k in range(n):
            tag, kind, many, value = struct.unpack(order + entry, body[k * size : (k + 1) * size])
            if kind not in TYPES:
                continue
            long = struct.calcsize(order + TYPES[kind]) * many
            if long > len(value):
                file.seek(struct.unpack(order + offset, value)[0])
                value = file.read(long)
            code = f"{many}s" if kind == 2 else TYPES[kind] * many
            tags[tag] = struct.unpack(order + code, value[:long])
        out.append(Picture(tags, order))
        at = struct.unpack(order + offset, body[n * size :])[0]
    for p in out:
        p.factor = out[0].size[0] / p.size[0]
    return out


def chosen(found: list[Picture], factor: float) -> tuple[Picture, int]:
    """The coarsest picture of at most ``factor``, and by what its cells are still to be put together."""
    best = max((p for p in found if p.factor <= factor + 0.01), key=lambda p: p.factor)
    rest = max(1, round(factor / best.factor))
    return best, rest if best.tile[0] % rest == 0 and best.tile[1] % rest == 0 else 1


def coarser(values: np.ndarray, by: int) -> np.ndarray:
    """Means of blocks over what is known; blocks at the edge may be smaller."""
    if by == 1:
        return values
    rows, columns = (-(-n // by) * by for n in values.shape)
    padded = np.pad(values, ((0, rows - values.shape[0]), (0, columns - values.shape[1])), constant_values=np.nan).reshape(rows // by, by, columns // by, by)
    known = np.isfinite(padded)
    n = known.sum(axis=(1, 3))
    with np.errstate(invalid="ignore"):
        return (np.where(known, padded, 0).sum(axis=(1, 3), dtype=np.float64) / n).astype(np.float32)


def listed(path: str) -> list[str]:
    """The files of a path, a folder or a pattern."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(x for end in ("tif", "tiff", "TIF") for x in glob.glob(f"{path}/**/*.{end}", recursive=True))
    return sorted(glob.glob(path))


@dataclass
class Run(InputPartition):
    """The part ``k`` of ``n`` of a file's tiles."""

    file: str
    k: int
    n: int


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.factor, self.run = float(options.get("factor", 1)), int(options.get("run", RUN_BYTES))
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the box are kept for pruning; all filters are given back, so Spark checks them on the rows, too."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in ("west", "south", "east", "north"):
                self.bounds.append((f.attribute[0], signs[type(f)], float(f.value)))
            yield f

    def partitions(self) -> list[Run]:
        files = [f for p in self.paths for f in listed(p)]
        return [Run(f, k, n) for f in files for n in (max(1, -(-os.path.getsize(f) // self.run)),) for k in range(n)]

    def wanted(self, box: dict[str, float]) -> bool:
        tests = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}
        return all(tests[sign](box[name], value) for name, sign, value in self.bounds)

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return  # no file at all
        with open(partition.file, "rb") as file:
            found = pictures(file)
            first, (picture, by) = found[0], chosen(found, self.factor)
            (step_x, step_y, *_), tie = first.tags[SCALE], first.tags[TIE_POINT]
            left, top = tie[3] - tie[0] * step_x, tie[4] + tie[1] * step_y
            factor_x, factor_y = (a / b for a, b in zip(first.size, picture.size, strict=True))
            nothing = first.one(NO_DATA, b"").strip(b"\0 ")
            places = picture.places
            (width, height), (wide, high) = picture.size, picture.tile
            low, high_end = (len(places) * x // partition.n for x in (partition.k, partition.k + 1))
            for i in range(low, high_end):
                ty, tx = divmod(i, picture.across)
                x0, y0 = tx * wide, ty * high
                if y0 >= height:
                    continue  # a further plane of samples
                columns, rows = min(wide, width - x0), min(high, height - y0)
                box = {"west": left + x0 * step_x * factor_x, "east": left + (x0 + columns) * step_x * factor_x, "north": top - y0 * step_y * factor_y, "south": top - (y0 + rows) * step_y * factor_y}
                offset, size = places[i]
                if not self.wanted(box) or not size:
                    continue
                file.seek(offset)
                values = picture.decoded(file.read(size), high if TILE_WIDTH in picture.tags else rows)[:rows, :columns]
                if nothing:
                    values = np.where(values == np.float32(float(nothing)), np.float32(math.nan), values)
                values = coarser(values, by)
                yield pa.RecordBatch.from_pylist(
                    [{"file": partition.file, "factor": picture.factor * by, "tx": tx, "ty": ty, **{k: box[k] for k in ("west", "south", "east", "north")}, "width": values.shape[1], "height": values.shape[0], "heights": values.ravel().tolist()}],
                    pa.schema([("file", pa.string()), ("factor", pa.float64()), ("tx", pa.int32()), ("ty", pa.int32()), *[(c, pa.float64()) for c in ("west", "south", "east", "north")], ("width", pa.int32()), ("height", pa.int32()), ("heights", pa.list_(pa.float32()))]),
                )


class GeoTiffSource(DataSource):
    """Register with ``spark.dataSource.register(GeoTiffSource)``; ``spark.sql.python.filterPushdown.enabled`` lets boxes prune tiles."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options)
