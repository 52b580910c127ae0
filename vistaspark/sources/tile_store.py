"""A folder of tiles with a manifest as a Spark data source (survey S8, S9, S10): ``df.write.format("tiles")``.

Tasks write their tiles (lod, tx, ty, data) as files ``lod/tx/ty.<ext>``, each under another
name first, and tell the driver which they wrote. Only when all have, the commit writes the
manifest ``index.json``: grids, coverage as bits, mean bytes. A write that fails removes what
its finished tasks wrote and leaves no manifest.

Options: ``path``, a folder that driver and executors share; ``levels``, JSON with an object a
level (lod in order: cellDeg, gridWidth, gridHeight, tilesX, tilesY, quantM if the steps are
not metres); ``bbox``, JSON; ``ext`` (``bin``: raw 16-bit, ``bin.gz``). Mode ``append`` keeps
tiles that are there and counts them, so a build that broke off goes on.
"""

from __future__ import annotations

import base64
import contextlib
import json
import os
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "lod int, tx int, ty int, data binary"
MANIFEST = "index.json"


@dataclass
class Written(WriterCommitMessage):
    """Of each level the places of a task's tiles, as ty * tilesX + tx, and their bytes; and which files are new."""

    places: dict[int, np.ndarray] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    files: list[str] = field(default_factory=list)


def _put(path: str, data: bytes) -> None:
    """A file that is there whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


class TileWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://").rstrip("/")
        self.levels, self.bbox, self.ext = json.loads(options["levels"]), json.loads(options.get("bbox", "null")), options.get("ext", "bin.gz")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        places, sizes, files = defaultdict(list), defaultdict(int), []
        for r in iterator:
            if not 0 <= r["tx"] < self.levels[r["lod"]]["tilesX"] or not 0 <= r["ty"] < self.levels[r["lod"]]["tilesY"]:
                raise ValueError(f"tile {r['tx']}, {r['ty']} lies outside the grid of level {r['lod']}")
            path = f"{self.path}/{r['lod']}/{r['tx']}/{r['ty']}.{self.ext}"
            if self.overwrite or not os.path.exists(path):
                _put(path, bytes(r["data"]))
                files.append(path)
            places[r["lod"]].append(r["ty"] * self.levels[r["lod"]]["tilesX"] + r["tx"])
            sizes[r["lod"]] += os.path.getsize(path)
        return Written({k: np.array(v, np.int64) for k, v in places.items()}, dict(sizes), files)

    def commit(self, messages: list[Written | None]) -> None:
        lods = []
        for lod, grid in enumerate(self.levels):
            told = [m for m in messages if m is not None and lod in m.places]
            there = np.unique(np.concatenate([m.places[lod] for m in told])) if told else np.empty(0, np.int64)
            bits = np.zeros(-(-grid["tilesX"] * grid["tilesY"] // 8) * 8, np.uint8)
            bits[there] = 1
            total, n = sum(m.sizes[lod] for m in told), sum(len(m.places[lod]) for m in told)
            lods.append({**grid, "coverage": base64.b64encode(np.packbits(bits, bitorder="little").tobytes()).decode(), "avgTileBytes": round(total / n) if n else 0})
        _put(f"{self.path}/{MANIFEST}", json.dumps({"bbox": self.bbox, "tileExt": self.ext, "lods": lods}, indent=1).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for path in m.files if m is not None else ():
                with contextlib.suppress(FileNotFoundError):
                    os.remove(path)


class TileStore(DataSource):
    """Register with ``spark.dataSource.register(TileStore)``."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> TileWriter:
        made = TileWriter(self.options, overwrite)
        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{made.path}/{MANIFEST}")  # it doesn't hold while tiles change
        return made


def raw_tiles(tiles: DataFrame, side: int = 256) -> DataFrame:
    """(tx, ty, data): heights as 16-bit integers in rows, least byte first, voids as 0; tiles without any height are left out."""

    @F.pandas_udf("binary")
    def raw(rows: pd.Series) -> pd.Series:
        return pd.Series([np.clip(np.nan_to_num(np.asarray(x, float).reshape(side, side), nan=0.0), -32768, 32767).astype("<i2").tobytes() for x in rows])

    return tiles.filter(F.exists("heights", lambda h: ~F.isnan(h))).select("tx", "ty", raw("heights").alias("data"))


def manifest_levels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The levels of manifests: source (the file), lod, cell (as it is written), quant, avg_bytes, tiles_x, tiles_y, coverage (bytes)."""
    lod = "struct<cellDeg: string, quantM: string, avgTileBytes: string, tilesX: string, tilesY: string, coverage: string>"
    rows = spark.read.schema(f"lods array<{lod}>").option("multiLine", True).json(paths)
    each = rows.select(F.input_file_name().alias("source"), F.posexplode("lods").alias("lod", "x"))
    whole = lambda c: F.col(c).cast("long")
    return each.select(
        "source", "lod", F.col("x.cellDeg").alias("cell"), F.col("x.quantM").alias("quant"), whole("x.avgTileBytes").alias("avg_bytes"),
        whole("x.tilesX").alias("tiles_x"), whole("x.tilesY").alias("tiles_y"), F.unbase64("x.coverage").alias("coverage"),
    )
