"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters of ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A word is a run of anything else (possessive, so the matcher never backtracks).
WORD = r"[^\x20\x09-\x0D]++"


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs in one process (tests, a notebook) a
    folder of this machine is used, and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vistaspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, so a lost executor costs
    at most a re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run):
    """A function over Arrow batches that gives freed memory back at its end; workers live on between tasks."""

    @functools.wraps(run)
    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


#: Bytes of a batch that goes to Python, where a session sets no limit of its own; a longer text goes alone.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python a few MB at a time, in all that this session runs from now on.

    By default a batch is 10,000 rows whatever they hold, and each task has it in buffers of
    the executor, that double as they grow, and again in its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner take the shuffle files of jobs that are over, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table in the shared folder that later tables have taken the place of."""
    spark = df.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text"):
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: A side of a join is broadcast only up to this many narrow rows (ids and numbers, under 64 bytes each).
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a materialised table of narrow rows for broadcast if its counted size allows it.

    Beyond ``BROADCAST_ROWS`` the table is returned unmarked and the join shuffles.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


#: Rows that one task numbers at a time.
SLOT_BLOCK = 50_000


def with_slots(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in blocks of bounded size.

    ``most``: rows of the largest group. Rows are dealt to blocks by a hash of ``order``;
    a block's offset is the sum of the counts before it.
    """
    blocks = max(1, -(-most // SLOT_BLOCK))
    dealt = df.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(group, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy(group, "block").orderBy(*order))
    return dealt.withColumn("place", place).join(offsets, [group, "block"]).withColumn("slot", F.col("offset") + F.col("place") - 1).drop("block", "offset", "place")
