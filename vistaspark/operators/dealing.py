"""How rows are dealt to tasks where their bytes say little of their work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by ``keys`` to as many tasks as a shuffle has, however few bytes the rows have.

    A row that is spread into hundreds of samples makes much work out of few bytes, by which
    Spark reads it in one task or puts partitions together. What is grouped by ``keys`` later
    needs no further exchange.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
