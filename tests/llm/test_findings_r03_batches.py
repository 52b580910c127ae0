"""pipeline: texts go to Python a few MB at a time, however many rows a batch may have."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_texts_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["n", "rows"])

    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word")), 1000).alias("text"))
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    try:
        corpus_pipeline.drop_near_copies(spark, docs.limit(0), "")
        found = docs.select("text").mapInArrow(sizes, "n long, rows long").collect()
        assert sum(r["rows"] for r in found) == 3000 and max(r["n"] for r in found) < 5 << 20
        spark.conf.set(KEY, "7m")  # a limit of the session's own holds
        corpus_pipeline.drop_near_copies(spark, docs.limit(0), "")
        assert spark.conf.get(KEY) == "7m"
    finally:
        spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)
