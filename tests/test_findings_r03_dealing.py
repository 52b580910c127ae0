"""What the reviewer of round 3 found in queries that make much work out of a small table."""

from pyspark.sql import functions as F

from vistaspark.operators import horizon, panorama_labels, planning


def tasks(df) -> int:
    return df.rdd.getNumPartitions()


def test_a_fan_is_dealt_to_all_tasks(spark):
    observers = spark.range(40).coalesce(1).select("id", (42 + F.col("id") / 100).alias("lat"), (41 + F.col("id") / 50).alias("lon"))
    assert tasks(planning.fan(observers, 1 / 64, 16, 40.0, 45.0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = planning.prefetch_keys(observers, 1 / 64, 16, 40.0, 45.0)
    assert keys.count() == planning.fan(observers, 1 / 64, 16, 40.0, 45.0).select("id", "tx", "ty").distinct().count()


def test_rays_to_peaks_are_dealt_to_all_tasks(spark):
    peaks = spark.range(40).coalesce(1).select("id", (43 + F.col("id") / 100).alias("lat"), F.lit(42.0).alias("lon"), F.lit(2000).alias("ele"))
    assert tasks(horizon.peak_rays(peaks, 43.35, 42.44)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_hidden_peaks_compete(spark):
    rows = [(i, ("hidden", "visible", "onSlope")[i % 3], float(i * 7 % 50)) for i in range(600)]
    peaks = spark.createDataFrame(rows, "id long, visibility string, score double")
    got = {r["id"] for r in horizon.hidden_in_budget(peaks, 2).collect()}
    hidden = sorted((r for r in rows if r[1] == "hidden"), key=lambda r: (-r[2], r[0]))[:4]
    assert got == {r[0] for r in rows if r[1] != "hidden"} | {r[0] for r in hidden}
    plan = horizon.hidden_in_budget(peaks, 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(visibility" not in plan  # all visible peaks in one task


def test_pictures_of_labels_are_not_broadcast(spark):
    frames = spark.range(9).select(F.col("id").alias("frame"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("roll"), F.array(F.lit(240.0), F.lit(250.0)).alias("ridge"))
    labels = spark.range(30).select((F.col("id") % 9).alias("frame"), F.col("id").alias("key"), (F.col("id") * 20.0).alias("x"), F.lit(200.0).alias("y"), F.lit("Peak").alias("name"), F.array(F.lit("1 m")).alias("info"), F.lit(False).alias("hidden"), F.col("id").alias("rank"))
    plan = panorama_labels.panorama_labels(labels, frames)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
