"""What the reviewer of round 3 found: small tables whose work was put into a few tasks."""

from vistaspark.plans import names
from vistaspark.streaming import stateful

SF = "/root/testdata/sf0.001"


def test_names_are_spelled_in_all_tasks(spark):
    assert names.spellings(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_views_are_labelled_in_all_tasks(spark):
    rows = [(v, f, f"k{k}", f"Peak {k}", 40.0 * k, 100.0, k) for v in range(40) for f in range(2) for k in range(3)]
    labels = spark.createDataFrame(rows, "view long, frame long, key string, text string, x double, y double, rank int")
    assert stateful.labels_over(labels).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
