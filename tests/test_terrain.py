"""Golden values of the geodesy, and every terrain query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vistaspark.functions import geo, scores
from vistaspark.operators import gazetteer, horizon, regions
from vistaspark.plans import queries as terrain

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_drop_and_weight(spark):
    assert value(spark, geo.drop_m(F.lit(100000.0))) == pytest.approx(682.7, abs=0.1)
    assert value(spark, scores.isolation_weight(F.lit(300.0))) == pytest.approx(0.55)
    assert value(spark, scores.isolation_weight(F.lit(30000.0))) == pytest.approx(1.0)
    assert value(spark, scores.isolation_weight(F.lit(None).cast("double"))) == 1.0


def test_slippy_tile_of_elbrus(spark):
    tx, ty = geo.slippy_tile(F.lit(43.35), F.lit(42.44), 15)
    assert (value(spark, tx), value(spark, ty)) == (20246, 11996)


def test_validity_refuses_what_is_no_number(spark):
    for lat in (float("nan"), float("inf"), None, 91.0):
        assert value(spark, geo.valid(F.lit(lat).cast("double"), F.lit(0.0))) is False


def test_march_steps():
    steps = horizon.march_steps()
    assert len(steps) == 536 and len(horizon.march_steps(100.0)) == 537


def test_isolation_of_a_cluster(spark):
    import math

    km = 1000 / geo.DEGREE_M
    rows = [(i, 43 + y * km, 42 + x * km / math.cos(math.radians(43)), e) for i, (x, y, e) in enumerate(((0, 0, 4700), (0.6, 0, 4690), (0, 0.8, 4680), (0.1, 0.1, None)))]
    got = {r["id"]: r["iso_m"] for r in gazetteer.isolation(spark.createDataFrame(rows, "id long, lat double, lon double, ele int")).collect()}
    assert got[0] > 30000 and got[1] == pytest.approx(600, abs=2) and got[2] == pytest.approx(800, abs=2) and got[3] == pytest.approx(141, abs=2)


def test_regions_across_the_antimeridian(spark):
    boxes = spark.createDataFrame([(0, "w", 177.5, -177.5, 70.0, 72.0, 1)], "ord int, region string, min_lon double, max_lon double, min_lat double, max_lat double, priority int")
    points = spark.createDataFrame([(1, 71.0, 179.0), (2, 71.0, -179.0), (3, 71.0, 0.0)], "id long, lat double, lon double")
    got = {r["id"]: (r["region"], r["inside"]) for r in regions.region_of(points, boxes).collect()}
    assert got == {1: ("w", True), 2: ("w", True), 3: (None, False)}
    assert {r["id"] for r in regions.containing(points, boxes).collect()} == {1, 2}


def test_near_and_far_ridge_are_two_fronts(spark):
    ridge = lambda ray, d: F.when(d.between(4000, 6000), 2000.0).when(d.between(29000, 31000), 9000.0).otherwise(0.0)
    got = horizon.fronts(horizon.march(spark, 1, ridge, 1001.7)).collect()
    assert any(r["to_m"] < 10000 for r in got) and any(r["from_m"] > 20000 for r in got)


def test_cells_are_summed_in_blocks(spark, monkeypatch):
    from vistaspark.operators import raster

    monkeypatch.setattr(raster, "CELLS_BLOCK", 9)
    rows = [(i, float(5000 + i * 7919 % 40), 10 + i * 31 % 17, 1 + i % 2) for i in range(200)]
    cells = spark.createDataFrame(rows, "cell long, relief double, bytes long, priority int")
    assert cells.select(raster._blocks(cells).alias("b")).distinct().count() > 15
    used, want = 0, []
    for cell, _, size, _ in sorted(rows, key=lambda r: (r[3], -r[1], r[0])):
        want += [(cell, used)] if used < 2500 else []
        used += size
    got = raster.select_cells(cells, 3000.0, 2500).collect()
    assert 50 < len(want) < 200 and sorted((r["cell"], r["used"]) for r in got) == sorted(want)


@pytest.mark.parametrize("name", sorted(terrain.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(terrain.ORACLE_SQL[name])
    got = terrain.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    same = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert same(map(tuple, got.select(*columns).collect())) == same(want.select(", ".join(columns)).fetchall())
