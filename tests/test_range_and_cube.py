"""Boxes of any size against the nested loop; windows of a stored cube against those of the table, and what their plan reads."""

import random

import pytest
from pyspark.sql import functions as F

from specgrid.functions import geo
from specgrid.operators import mapping, patch
from specgrid.sources import io

BOX = ("x0", "x1", "y0", "y1")


def mixed_boxes(spark, n=300):
    rng = random.Random(1)
    rows = []
    for b in range(n):
        w, h = (rng.choice([0.0, 0.01, 0.3, 2.0, 40.0, 180.0]) * rng.random() for _ in range(2))
        x, y = rng.uniform(-180, 180), rng.uniform(-90, 90)
        rows.append((b, x, x + w, y, y + h))
    inf = float("inf")
    rows += [(1000, -180.0, 180.0, -90.0, 90.0), (1001, -inf, inf, 0.0, inf), (1002, 5.0, 4.0, 0.0, 1.0), (1003, None, 4.0, 0.0, 1.0), (1004, 0.25, 0.25, -0.5, -0.5), (1005, -1e300, 1e300, -90.0, 90.0)]
    return spark.createDataFrame(rows, "b int, x0 double, x1 double, y0 double, y1 double")


def test_boxes_of_all_sizes(spark):
    rng = random.Random(2)
    places = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(400)] + [(900, None, 1.0), (901, 0.25, -0.5), (902, 180.0, 90.0)]
    points = spark.createDataFrame(places, "p int, px double, py double")
    boxes = mixed_boxes(spark)
    want = sorted(map(tuple, points.join(boxes, F.expr("px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1")).select("p", "b").collect()))
    for cell in (0.25, 30.0):
        got = mapping.range_join(points, boxes, "px", "py", BOX, cell).select("p", "b")
        assert sorted(map(tuple, got.collect())) == want
    assert mapping.range_join(points.where("false"), boxes, "px", "py", BOX, 1.0).count() == 0
    assert mapping.range_join(points, boxes.where("false"), "px", "py", BOX, 1.0).count() == 0


def test_rows_of_a_box_are_bounded(spark):
    filed = mapping._filed(mixed_boxes(spark), BOX, 0.01).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    assert filed.agg(F.max("n")).first()[0] <= 4


def test_projection_in_steps(spark):
    df = spark.range(50).select((17 + F.col("id") % 45 * 0.18).alias("lon"), (-36 + F.col("id") % 41 * 0.1).alias("lat"))
    e, n = geo.to_utm(F.col("lon"), F.col("lat"))
    out = geo.with_utm(df, "lon", "lat").withColumns({"e1": e, "n1": n})
    assert set(out.columns) == {"lon", "lat", "e", "n", "e1", "n1"} and out.where("e <> e1 OR n <> n1").count() == 0


def test_morton(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(1 << 31), rng.randrange(1 << 31)) for _ in range(200)] + [(0, 0), (3, 5)]
    for r in spark.createDataFrame(rows, "y long, x long").select("y", "x", geo.morton(F.col("y"), F.col("x")).alias("c")).collect():
        assert r.c == sum(((r.y >> i & 1) << (2 * i + 1)) | ((r.x >> i & 1) << (2 * i)) for i in range(32))


@pytest.mark.parametrize("most", [1, 3, 100])
def test_code_ranges(most):
    codes = [0, 1, 2, 9, 10, 40, 41, 300]
    got = patch.code_ranges(codes, 4, most)
    assert len(got) <= most and all(any(a <= 4 * c and 4 * c + 4 <= b for a, b in got) for c in codes)
    if most == 3:
        assert got == [(0, 44), (160, 168), (1200, 1204)]


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('cube')}/c"
    y, x = F.expr("CAST(id % 1600 div 40 AS INT)"), F.expr("CAST(id % 40 AS INT)")
    pixels = spark.range(4 * 1600).select(F.expr("CAST(id div 1600 AS INT)").alias("granule_id"), y.alias("y"), x.alias("x"), (F.col("id") * 7 % 1001).cast("double").alias("value"))
    pixels = pixels.where("NOT (granule_id = 2 AND y = 11 AND x = 11)")
    io.write_cube(pixels, path, side=16)
    return path, pixels


def sites(spark, rows):
    return spark.createDataFrame(rows, "site_id int, granule_id int, y_idx int, x_idx int")


def test_cube_windows(spark, cube, monkeypatch):
    path, pixels = cube
    rng = random.Random(4)
    m = sites(spark, [(i, rng.randrange(5), rng.randrange(-2, 42), rng.randrange(-2, 42)) for i in range(120)] + [(500, 2, 12, 12), (501, 0, 20, 20), (501, 1, 20, 20)])
    want = sorted(map(tuple, patch.extract_patches(m, pixels, 3, 4, ("granule_id",)).collect()))
    assert len(want) > 50 and (500, 2) not in {w[:2] for w in want}
    nested = m.join(pixels, "granule_id").where("y >= y_idx - 3 AND y < y_idx + 4 AND x >= x_idx - 3 AND x < x_idx + 4").groupBy("site_id", "granule_id").count().where("count = 49")
    assert sorted(map(tuple, nested.select("site_id", "granule_id").collect())) == [w[:2] for w in want]
    read = lambda: spark.read.parquet(path)
    assert sorted(map(tuple, patch.cube_windows(read(), 16, m, 3, 4).collect())) == want
    monkeypatch.setattr(patch, "SENT_WINDOWS", 3)  # too many to be sent: both sides are shuffled
    assert sorted(map(tuple, patch.cube_windows(read(), 16, m, 3, 4).collect())) == want
    assert patch.cube_windows(read(), 16, m.where("false"), 3, 4).count() == 0


def test_cube_windows_read_little(spark, cube, capsys):
    path, _ = cube
    m = sites(spark, [(1, 1, 20, 20), (2, 3, 22, 21)])
    out = patch.cube_windows(spark.read.parquet(path), 16, m, 2, 2)
    out.explain()
    plan = capsys.readouterr().out
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/c" in line)
    assert "dynamicpruning" in scan and "GreaterThanOrEqual(code" in scan
    assert out.count() == 2
    ran = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in ran and "SortMergeJoin" not in ran
