"""Invariants, published numbers, files and streams."""

import math

import pytest
from pyspark.sql import functions as F

from specgrid import constants
from specgrid.functions import geo
from specgrid.functions import spectral as sx
from specgrid.functions.classes import remap_labels
from specgrid.operators import mapping, order, patch, split, stats
from specgrid.plans import pixel_queries  # noqa: F401
from specgrid.plans.registry import QUERIES
from specgrid.plans.views import view
from specgrid.sources import io
from specgrid.streaming import jobs


def test_constants():
    assert len(constants.good_bands()) == 373
    assert len(constants.good_bands(constants.SENSOR_BANDS, constants.SENSOR_BAD_RANGES)) == 202


def test_projection_round_trip(spark):
    df = spark.range(2000).select((17 + F.col("id") % 45 * 0.18).alias("lon"), (-36 + F.col("id") % 41 * 0.1).alias("lat"))
    e, n = geo.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_utm(F.col("e"), F.col("n"))
    far = df.withColumns({"e": e, "n": n}).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(far) < 1e-8
    assert abs(spark.range(1).select(geo.to_utm(F.lit(21.0), F.lit(-34.0))[0]).first()[0] - 500000) < 1e-6


def test_turns_and_scaling_undo(spark, data):
    s = view(spark, data, "v_spectra").limit(20)
    four = F.col("s")
    for _ in range(4):
        four = sx.rot90(four, 4, 4, 1)
    assert s.where(four != F.col("s")).count() == 0
    tokens = patch.tokenize(s, "s", (4, 4, 4), (2, 2, 2))
    back = patch.untokenize(tokens, (4, 4, 4), (2, 2, 2))
    assert back.join(s, "id").where(F.col("values") != F.col("s")).count() == 0


def test_folds_and_splits(spark, data):
    pred = view(spark, data, "v_pred")
    folds = split.group_kfold(pred, "flightline", 5).groupBy("flightline").agg(F.countDistinct("fold").alias("n"))
    assert folds.where("n > 1").count() == 0
    n = pred.count()
    parts = {r.part: r["count"] for r in split.split(pred, "id", 0.21).groupBy("part").count().collect()}
    assert parts["val"] == math.ceil(n * 0.21) and sum(parts.values()) == n


def test_published_metrics(spark):
    rows = [(2.5, 3.5), (10.0, 9.0), (4.0, 4.0)]
    df = spark.createDataFrame(rows, "actual double, predicted double")
    m = stats.regression_metrics(df).first()
    mean = sum(a for a, _ in rows) / 3
    assert m.r2 == pytest.approx(1 - 2 / sum((a - mean) ** 2 for a, _ in rows))
    assert stats.regression_metrics(df.limit(1)).first().r2 == 0.0
    # mean and sample deviation of three published leave-one-out scores
    folds = spark.createDataFrame([(-12.26,), (-2.89,), (-12.93,)], "r2 double")
    assert stats.fold_summary(folds).first()["mean"] == pytest.approx(-9.36, abs=0.005)


def test_empty_tables(spark, data):
    pred = view(spark, data, "v_pred").where("false")
    assert stats.regression_metrics(pred, ["split"]).count() == 0
    assert order.global_rank(pred, "actual", "id").count() == 0
    assert mapping.map_sites(view(spark, data, "v_sites").where("false"), view(spark, data, "v_granules")).count() == 0


def test_remap(spark):
    codes = spark.createDataFrame([(10,), (90,), (95,), (100,), (7,), (None,)], "c int")
    got = [tuple(r) for r in codes.select(remap_labels(F.col("c"), constants.WORLDCOVER), remap_labels(F.col("c"), constants.WORLDCOVER, compat=True)).collect()]
    assert [g[0] for g in got] == [0, 8, 9, 10, -1, -1]
    assert [g[1] for g in got[:4]] == [0, 0, 8, 0]


def test_range_join_equals_nested_loop(spark):
    boxes = spark.range(40).selectExpr("id AS b", "id * 1.7 AS x0", "id * 1.7 + id % 7 AS x1", "id % 5 * 3.0 AS y0", "id % 5 * 3.0 + 4 AS y1")
    points = spark.range(300).selectExpr("id AS p", "id * 0.31 AS px", "id % 17 * 1.0 AS py")
    got = mapping.range_join(points, boxes, "px", "py", ("x0", "x1", "y0", "y1"), 2.5).select("p", "b")
    want = points.join(boxes, F.expr("px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1")).select("p", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_files(spark, data, tmp_path):
    sites = view(spark, data, "v_sites")
    io.write_report(sites.select(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), "richness"), f"{tmp_path}/sites")
    assert io.read_sites(spark, f"{tmp_path}/sites").agg(F.sum("lat")).first()[0] == pytest.approx(sites.agg(F.sum("lat")).first()[0])
    ids = spark.createDataFrame([(" b ",), ("a",), ("",), ("a",)], "native_id string")
    io.write_inventory(ids.where("trim(native_id) <> ''"), f"{tmp_path}/inv")
    assert sorted(r[0] for r in io.read_inventory(spark, f"{tmp_path}/inv").collect()) == ["a", "b"]
    (tmp_path / "g").mkdir()
    for n in ("x.nc", "y.nc", "z.txt"):
        (tmp_path / "g" / n).write_text(n)
    assert sorted(r.name for r in io.list_granules(spark, [str(tmp_path / "g")]).collect()) == ["x.nc", "y.nc"]
    calls = []

    def build():
        calls.append(1)
        return sites

    first = io.cached(spark, build, f"{tmp_path}/cache").count()
    assert io.cached(spark, build, f"{tmp_path}/cache").count() == first and len(calls) == 1
    io.cached(spark, build, f"{tmp_path}/cache", refresh=True)
    assert len(calls) == 2
    cube = view(spark, data, "v_pixels").withColumnRenamed("tile_id", "granule_id").where("granule_id < 3")
    io.write_cube(cube, f"{tmp_path}/cube")
    assert spark.read.parquet(f"{tmp_path}/cube").count() == 3 * 64
    spectra = view(spark, data, "v_spectra")
    io.export_pack(spectra, [1.0] * 64, f"{tmp_path}/pack", 4, 4)
    assert spark.read.json(f"{tmp_path}/pack/metadata").first()["count"] == spectra.count()


def test_geojson(spark):
    f = spark.createDataFrame([(1, {"k": "v"}, [(500000.0, 6200000.0), (500030.0, 6200000.0)])], "footprint_id int, props map<string,string>, ring array<struct<x:double,y:double>>")
    assert '"type":"Polygon"' in io.to_geojson(f).first().feature


def test_metadata(spark, tmp_path):
    box = '{"WestBoundingCoordinate":1,"SouthBoundingCoordinate":2,"EastBoundingCoordinate":3,"NorthBoundingCoordinate":4}'
    line = '{"meta":{"native-id":"g%d"},"umm":{"SpatialExtent":{"HorizontalSpatialDomain":{"Geometry":{"BoundingRectangles":[%s]}}}}}'
    (tmp_path / "m.json").write_text("\n".join([line % (1, box), line % (2, f"{box},{box}"), line % (3, "")]))
    assert sorted(r.native_id for r in io.read_granule_metadata(spark, str(tmp_path / "m.json")).collect()) == ["g1", "g2", "g2"]


def test_ingest_once(spark, data, tmp_path):
    rows = view(spark, data, "v_pixels").withColumnRenamed("tile_id", "granule_id").select("granule_id", "value").groupBy("granule_id").agg(F.sum("value").alias("value"))
    rows.where("granule_id < 50").write.parquet(f"{tmp_path}/src")
    for _ in range(2):
        jobs.ingest_stream(spark, f"{tmp_path}/src", "granule_id long, value double", f"{tmp_path}/dst", f"{tmp_path}/ck").awaitTermination()
    rows.where("granule_id >= 40 AND granule_id < 80").write.mode("append").parquet(f"{tmp_path}/src")
    jobs.ingest_stream(spark, f"{tmp_path}/src", "granule_id long, value double", f"{tmp_path}/dst", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/dst")
    assert got.count() == got.select("granule_id").distinct().count() == 80


def test_early_stop_stream_equals_window(spark, data, tmp_path):
    log = view(spark, data, "v_log").select("run", "step", "metric")
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    q = jobs.early_stop_stream(stream, 25).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.run, r.step, r.best, r.since) for r in spark.table("stops").collect())
    want = sorted((r.run, r.step, r.best, r.since) for r in stats.early_stop(log, 25).collect())
    assert got == want


def test_sincos_whole(spark, data):
    got = QUERIES["x25_sincos"](spark, data).where("id < 3").collect()
    assert len(got) == len({(r.id, r.y, r.x, r.pos) for r in got}) == 3 * 64 * 16
    for r in got:
        v, i = (r.x, r.pos) if r.pos < 8 else (r.y, r.pos - 8)
        assert r.value == pytest.approx((math.sin if i < 4 else math.cos)(v / 10000 ** (i % 4 / 4)), abs=1e-7)


def test_rank_within_large_group(spark):
    rows = [("big" if i % 10 else None if i % 20 else "small", i * 7919 % 3001, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, a int, b long")
    got = {(r.g, r.a, r.b): r.n for r in order.rank_within(df, "g", "a", "b", name="n").collect()}
    assert len(got) == 3000
    for g in ("big", "small", None):
        assert [got[k] for k in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])] == list(range(1, sum(r[0] == g for r in rows) + 1))
    assert order.rank_within(df.where("false"), "g", "a", "b").count() == 0


def test_pixel_locations_build_no_lists(spark, data, capsys):
    QUERIES["s14_pixel_locations"](spark, data).explain()
    assert "collect_list" not in capsys.readouterr().out


def test_explode_locations(spark):
    lists = spark.createDataFrame([("a", [(1, 2), (3, 4)])], "class string, locations array<struct<y:int,x:int>>")
    assert [tuple(r) for r in io.explode_locations(lists).orderBy("ord").collect()] == [("a", 0, 1, 2), ("a", 1, 3, 4)]


def test_global_rank_splits_ties(spark):
    rows = [(1.0 if i % 3 else 2.0, i * 7919 % 3001) for i in range(3000)] + [(None, 5), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "a double, b long")
    plan = order.global_rank(df, "a", "b", parts=8)
    got = {(repr(r.a), r.b): r["rank"] for r in plan.collect()}
    right = sorted(rows, key=lambda r: (r[0] is not None, r[0] != r[0], r[0] or 0, r[1]))
    assert [got[repr(a), b] for a, b in right] == list(range(1, 3003))
    sizes = [r["count"] for r in order.ranged(df, "a", "b", parts=8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
