"""Small tests for the third review's findings."""

import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specgrid.functions import geo
from specgrid.llm import pieces
from specgrid.operators import mapping, patch, stats
from specgrid.plans import geo_queries
from specgrid.plans.views import view
from specgrid.streaming import jobs


def test_sampled_patches_join_nothing(spark):
    tiles = spark.range(40).select(F.col("id").alias("tile_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("c"))
    value = F.when((F.col("tile_id") == 1) | (F.col("c") % 7 != F.col("tile_id") % 7), 1.0).otherwise(-1.0)
    pixels = tiles.select("tile_id", F.floor(F.col("c") / 8).cast("int").alias("y"), (F.col("c") % 8).cast("int").alias("x"), value.alias("value"))
    pixels = pixels.unionByName(pixels.where("tile_id = 3"))
    out = patch.sample_patches(pixels, 2, 20, 8, 4)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    good = {(r.tile_id, r.y, r.x) for r in pixels.where("value > 0 AND tile_id <> 3").collect()}
    got = out.collect()
    assert {r.tile_id for r in got} >= {1} and 3 not in {r.tile_id for r in got}
    for r in got:
        assert all((r.tile_id, r.y0 + a, r.x0 + b) in good for a, b in ((0, 0), (0, 3), (3, 0), (3, 3), (2, 2)))


def test_stretch_puts_values_on_their_step(spark):
    # Percentiles 0 and 0.3 of these values; 0.1 of the way to 0.3 in steps of 255 is 85 but for the last bits.
    rows = [(i, b, v) for i in range(40) for b, v in enumerate([0.1 * i, 0.1 * i + (0.3 + 0.01 * i) * (17 * (i % 14 + 1)) / 255, 0.1 * i + 0.3 + 0.01 * i])]
    cells = spark.createDataFrame(rows, "id int, band int, value double")
    out = {(r.id, r.band): r.u8 for r in stats.stretch(cells, ["id"], 0.0, 1.0).collect()}
    assert all(out[i, 1] == 17 * (i % 14 + 1) for i in range(40))


BOX = ("x0", "x1", "y0", "y1")


@pytest.fixture
def met(spark):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    places = [(i, rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(300)] + [(400, nan, 1.0), (401, None, 1.0), (402, inf, 1.0), (403, 8.0, 8.0), (404, 8.0, 8.0)]
    rows = [(b, f"g{b % 7}", x, x + rng.choice([0.0, 1.0, 9.0, 30.0]), y, y + rng.choice([0.5, 12.0])) for b in range(80) for x, y in [(rng.uniform(-5, 40), rng.uniform(-5, 40))]]
    rows += [(90, None, 0.0, 20.0, 0.0, 20.0), (91, "g1", -inf, inf, 0.0, 3.0), (92, "g2", 5.0, 4.0, 0.0, 9.0), (93, "g3", None, 4.0, 0.0, 9.0), (94, "g4", 1e18, 1.1e18, 0.0, 9.0), (95, "g0", 0.0, nan, 0.0, 9.0)]
    points = spark.createDataFrame(places, "p int, px double, py double")
    boxes = spark.createDataFrame(rows, "b int, g string, x0 double, x1 double, y0 double, y1 double")
    pairs = points.join(boxes, F.expr("px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1")).select("p", "b", "g").collect()
    return points, boxes, pairs


def test_meetings_equal_their_pairs(met):
    points, boxes, pairs = met
    for cell in (1.0, 12.0):
        m = mapping.in_boxes(points, boxes, "px", "py", BOX, cell)
        assert {r.b: r.n_pairs for r in m.counts("b").collect()} == Counter(r.b for r in pairs)
        assert {r.g: r.n_pairs for r in m.counts("g").collect()} == Counter(r.g for r in pairs)
        assert Counter(map(tuple, m.covered(["p"], ["g"]).collect())) == Counter({(r.p, r.g) for r in pairs})
        first = {}
        for r in pairs:
            first[r.p] = min(first.get(r.p, 99), r.b)
        assert {r.p: r.b for r in m.first_box(["p"], "b").select("p", "b").collect()} == first


def test_sites_of_the_same_flightlines_are_one_row(spark, met):
    points, boxes, pairs = met
    points = points.unionByName(points.selectExpr("p", "py AS px", "px AS py"))
    pairs = {(r.p, r.g) for r in points.join(boxes, F.expr("px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1")).select("p", "g").collect()}
    for cell in (1.0, 12.0):
        m = mapping.in_boxes(points.withColumnRenamed("p", "site_id"), boxes.withColumnRenamed("g", "flightline"), "px", "py", BOX, cell)
        lines = mapping.flightline_sites(m)
        counts = lines.groupBy("flightline").agg(F.sum("n_alike").alias("n")).collect()
        assert {r.flightline: r.n for r in counts} == Counter(g for _, g in pairs)
        single = spark.createDataFrame(sorted(pairs, key=str), "site_id int, flightline string").where("flightline IS NOT NULL")
        assert mapping.greedy_cover(lines, 9).collect() == mapping.greedy_cover(single, 9).collect()
        ranks = [sorted(mapping.rank_flightlines(x, 4).collect()) for x in (lines.where("flightline IS NOT NULL"), single)]
        assert ranks[0] == ranks[1]
    dense = spark.range(3000).selectExpr("id AS site_id", "5 + id % 50 / 50 AS px", "5 + id / 3000 AS py")
    wide = spark.createDataFrame([("a", 0.0, 30.0, 0.0, 30.0), ("b", 0.0, 30.0, 0.0, 30.0)], "flightline string, x0 double, x1 double, y0 double, y1 double")
    lines = mapping.flightline_sites(mapping.in_boxes(dense, wide, "px", "py", BOX, 30.0)).collect()
    assert len(lines) < 20 and sum(r.n_alike for r in lines) == 6000


def test_heavy_cells_are_dealt(met, monkeypatch):
    points, boxes, pairs = met
    monkeypatch.setattr(mapping, "TRIED", 10)
    got = mapping.range_join(points, boxes, "px", "py", BOX, 12.0)
    assert got.rdd.getNumPartitions() > 1 and sorted(map(tuple, got.select("p", "b").collect())) == sorted((r.p, r.b) for r in pairs)


def test_granules_of_one_id_keep_their_boxes(spark):
    boxes = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 1.0), ("a", 2.0, 3.0, 0.0, 1.0), ("b", 5.0, 6.0, 0.0, 1.0)], "granule_id string, lat_min double, lat_max double, lon_min double, lon_max double")
    sites = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.5, 0.5), (3, 2.6, 0.5)], "site_id int, lat double, lon double")
    got = mapping.extent_overlap(boxes, sites).select("granule_id", "lat_min", "n_sites").collect()
    assert sorted(map(tuple, got)) == [("a", 0.0, 1), ("a", 2.0, 2), ("b", 5.0, 0)]


def test_projections_are_worked_out_once(spark, data, monkeypatch):
    monkeypatch.setattr(mapping, "KEPT", 50)
    sites, granules = view(spark, data, "v_sites"), view(spark, data, "v_granules")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "ATANH" in plan(geo.with_utm(sites, "lon", "lat"))
    mapped = mapping.mapped_sites(sites, granules)
    for df in (mapped.points, mapping.first_granules(mapped), mapping.map_sites(sites, granules)):
        assert "ATANH" not in plan(df)
    assert len(mapped.points.inputFiles()) == sites.count() // 50 + 1
    assert "TAN" not in plan(geo_queries.j1_bbox_join(spark, data))


def test_resize_deals_tiles_once(spark, monkeypatch):
    monkeypatch.setattr(patch, "RESIZED", 100)
    cells = spark.range(640).selectExpr("CAST(id / 64 AS INT) AS tile_id", "CAST(id % 64 / 8 AS INT) AS y", "CAST(id % 8 AS INT) AS x", "CAST(id AS DOUBLE) AS value")
    out = patch.resize_grid(cells, 8, 16)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.rdd.getNumPartitions() == 7 and out.count() == 2560


def test_stopped_run_reads_no_rows():
    class Held:
        exists = lambda self: True
        get = lambda self: (1.0, 25, 40, True)

    stop = jobs.EarlyStop(25)
    stop.state = Held()
    assert list(stop.handleInputRows((1,), (1 / 0 for _ in range(3)), None)) == []


def test_early_stop_takes_packs():
    batch = pa.RecordBatch.from_pydict({"run": [1, None, 1, None], "step": [1, 2, 3, 4], "metric": [0.5, 1.0, None, 2.0]})
    assert [r for b in jobs._packed(iter([batch])) for r in b.to_pylist()] == [{"run": 1, "step": [1, 3], "metric": [0.5, None]}, {"run": None, "step": [2, 4], "metric": [1.0, 2.0]}]


def test_segments_end_where_no_piece_crosses():
    m = pieces.PieceMachine(pieces.read_model(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"))
    assert m.cut.findall("▁▁héllo,▁wor2ld.▁漢字\n▁$$$xx▁▁") == ["▁▁héllo", ",", "▁wor", "2", "ld", ".", "▁", "漢", "字", "\n", "▁$$$", "xx", "▁▁"]
    ends = {(a[-1], b[0]) for a, b in [("é", ","), ("r", "2"), ("d", "."), (".", "▁"), ("$", "x")]}
    assert not any((a, b) in ends for p in m.ids for a, b in zip(p, p[1:], strict=False))


def test_pairs_stay_apart_as_their_merges_do():
    m = pieces.PieceMachine(pieces.read_model(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"))
    rng = random.Random(7)
    known = sorted(m.ids)
    for _ in range(4000):
        left, right = (rng.choice(known) if rng.random() < 0.9 else rng.choice("漢🙂\x00é ▁") for _ in "ab")
        if rng.random() < 0.3 and len(left) > 1:
            at = rng.randrange(1, len(left))
            left, right = left[:at], left[at:]
        assert m.apart(left, right) == (m.merge(left + right) == [left, right])
    m.scores = {"ab": 1.0, "bc": 1.0, "bb": 1.0, "abc": 0.0}  # equal scores: the leftmost goes first
    for left, right in ("ab", "c"), ("a", "bc"), ("b", "bc"), ("bb", "b"), ("b", "bb"), ("ab", "bc"), ("ab", "ab"):
        m.traces.clear()
        assert m.apart(left, right) == (m.merge(left + right) == [left, right])


def test_memo_keeps_what_is_met_again(monkeypatch):
    m = pieces.PieceMachine(pieces.read_model(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "MEMO", 5)
    found = []
    search = m.segment
    m.segment = lambda s: found.append(s) or search(s)
    words = " ".join(f"often {chr(97 + i)}{chr(99 + i)}zq" for i in range(20))
    assert m.decode(m.encode(words)) == words
    assert found.count("▁often") == 1 and len(found) == 21 and len(m.memo) <= 5 and len(m.old_memo) <= 5


def test_granules_are_filed_under_the_smallest_cells(spark, data, monkeypatch):
    filed = []
    join = mapping.range_join

    def seen(points, boxes, px, py, box, cell):
        filed.extend(r.lv for r in mapping._filed(boxes, box, cell / mapping.WIDE, mapping.WIDE).select("lv").distinct().collect())
        return join(points, boxes, px, py, box, cell)

    def widest(spark, sf, name):  # as granules of larger tables are
        return view(spark, sf, name).withColumn("width", F.lit(799)) if name == "v_granules" else view(spark, sf, name)

    monkeypatch.setattr(mapping, "range_join", seen)
    monkeypatch.setattr(geo_queries, "view", widest)
    assert geo_queries.g3_pixel_index(spark, data).count() > 0 and filed == [0]
