"""Small tests for the fourth review's findings."""

import math
import random

from pyspark.sql import functions as F

from specgrid.functions import geo
from specgrid.operators import mapping
from specgrid.plans import geo_queries
from specgrid.plans.views import view

GRANULES = "gid int, granule_id string, origin_x double, pixel_w double, origin_y double, pixel_h double, width long, height long"


def test_patch_bounds_are_worked_out_once_a_lattice(spark, data, monkeypatch):
    worked = []
    bounds = geo.with_patch_bounds

    def seen(df, *args):
        worked.append(df.count())
        return bounds(df, *args)

    def dense(spark, sf, name):  # many granules at the same places
        df = view(spark, sf, name)
        return df if name == "v_sites" else df.crossJoin(spark.range(50)).withColumn("gid", F.col("gid") * 50 + F.col("id")).drop("id")

    monkeypatch.setattr(geo, "with_patch_bounds", seen)
    monkeypatch.setattr(geo_queries, "view", dense)
    out = geo_queries.g5_patch_bounds(spark, data)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("ATAN2")
    assert sum(worked) * 10 < out.count()


def test_patch_bounds_equal_those_of_each_pair(spark, monkeypatch):
    rng = random.Random(9)
    granules = [(i, 2.4e5 + 1000 * rng.randrange(30), 30.0, 6.2e6 + 1000 * rng.randrange(30), -30.0, 600 + i, 700 - i) for i in range(40)]
    granules += [(i, 2.4e5 + rng.uniform(0, 3e4), rng.choice([7.3, 30.0, -30.0]), 6.2e6 + rng.uniform(0, 3e4), rng.choice([-30.0, 0.5]), 900, 40000) for i in range(40, 60)]
    granules += [(i, 2.5e5 + 10 * rng.randrange(99), rng.choice([-30.0, 7.0, 30.0]), 6.2e6 + 10 * rng.randrange(99), rng.choice([30.0, -11.0]), 800, 900) for i in range(60, 80)]
    granules += [(80, -3000.0, 30.0, 3000.0, -30.0, 200, 200), (81, 10.0, 30.0, 90.0, -30.0, 600, 600), (82, 0.25, 3.0, 1.0, -7.0, 900, 900)]  # about zero
    granules += [(83, 1e4, 30.0, 6.5e6, -30.0, 10**5, 10**5), (84, 2.0**51, 64.0, 2.0**51, -64.0, 600, 600), (85, 2.4e5, 0.0, 6.2e6, -30.0, 600, 600)]
    granules += [(86, None, 30.0, 6.2e6, -30.0, 600, 600), (87, 2.4e5, 30.0, 6.2e6, None, 600, 600), (88, 2.4e5, 30.0, 6.2e6, -30.0, -5, 600)]
    granules = spark.createDataFrame([(g[0], f"g{g[0] % 30}", *g[1:]) for g in granules], GRANULES)
    places = [(rng.uniform(2.4e5, 2.7e5), rng.uniform(6.18e6, 6.23e6)) for _ in range(150)]
    edges = [(2.4e5 + 30.0 * rng.randrange(900) + 10 * rng.randrange(3), 6.2e6 - 30.0 * rng.randrange(600) + 10 * rng.randrange(3)) for _ in range(60)]
    places += [(f(e), g(n)) for e, n in edges for f, g in [(lambda v: v,) * 2, (lambda v: math.nextafter(v, 0), lambda v: math.nextafter(v, 1e9)), (lambda v: math.nextafter(v, 1e9), lambda v: math.nextafter(v, 0))]]
    places += [(rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for _ in range(60)] + [(300.0 + 30 * i, -240.0 - 30 * i) for i in range(9)]
    places += [(2.0**51 + 640.5, 2.0**51 - 704.5), (None, 6.2e6), (float("nan"), 6.2e6), (float("inf"), 6.2e6)]
    sites = spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate(places)], "site_id int, e double, n double")
    monkeypatch.setattr(mapping, "located_sites", lambda df: df)
    cols = ["site_id", "gid", "granule_id", "lat_min", "lon_min", "lat_max", "lon_max"]
    told = geo.with_patch_bounds(mapping.map_sites(sites, granules), "x_idx", "y_idx", 8).select(cols).collect()
    assert {r.gid for r in told} >= {*range(80), 80, 81, 82, 83, 84}
    for shared, most in ((0, mapping.TRIED), (0, 40), (mapping.SHARED, 40)):  # 40: classes of a cell are dealt over parts
        monkeypatch.setattr(mapping, "SHARED", shared)
        monkeypatch.setattr(mapping, "TRIED", most)
        got = mapping.patch_bounds(sites, granules).select(cols).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, told))
