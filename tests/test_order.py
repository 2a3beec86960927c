"""Ranks by ranges and exact quantiles, with what their plans hold."""

import random

import numpy as np
import pytest

from specgrid.operators import order, split, stats


def test_rank_plan_has_no_list_of_cuts(spark, capsys):
    for parts in (4, 60):
        order.global_rank(spark.range(1000).selectExpr("id * 7919 % 3001 AS a", "id AS b"), "a", "b", parts=parts).explain(True)
        plan = capsys.readouterr().out
        assert "array(" not in plan and "filter(" not in plan
        sizes = len(plan)
        assert sizes < 20_000


def test_rank_of_ties_and_parts(spark):
    df = spark.range(500).selectExpr("id % 3 AS a", "id")
    for parts in (1, 5):
        got = sorted((r["rank"], r.a) for r in order.global_rank(df, "a", parts=parts).collect())
        assert [g[0] for g in got] == list(range(1, 501)) and [g[1] for g in got] == sorted(r % 3 for r in range(500))


def test_split_is_the_same_for_any_layout(spark):
    df = spark.range(700).selectExpr("id AS k")
    a = split.split(df, "k", 0.3).where("part = 'val'")
    b = split.split(df.repartition(13), "k", 0.3).where("part = 'val'")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 210


def values(kind):
    rng = random.Random(5)
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(4000)]
    if kind == "ties":
        return [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(4000)]
    if kind == "few":
        return [3.5, None, 1.25]
    return [rng.gauss(1e6, 1) for _ in range(4000)] + [None] * 50


@pytest.mark.parametrize("kind", ["near", "wide", "ties", "few"])
@pytest.mark.parametrize("small", [10, 100_000])
def test_quartiles_are_exact(spark, monkeypatch, kind, small):
    monkeypatch.setattr(order, "SMALL", small)
    told = values(kind)
    got = stats.describe(spark.createDataFrame([(v,) for v in told], "v double"), "v").first()
    real = np.array([v for v in told if v is not None])
    assert got.n == len(real) and got["min"] == real.min() and got["max"] == real.max()
    assert [got.q25, got.q50, got.q75] == pytest.approx(np.quantile(real, [0.25, 0.5, 0.75]).tolist(), rel=1e-12)


def test_brackets_keep_few_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "SMALL", 10)
    seen = []
    real = order.ranged
    monkeypatch.setattr(order, "ranged", lambda df, *a, **k: seen.append(out := real(df, *a, **k)) or out)
    df = spark.range(60_000).selectExpr("CAST(id * 7919 % 60013 AS DOUBLE) AS v")
    got = stats.describe(df, "v").first()
    want = np.quantile([i * 7919 % 60013 for i in range(60_000)], [0.25, 0.5, 0.75])
    assert [got.q25, got.q50, got.q75] == want.tolist()
    assert len(seen) == 1 and seen[0].count() < 60_000 * 0.03


def test_a_wrong_sketch_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(order, "SMALL", 10)
    df = spark.range(101).selectExpr("CAST(id AS DOUBLE) AS v")
    assert order.quantiles(df, "v", [0.5, 1.0], 101, [1.0, 2.0, 3.0, 4.0]) == [50.0, 100.0]
    assert order.quantiles(df.where("false"), "v", [0.5], 0) == [None]
