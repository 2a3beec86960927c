"""Folds, complements, cover and linear heads against their plain readings, and what their plans hold."""

import random
from collections import Counter

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from specgrid.operators import mapping, model, split, stats


def one_by_one(sizes, k):
    loads, out = [0] * k, []
    for size in sorted(sizes, reverse=True):
        for rank in range(1, sizes[size] + 1):
            f = loads.index(min(loads))
            loads[f] += size
            out.append((size, rank, f))
    return out


def test_fold_runs_equal_greedy():
    rng = random.Random(1)
    for _ in range(300):
        k = rng.randrange(1, 8)
        sizes = Counter(rng.choice([1, 1, 2, 3, 7, 50, 1000]) for _ in range(rng.randrange(1, 200)))
        runs = split.fold_runs(sizes, k)
        got = [(n, rank, turn[(rank - first) % len(turn)]) for n, first, last, turn in runs for rank in range(first, last + 1)]
        assert got == one_by_one(sizes, k)
        assert len(runs) <= k * len(sizes)


def test_group_kfold(spark, capsys):
    rng = random.Random(2)
    rows = [(g, i) for g in range(60) for i in range(rng.choice([1, 2, 2, 5, 40]))]
    df = spark.createDataFrame(rows, "g int, i int")
    out = split.group_kfold(df, "g", 4)
    count = Counter(g for g, _ in rows)
    rank, want = Counter(), {}
    folds = {(n, r): f for n, r, f in one_by_one(Counter(count.values()), 4)}
    for g in sorted(count):
        rank[count[g]] += 1
        want[g] = folds[count[g], rank[count[g]]]
    assert {r.g: r.fold for r in out.collect()} == want and out.count() == len(rows)
    out.explain()
    plan = capsys.readouterr().out
    assert "Pandas" not in plan and "Python" not in plan


def test_complements(spark, capsys):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(40)) for _ in range(300)] + [(None, 1), (2, None)]
    df = spark.createDataFrame(rows, "g int, s int")
    whole = [r for r in rows if None not in r]
    seen, pairs = set(whole), Counter(whole)
    want = sorted((f, s, g, n) for f in range(6) for (g, s), n in pairs.items() if (f, s) not in seen)
    assert sorted(map(tuple, split.leave_one_group_out(df, "g", "s").collect())) == want
    sizes = split.held_out_sizes(df, "g", "s")
    assert sorted(map(tuple, sizes.collect())) == [(f, sum(w[0] == f for w in want), sum(w[3] for w in want if w[0] == f)) for f in range(6) if any(w[0] == f for w in want)]
    sizes.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def greedy(rows, n):
    left, out = {(f, s) for f, s in rows if f is not None and s is not None}, []
    for step in range(1, n + 1):
        k = Counter(f for f, _ in left)
        if not k:
            break
        best = min(k, key=lambda f: (-k[f], f))
        gone = {s for f, s in left if f == best}
        out.append((step, best, k[best]))
        left = {(f, s) for f, s in left if s not in gone}
    return out


@pytest.mark.parametrize("ahead", [1, 4, 50])
def test_greedy_cover(spark, ahead):
    rng = random.Random(4)
    rows = [(rng.randrange(12), rng.randrange(90) * 1_000_003) for _ in range(260)] + [(3, 7), (3, 7), (None, 1), (1, None)]
    df = spark.createDataFrame(rows, "flightline long, site_id long")
    assert list(map(tuple, mapping.greedy_cover(df, 20, ahead).collect())) == greedy(rows, 20)
    assert mapping.greedy_cover(df.where("false"), 3).count() == 0


def test_heads_equal_sparks_own(spark):
    rng = random.Random(5)
    rows = [(i % 3, [1e4 + rng.gauss(0, 1), rng.gauss(0, 5), 2.0], 100 + rng.gauss(0, 2) + i % 5) for i in range(300)] + [(None, [1.0, 1.0, 1.0], 1.0), (1, None, 1.0), (1, [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "fold int, x array<double>, y double")
    got = {r.fold: r for r in model.cv_score(df, "x", "y", "fold").collect()}
    vec = df.dropna().select("fold", array_to_vector("x").alias("v"), "y")
    for f in range(3):
        fit = LinearRegression(featuresCol="v", labelCol="y", regParam=model.RIDGE, solver="normal").fit(vec.where(F.col("fold") != f))
        want = stats.regression_metrics(fit.transform(vec.where(F.col("fold") == f)).select(F.col("y").alias("actual"), F.col("prediction").alias("predicted"))).first()
        assert got[f].n == want.n and got[f].rmse == pytest.approx(want.rmse, rel=1e-6) and got[f].r2 == pytest.approx(want.r2, abs=1e-6)
    assert model.cv_score(df.where("false"), "x", "y", "fold").count() == 0
    forest = model.cv_score_forest(df.dropna(), "x", "y", "fold", [0, 1])
    assert {r.fold for r in forest.collect()} == {0, 1}
