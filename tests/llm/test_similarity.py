"""MinHash, components, vectors and the forest against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from specgrid.llm import common, components, forest, minhash, vectors


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, common.Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == union_find({x for e in real for x in e}, real)
    assert components.connected_components(df.where("false"), common.Scratch(spark, "t")).count() == 0


def brute_minhash(docs):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = []
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                links.append((a, b))
    comp = union_find(ids, links)
    return sorted((d, len(sets[d]), comp[d], comp[d] == d) for d in ids)


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 20, 80, 300]))]
        for copy in range(rng.choice([1, 2, 9, 25])):
            t = list(text)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((base * 100 + copy, " ".join(t)))
    docs += [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "  "), (9005, " ".join(rng.choice(words) for _ in range(20000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit("x")).withColumn("component_id", F.lit(0))
    got = sorted(tuple(r) for r in minhash.near_duplicates(df).collect())
    assert got == brute_minhash(docs)
    again = minhash.near_duplicates(df.where("doc_id < 200").union(df.where("doc_id < 100")))
    assert sorted(set(map(tuple, again.collect()))) == brute_minhash([d for d in docs if d[0] < 200])
    nulls = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in nulls) == [(0, None, False), (1, 1, True)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    for share in (0.3, 0.6, 0.9):
        n = int(4000 * share)
        other = np.concatenate([base[:n], rng.integers(0, 1 << 62, 4000 - n).astype(np.uint64)])
        true = n / (8000 - n)
        got = (minhash.signature(base, 400) == minhash.signature(other, 400)).mean()
        assert abs(got - true) < 0.12


def brute_vectors(table, cosine):
    fine = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in table if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for x, (i, v, a) in enumerate(fine):
        for j, w, b in fine[x + 1 :]:
            if a == b and len(v) == len(w) and i != j and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                links.append((i, j))
    ids = {i for i, _, _ in table}
    comp = union_find(ids, links)
    return sorted((i, sum(i in p for p in links), comp[i], comp[i] == i) for i in ids)


def test_near_vectors(spark):
    rng = np.random.default_rng(7)
    table, n = [], 0
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            v = base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.2])
            table.append((n, [float(x) for x in np.float32(v)], int(rng.integers(0, 2))))
            n += 1
    table += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, table[0][1], None), (n + 4, [None] * 16, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x"))
    want = brute_vectors(table, 0.98)
    assert sorted(tuple(r) for r in vectors.near_vectors(df).collect()) == want
    # cells dealt over parts, wide blocks and repeated rows change nothing
    assert sorted(tuple(r) for r in vectors.near_vectors(df, cell=2).collect()) == want
    assert sorted(set(map(tuple, vectors.near_vectors(df.union(df.limit(9)), width=5).collect()))) == want
    assert vectors.near_vectors(df.where("false")).count() == 0


def brute_nearest(table, every, k):
    fine = sorted({i: np.array(v, dtype=np.float64) for i, v in table if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}.items())
    out = {}
    for i, q in fine:
        if i % every == 0:
            out[i] = sorted(((-(q * v).sum(), j) for j, v in fine if j != i))[:k]
    return out


def test_nearest(spark, data):
    emb = spark.read.parquet(f"{data}/embeddings.parquet")
    got = forest.nearest(emb.withColumn("part", F.lit(1)), part=40).collect()
    want = brute_nearest([(r.vec_id, r.embedding) for r in emb.collect()], 20, 20)
    assert {r.query_id for r in got} == set(want)
    hit = sum((-r.score, r.vec_id) in {(s, j) for s, j in want[r.query_id]} for r in got)
    assert hit / sum(map(len, want.values())) >= 0.9
    for q in want:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [(-s, v) for _, s, v in mine] == sorted((-s, v) for _, s, v in mine)


def test_nearest_small(spark):
    table = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [2.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in forest.nearest(df).collect()]
    assert sorted(got) == [(0, 1, 7, 2.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (20, 1, 7, 2.0), (20, 2, 0, 1.0), (20, 3, 3, 1.0)]
    assert forest.nearest(df.where("false")).count() == 0
    many = spark.range(400).selectExpr("id AS vec_id", "array(float(1), float(2)) AS embedding")
    assert [r.vec_id for r in forest.nearest(many, part=30).where("query_id = 0").orderBy("rank").collect()] == list(range(1, 21))


def test_near_vectors_types(spark):
    near = [(1, [1.0, 1e-9], "a"), (2, [1.0, 1e-9], "a"), (3, [1.0, 0.01], "a"), (4, [1.0, 1e-9], "b"), (5, [1.0, 0.01], None)]
    got = vectors.near_vectors(spark.createDataFrame(near, "vec_id long, embedding array<double>, label string"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}
    odd = vectors.near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 1.2), (2, [1.0, 2.0], 1.7)], "vec_id long, embedding array<float>, label double"))
    assert [r.n_links for r in odd.collect()] == [0, 0]


def test_nearest_from_two_layouts(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    one, two = (rows_of(forest.nearest(table.repartition(n), every=50, k=5, sample=400, part=200)) for n in (3, 7))
    assert one == two and len(one) == 30 * 5


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_nearest_gives_all_candidates_of_small_tables(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 17, 18, 21, 25, 40, 60):
        table = [(i, rng.normal(size=16).tolist()) for i in range(n)]
        got = forest.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>"), every=1, k=17).collect()
        want = brute_nearest(table, 1, 17)
        count = {q: sum(r.query_id == q for r in got) for q in range(n)}
        assert count == {q: min(17, n - 1) for q in range(n)}
        if n <= 18:
            assert {(r.query_id, r.vec_id) for r in got} == {(q, j) for q in want for _, j in want[q]}


def test_nearest_of_several_lengths(spark):
    rng = np.random.default_rng(9)
    table = [(i, rng.normal(size=16).tolist()) for i in range(60)] + [(100, [1.0, 2.0]), (101, [1.0, 0.0]), (102, [0.0, 3.0]), (120, [5.0]), (102, [9.0, 9.0]), (102, [9.0, 9.0])]
    got = rows_of(forest.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>"), every=20, k=20))
    assert [g for g in got if g[0] == 100] == [(100, 1, 102, 27.0), (100, 2, 101, 1.0)]
    assert not [g for g in got if g[0] == 120] and {g[2] for g in got if g[0] == 40}.isdisjoint({100, 101, 102, 120})
    assert all(sum(g[0] == q for g in got) == 20 for q in (0, 20, 40))


def test_nearest_deals_the_queries_of_a_leaf(spark):
    table = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    one, two = (rows_of(forest.nearest(table, every=2, k=5, part=p)) for p in (4000, 20))
    assert one == two and len(one) == 150 * 5


def test_groups_of_a_hot_cell_are_bounded(spark):
    rng = np.random.default_rng(10)
    one = rng.normal(size=16)
    table = [(i, (one + rng.normal(size=16) * 1e-4).tolist(), 1) for i in range(400)] + [(1000 + i, (one + rng.normal(size=16) * 0.3).tolist(), 1) for i in range(100)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    placed = df.select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("label"), F.lit(16).alias("dim"), "embedding")
    point = "label long, dim int, block int, cx int, cy int, part int, other int, role int, id long, point array<float>"
    common.ship(spark)
    placed = common.Scratch(spark, "t").keep(placed.mapInArrow(vectors._place(0.98, 8, 5), point))
    sizes = vectors.in_parts(placed, 10, common.Scratch(spark, "t")).groupBy(*vectors._KEY).count().agg(F.max("count")).first()[0]
    assert sizes <= 50 < placed.groupBy(*vectors._CELL).count().agg(F.max("count")).first()[0]
    want = brute_vectors(table, 0.98)
    for cell in (2, 10, 2000):
        assert sorted(tuple(r) for r in vectors.near_vectors(df, cell=cell).collect()) == want


def test_members_meet_each_anchor_of_their_bucket_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 8)
    rows = [(1, i, i * 7, i % 4 == 0, 80, 20) for i in range(80)] + [(2, 5, 9, True, 1, 32)]
    cells = minhash._dealt(spark.createDataFrame(rows, "bucket long, id long, set_a long, used boolean, n long, spread long")).collect()
    groups = {}
    for r in cells:
        groups.setdefault((r.bucket, r.part, r.head), []).append(r)
    met = [(k[0], m.id, a.id) for k, g in groups.items() for m in g if m.member for a in g if a.anchor]
    assert sorted(met) == sorted((b, i, j) for b, i, *_ in rows for c, j, _, used, *_ in rows if b == c and used)
    assert max(len(g) for g in groups.values()) < 40
