"""Nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits at the median of its
sample along the line between two random members. Every vector is then filed in
one leaf of each tree. A query walks all trees at once through one priority
queue, ordered by the worst margin on the way, and takes the first ``probes``
leaves. ``probes`` is the smallest number that finds ``recall`` of the true
neighbours of sample queries within the sample; a query goes on until its leaves
hold ``k`` others for certain, or it has opened all. The vectors of those leaves
are ranked exactly: leaf by leaf the best ``k``, then the best of all leaves.

Joining queries and vectors by leaf spreads the work over leaves; a leaf with
many vectors is dealt over parts that each give their own best ``k``, and the
queries of a leaf that many open are dealt too. Vectors of each length have a
forest of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch, ship
from specgrid.llm.vectors import as_matrix, own_type, usable

TREES = 6
#: Rows that the trees are fitted on at most.
SAMPLE = 20_000
#: Leaves of a tree, about, or one for every FILL vectors if that is more; a leaf holds at least LEAST sample rows.
LEAVES, LEAST, FILL = 128, 16, 1000
#: Vectors that one task ranks for a leaf.
PART = 4000
RECALL = 0.95
SAMPLE_QUERIES = 300


@dataclass
class Forest:
    """Nodes of all trees in one array each; ``left`` < 0 marks leaf number ``-left - 1``."""

    roots: list[int]
    normals: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int
    probes: int = 1
    tree: list[int] = field(default_factory=list)
    """The tree of each leaf."""

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            live = np.flatnonzero(self.left[at] >= 0)
            while len(live):
                nodes = at[live]
                side = (x[live] * self.normals[nodes]).sum(axis=1) <= self.cuts[nodes]
                at[live] = np.where(side, self.left[nodes], self.right[nodes])
                live = live[self.left[at[live]] >= 0]
            out[:, t] = -self.left[at] - 1
        return out

    def search(self, query: np.ndarray, probes: int, held: list[int] | None = None, need: int = 0) -> list[int]:
        """First ``probes`` leaves from the shared priority queue, and more until those of one tree, which share nothing, have ``need`` vectors by ``held``."""
        margins = (self.normals @ query - self.cuts).tolist()
        left, right = self.left, self.right
        heap = [(-np.inf, r) for r in self.roots]
        out: list[int] = []
        sure = [0] * len(self.roots)
        while heap and (len(out) < probes or (held is not None and max(sure) < need)):
            worst, node = heapq.heappop(heap)
            if left[node] < 0:
                leaf = int(-left[node] - 1)
                out.append(leaf)
                if held is not None:
                    sure[self.tree[leaf]] += held[leaf]
                continue
            m = margins[node]
            heapq.heappush(heap, (max(worst, m), int(left[node])))
            heapq.heappush(heap, (max(worst, -m), int(right[node])))
        return out


def grow(x: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 3) -> Forest:
    """Forest over sample rows ``x``."""
    rng = np.random.default_rng(seed)
    size = max(LEAST, -(-len(x) // leaves))
    normals, cuts, left, right, roots = [], [], [], [], []
    count = 0

    def node(rows: np.ndarray) -> int:
        nonlocal count
        at = len(cuts)
        normals.append(np.zeros(x.shape[1]))
        cuts.append(0.0)
        left.append(0)
        right.append(0)
        if len(rows) > size:
            a, b = rng.choice(rows, 2, replace=False)
            w = x[a] - x[b]
            if not w.any():
                w = rng.normal(size=x.shape[1])
            w = w / np.linalg.norm(w)
            p = x[rows] @ w
            cut = float(np.median(p))
            low = p <= cut
            if low.any() and not low.all():
                normals[at], cuts[at] = w, cut
                left[at], right[at] = node(rows[low]), node(rows[~low])
                return at
        count += 1
        left[at] = -count
        return at

    tree: list[int] = []
    for t in range(trees):
        roots.append(node(np.arange(len(x))))
        tree += [t] * (count - len(tree))
    return Forest(roots, np.array(normals), np.array(cuts), np.array(left), np.array(right), count, tree=tree)


def tune(forest: Forest, x: np.ndarray, k: int, recall: float, queries: int = SAMPLE_QUERIES) -> int:
    """Least number of leaves that finds ``recall`` of the ``k`` nearest within the sample."""
    if len(x) < 2:
        return forest.leaves
    of = [set() for _ in range(forest.leaves)]
    for row, where in enumerate(forest.file(x)):
        for leaf in where:
            of[leaf].add(row)
    asked = np.unique(np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int))
    k = min(k, len(x) - 1)
    found = np.zeros((len(asked), forest.leaves))
    for i, q in enumerate(asked):
        s = x @ x[q]
        s[q] = -np.inf
        missing = set(np.argpartition(-s, k - 1)[:k].tolist())
        order = forest.search(x[q], forest.leaves)
        for j, leaf in enumerate(order):
            found[i, j] = len(missing & of[leaf])
            missing -= of[leaf]
    curve = found.cumsum(axis=1).mean(axis=0) / k
    return int(np.argmax(curve >= recall) + 1) if (curve >= recall).any() else forest.leaves


def best(ids: np.ndarray, x: np.ndarray, query_id: int, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest inner products, ties to smaller ids; ``rough`` are the same products up to rounding."""
    ok = np.flatnonzero(ids != query_id)
    if len(ok) > k:
        at_least = np.partition(rough[ok], len(ok) - k)[len(ok) - k]
        ok = ok[rough[ok] >= at_least - 1e-9 * max(1.0, abs(at_least))]
    score = (x[ok] * query).sum(axis=1)
    order = np.lexsort((ids[ok], -score))[:k]
    return ids[ok][order], score[order]


def _rank_leaf(k: int):
    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            x = np.stack(vectors["embedding"].to_numpy()).astype(np.float64)
            ids = vectors["vec_id"].to_numpy()
            asked = queries["query_id"].to_numpy()
            step = max(1, 4_000_000 // len(ids))
            for at in range(0, len(asked), step):
                q = np.stack(queries["query"].to_numpy()[at : at + step]).astype(np.float64)
                rough = q @ x.T
                for i, name in enumerate(asked[at : at + step]):
                    got, score = best(ids, x, name, q[i], rough[i], k)
                    out["query_id"].append(np.full(len(got), name))
                    out["vec_id"].append(got)
                    out["score"].append(score)
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()})

    return run


def nearest(
    vectors: DataFrame, *, every: int = 20, k: int = 20, trees: int = TREES, sample: int = SAMPLE, recall: float = RECALL, part: int = PART, seed: int = 3
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of ``vectors(vec_id, embedding)`` by inner product.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows of the same length but those with the query's own vec_id; a query gets
    ``k`` rows, or all its candidates if they are fewer. Equal scores go to the
    smaller vec_id. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows with a null vec_id. Rows that repeat a
    vec_id and vector count once; of several vectors under one vec_id the best
    score counts. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "forest")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), own_type(vectors, "embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])
    rows = scratch.keep(rows.withColumn("dim", F.size("embedding")), "rows")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids")).orderBy("dim").collect()  # a row a length
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for r in sizes:
        own = rows.where(F.col("dim") == r.dim).drop("dim")
        leaves = max(LEAVES, min(r.n // FILL, sample // LEAST))
        found = found.unionByName(_of_length(own, r.dim, r.n, k + 1 + r.n - r.ids, every, k, trees, leaves, sample, recall, part, seed, scratch))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(
    rows: DataFrame, dim: int, n: int, need: int, every: int, k: int, trees: int, leaves: int, sample: int, recall: float, part: int, seed: int, scratch: Scratch
) -> DataFrame:
    """Best candidates ``(query_id, vec_id, score)`` of each leaf's part, among ``n`` vectors of ``dim`` components; ``need`` vectors surely hold ``k`` others."""
    spark = rows.sparkSession
    # The smallest hashes make the sample, however rows are partitioned; the filter keeps the sort small.
    share, h = min(1.0, 1.05 * sample / n + 100 / n), F.xxhash64("vec_id", F.lit(seed))
    drawn = rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.orderBy(F.pmod(h, F.lit(1 << 30)), "vec_id", F.xxhash64("embedding")).limit(sample).select("embedding").toPandas()
    x = np.stack(drawn["embedding"].to_numpy()).astype(np.float64) if len(drawn) else np.zeros((0, dim))
    x = x[np.lexsort(x.T[::-1])]  # the order in which rows arrive must not matter
    np.random.default_rng(seed).shuffle(x)
    forest = grow(x, trees, leaves, seed=seed)
    forest.probes = tune(forest, x, k, recall)
    shared = spark.sparkContext.broadcast(forest)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            if batch.num_rows:
                where = f.file(as_matrix(batch.column(1), dim))
                for t in range(where.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(where[:, t]), batch.column(0), batch.column(1)], ["leaf", "vec_id", "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    filed = rows.mapInArrow(file, f"leaf int, vec_id long, embedding {kind}")
    # One count a leaf; the leaves are bounded by the sample, whatever the table's size.
    held = [0] * forest.leaves
    for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r.leaf] = r.n

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            if batch.num_rows:
                opened = [f.search(q, f.probes, held, need) for q in as_matrix(batch.column(1), dim)]
                at = pa.array(np.repeat(np.arange(len(opened)), [len(x) for x in opened]))
                flat = pa.array(np.concatenate(opened).astype(np.int32))
                yield pa.RecordBatch.from_arrays([flat, batch.column(0).take(at), batch.column(1).take(at)], ["leaf", "query_id", "query"])

    asked = rows.where(F.col("vec_id") % every == 0).repartition(spark.sparkContext.defaultParallelism).mapInArrow(ask, f"leaf int, query_id long, query {kind}")
    asked = scratch.keep(asked, "asked")
    opened = {r.leaf: r.n for r in asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}

    def pieces(counts: dict[int, int]) -> Column:
        """Into how many parts a leaf is dealt."""
        many = [(leaf, -(-c // part)) for leaf, c in counts.items() if c > part]
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in many for v in pair]), F.col("leaf")), F.lit(1)) if many else F.lit(1)

    # Every part of a leaf's vectors meets every part of the queries that open it once.
    parts, turns = pieces(dict(enumerate(held))), pieces(opened)
    every_of = lambda p: F.explode(F.sequence(F.lit(0), p.cast("int") - 1))
    filed = filed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("turn", every_of(turns))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), turns).cast("int")).withColumn("part", every_of(parts))
    keys = ["leaf", "part", "turn"]
    found = filed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_rank_leaf(k), "query_id long, vec_id long, score double")
    return scratch.keep(found, "found")
