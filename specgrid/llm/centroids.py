"""Centroid clustering on an integer grid with a table of pivot distances (LAESA).

Each vector becomes integers ``floor(scale * x)``. Its distances to a few fixed
pivots are taken once and stored beside it. In every round the pivots' distances
to the centroids are new, but those are few; ``|d(v, p) - d(c, p)|`` bounds
``d(v, c)`` from below for each pivot ``p``, so only centroids whose bound does
not exceed the best distance so far get their exact squared distance, in whole
numbers. A bound is lowered by more than its rounding error, so no centroid is
left out that could win or tie.

A round is one job: tasks read the table, assign and add up by cluster, and hand
on one row for each cluster and component they met. What the driver holds is the
centroids: ``k`` rows of ``dim`` whole numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch, ship
from specgrid.llm.vectors import as_matrix, own_type

#: Rows with the smallest hashes among which pivots are picked, and pivots.
POOL, PIVOTS = 256, 8
#: Components up to here are squared and added as 64-bit numbers, others as Python's.
_SMALL = 1 << 24
#: Sums travel in digits of this base.
_DIGIT = 40
_MOST = (1 << 63) - 1


def on_grid(x: float, scale: int) -> int:
    """``floor(scale * x)``, exact where the product would overflow."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def _small(points: list[list[int]]) -> np.ndarray:
    return np.array([max(map(abs, p), default=0) <= _SMALL for p in points], dtype=bool)


def exact(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


class Nearest:
    """Exact nearest centroids of vectors whose pivot distances are known."""

    def __init__(self, centroids: list[list[int]], pivots: list[list[int]]):
        self.centroids = centroids
        fits = _small(centroids)
        self.plain, self.huge = np.flatnonzero(fits).tolist(), np.flatnonzero(~fits).tolist()
        self.grid = {j: np.array(centroids[j], dtype=np.int64) for j in self.plain}
        root = lambda d: math.sqrt(d) if d.bit_length() < 1000 else math.nan
        self.to_pivots = np.array([[root(exact(c, p)) for p in pivots] for c in centroids]).reshape(len(centroids), len(pivots))
        self.tried = 0

    def bounds(self, held: np.ndarray) -> np.ndarray:
        """Squared lower bounds of all distances, from pivot distances (not a number: unknown)."""
        gap = np.zeros((len(held), len(self.centroids)))
        for p in range(held.shape[1]):
            d, c = held[:, p, None], self.to_pivots[None, :, p]
            near = np.abs(d - c) - 1e-9 * (d + c + 1)
            np.fmax(gap, near, out=gap)
        return gap * gap

    def of_small(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Clusters and squared distances of small vectors; distance -1 where only a huge centroid was there."""
        bound = self.bounds(held)
        best = np.full(len(x), _MOST, dtype=np.int64)
        cluster = np.full(len(x), len(self.centroids), dtype=np.int32)
        if not self.plain:
            return cluster, np.full(len(x), -1, dtype=np.int64)
        first = np.array(self.plain)[bound[:, self.plain].argmin(axis=1)]
        for at_first in (True, False):
            for j in self.plain:
                open_ = first == j if at_first else (first != j) & (bound[:, j] <= best)
                rows = np.flatnonzero(open_)
                if not len(rows):
                    continue
                self.tried += len(rows)
                diff = x[rows] - self.grid[j]
                d = (diff * diff).sum(axis=1)
                won = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
                best[rows[won]], cluster[rows[won]] = d[won], j
        for j in self.huge:  # far away nearly always: seen in floating point first
            c = np.array([float(v) if v.bit_length() < 500 else math.inf for v in self.centroids[j]])
            rough = ((x - c) ** 2).sum(axis=1) * (1 - 1e-9)
            for i in np.flatnonzero(rough <= best):
                d = exact(x[i].tolist(), self.centroids[j])
                if d < best[i] or (d == best[i] and j < cluster[i]):
                    best[i], cluster[i] = d, j
        return cluster, best

    def of_any(self, v: list[int]) -> tuple[int, int]:
        return min(((j, exact(v, c)) for j, c in enumerate(self.centroids)), key=lambda t: (t[1], t[0]))


def _parts(batch: pa.RecordBatch, scale: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
    """Small vectors on the grid, their places in the batch, the doubles, and the other vectors."""
    x = as_matrix(batch.column("embedding"), dim)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    fits = (np.abs(y) <= _SMALL).all(axis=1)
    odd = [(int(i), [on_grid(v, scale) for v in x[i].tolist()]) for i in np.flatnonzero(~fits)]
    return y[fits].astype(np.int64), np.flatnonzero(fits), x, odd


def _measure(pivots: list[list[int]], scale: int, dim: int):
    """Adds the distances to the pivots (not a number for vectors that are not small)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, at, x, _ = _parts(batch, scale, dim)
            held = np.full((len(x), len(pivots)), np.nan)
            for p, pivot in enumerate(pivots):
                if max(map(abs, pivot), default=0) <= _SMALL:
                    diff = y - np.array(pivot, dtype=np.int64)
                    held[at, p] = np.sqrt((diff * diff).sum(axis=1).astype(np.float64))
            flat = pa.array(held.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, len(pivots), dtype=np.int32)), flat) if pivots else pa.array([[]] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "held"])

    return run


def _assigned(batch: pa.RecordBatch, near: Nearest, scale: int, dim: int) -> tuple[np.ndarray, list[int | None], np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
    y, at, x, odd = _parts(batch, scale, dim)
    n_pivots = near.to_pivots.shape[1]
    held = as_matrix(batch.column("held"), n_pivots) if n_pivots else np.zeros((len(x), 0))
    cluster, distance = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=object)
    cluster[at], distance[at] = near.of_small(y, held[at])
    for i, j in enumerate(at[distance[at] == -1].tolist() if len(at) else []):
        cluster[j], distance[j] = near.of_any(y[np.searchsorted(at, j)].tolist())
    for i, v in odd:
        cluster[i], distance[i] = near.of_any(v)
    return cluster, distance, y, at, odd


def digits(total: int) -> list[int]:
    """``total`` in base ``2 ** 40``, lowest digit first, all with its sign."""
    sign, rest, out = (-1 if total < 0 else 1), abs(total), []
    while rest:
        out.append(sign * (rest & ((1 << _DIGIT) - 1)))
        rest >>= _DIGIT
    return out


def _sums(near: Nearest, scale: int, dim: int):
    """One task's ``(cluster, place, digit, total)``; place -1 holds the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(near.centroids)
        count, plain, rest = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=object), {}
        for batch in batches:
            cluster, _, y, at, odd = _assigned(batch, near, scale, dim)
            count += np.bincount(cluster, minlength=k)
            own = cluster[at]
            for j in np.unique(own).tolist():
                plain[j] += y[own == j].sum(axis=0).astype(object)
            for i, v in odd:
                rest[int(cluster[i])] = [a + b for a, b in zip(rest.get(int(cluster[i]), [0] * dim), v, strict=True)]
        for j, v in rest.items():
            plain[j] += np.array(v, dtype=object)
        out = [(j, -1, 0, int(n)) for j, n in enumerate(count) if n]
        out += [(j, i, d, v) for j in range(k) for i in range(dim) for d, v in enumerate(digits(int(plain[j, i])))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "place", "digit", "total"])

    return run


def _tell(near: Nearest, scale: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, *_ = _assigned(batch, near, scale, dim)
            told = pa.array([int(d) if d <= _MOST else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), told], ["vec_id", "cluster", "distance"])

    return run


def spread_out(pool: list[list[int]], n: int) -> list[list[int]]:
    """Up to ``n`` different points of ``pool``, each the farthest from those before it."""
    chosen: list[list[int]] = []
    gap: list[int] = []
    for _ in range(min(n, len(pool))):
        at = max(range(len(pool)), key=lambda i: (gap[i], -i)) if chosen else 0
        if chosen and not gap[at]:
            break
        chosen.append(pool[at])
        far = [exact(p, pool[at]) for p in pool]
        gap = [min(a, b) for a, b in zip(gap, far, strict=True)] if gap else far
    return chosen


def next_centroids(centroids: list[list[int]], sums: list[Row]) -> list[list[int]]:
    """Componentwise floor of sum over count; a centroid without vectors stays."""
    count = {r.cluster: r.total for r in sums if r.place < 0}
    totals: dict[tuple[int, int], int] = {}
    for r in sums:
        if r.place >= 0:
            totals[r.cluster, r.place] = totals.get((r.cluster, r.place), 0) + (int(r.total) << (_DIGIT * r.digit))
    return [[totals.get((j, i), 0) // int(count[j]) for i in range(len(c))] if j in count else c for j, c in enumerate(centroids)]


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, pivots: int = PIVOTS, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector, and the final centroids.

    Vectors with exactly ``dim`` components, none of them null or non-finite, are
    kept; others are left out. The first centroids are the ``k`` kept vectors with
    the smallest sha256 of ``<seed>:<vec_id>``, all of them if there are fewer; rows
    that share an id follow the order of their components, a null id comes last.
    Every kept row counts, repeated ones too. Equal distances go to the smaller
    number, a centroid that loses all its vectors stays where it is. ``distance``
    is the squared distance in whole numbers, of any size while it is compared; a
    distance, and a sum, that no long can hold is told as null. Extra columns are
    ignored, an empty table gives an empty result and no centroids.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "centroids")
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), own_type(vectors, "embedding"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(F.coalesce((F.size(x) == dim) & fine, F.lit(False)))

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    pool = kept.orderBy(order.asc_nulls_last(), "embedding").limit(max(k, POOL)).collect()  # bounded
    grid = [[on_grid(v, scale) for v in r.embedding] for r in pool]
    centroids, fixed = grid[:k], spread_out(grid, pivots)

    kind = kept.schema["embedding"].dataType.simpleString()
    table = scratch.keep(kept.mapInArrow(_measure(fixed, scale, dim), f"vec_id long, embedding {kind}, held array<double>"), "table")
    for _ in range(rounds):
        parts = table.mapInArrow(_sums(Nearest(centroids, fixed), scale, dim), "cluster int, place int, digit int, total long")
        sums = parts.groupBy("cluster", "place", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        centroids = next_centroids(centroids, sums.collect())  # a row a centroid and component

    told = scratch.keep(table.mapInArrow(_tell(Nearest(centroids, fixed), scale, dim), "vec_id long, cluster int, distance long"), "told")
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = {r.cluster: r.total for r in told.groupBy("cluster").agg(whole.alias("total")).collect()}  # a row a centroid
    as_long = lambda v: F.lit(int(v) if v is not None and v <= _MOST else None).cast("long")
    inertia = None if None in by.values() else sum(by.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    out = told.select(
        "vec_id", "cluster", "distance", pick([as_long(by.get(j, 0)) for j in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        as_long(inertia).alias("inertia"), pick([F.lit(n) for n in names]).cast("string").alias("centroid_sha256"),
    )
    return out, centroids
