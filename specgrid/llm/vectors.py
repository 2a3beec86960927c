"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine ``c`` or more lie within squared distance ``2 - 2c``.
After a random rotation the coordinates are split into blocks; a pair within the
budget must, in one block at least, lie within that block's share of it (in
proportion to its dimensions). Each block is range-joined on its own: a grid
over its first two coordinates, as wide as the block's radius, brings together
what can be near, the whole block's distance sifts, and the union over blocks is
confirmed by cosine on the original vectors in double precision.

Equal vectors are merged first. A grid cell with many vectors, at home or come
as visitors from the cells around, is dealt over parts: each two parts of those
at home meet in a group of their own, and so does each of them with each part of
the visitors. A group holds two parts at most and no pair is lost or met twice.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch, grouped, ship
from specgrid.llm.components import connected_components

BLOCK = 8
#: Vectors of one grid cell that a task compares with each other; larger cells are dealt over parts.
CELL = 2000
_CELL = ["label", "dim", "block", "cx", "cy"]
#: ``other`` below 0 is a part of the visitors; those at home then meet only them.
_KEY = [*_CELL, "part", "other"]


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and all finite numbers."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def own_type(vectors: DataFrame, column: str) -> Column:
    """The vectors as they are, if single or double precision, else as doubles."""
    kind = vectors.schema[column].dataType.elementType.typeName() if vectors.schema[column].dataType.typeName() == "array" else ""
    return F.col(column).cast(f"array<{kind if kind in ('float', 'double') else 'double'}>").alias(column)


@functools.lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, dim)) for a in range(0, dim, width)]


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _place(cosine: float, width: int, seed: int):
    """Rows ``(key, role, id, point)``: each vector at home in its cell of every block, and as a visitor in half of the cells around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                x = as_matrix(rows.column("embedding"), int(dim))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x = x @ rotation(int(dim), seed)
                ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
                for b, (lo, hi) in enumerate(blocks_of(int(dim), width)):
                    part = x[:, lo:hi]
                    side = np.sqrt(budget(cosine, hi - lo, int(dim)))
                    cx = np.floor(part[:, 0] / side).astype(np.int32)
                    cy = np.floor(part[:, 1] / side).astype(np.int32) if hi - lo > 1 else np.zeros(len(part), np.int32)
                    points = pa.FixedSizeListArray.from_arrays(pa.array(part.astype(np.float32).ravel()), hi - lo).cast(pa.list_(pa.float32()))
                    for role, dx, dy in ((0, 0, 0), (1, 0, 1), (1, 1, -1), (1, 1, 0), (1, 1, 1)):
                        n = len(ids)
                        const = lambda v: pa.array(np.full(n, v, dtype=np.int32))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(labels), const(dim), const(b), pa.array(cx + np.int32(dx)), pa.array(cy + np.int32(dy)), const(0), const(0), const(role), pa.array(ids), points],
                            [*_KEY, "role", "id", "point"],
                        )

    return run


def budget(cosine: float, width: int, dim: int) -> float:
    """A block's share of the squared distance, with room for rounding to single precision."""
    return (2 - 2 * cosine) * width / dim * (1 + 1e-4) + 1e-7


def _meet(cosine: float, width: int):
    """Pairs within a block's budget, from rows sorted by cell and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, _KEY):
            home = len(group) - int(group.column("role").to_numpy().sum())
            if not home or len(group) == 1:
                continue
            alone = group.column("other")[0].as_py() < 0
            dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
            lo, hi = blocks_of(dim, width)[block]
            limit = budget(cosine, hi - lo, dim)
            points, ids = as_matrix(group.column("point"), hi - lo), group.column("id").to_numpy()
            norms = (points**2).sum(axis=1)
            for at in range(home if alone else 0, len(ids), 1024):
                end = min(at + 1024, len(ids))
                i, j = np.nonzero(norms[at:end, None] + norms[None, :home] - 2 * points[at:end] @ points[:home].T <= limit)
                i += at
                good = (i >= home) | (j < i)
                a, b = ids[i[good]], ids[j[good]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _cosines(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            good = []
            ea, eb = batch.column("ea"), batch.column("eb")
            sizes = ea.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x, y = as_matrix(ea.take(pa.array(at)), int(dim)), as_matrix(eb.take(pa.array(at)), int(dim))
                c = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                good.append(at[c >= cosine])
            yield batch.select(["a", "b"]).take(pa.array(np.sort(np.concatenate(good))))

    return run


def in_parts(placed: DataFrame, cell: int, scratch: Scratch) -> DataFrame:
    """Rows of cells with more than ``cell`` vectors at home, or as many visitors, once for each group of two parts that they belong to."""
    home = F.col("role") == 0
    full = placed.groupBy(*_CELL).agg(F.count_if(home).alias("n"), F.count_if(~home).alias("m")).where((F.col("n") > cell) | (F.col("m") > cell))
    pieces = lambda c: F.greatest(F.ceil(F.col(c) / cell), F.lit(1)).cast("int")
    full = scratch.keep(full.select(*_CELL, pieces("n").alias("parts"), pieces("m").alias("guests")), "full")
    if full.isEmpty():
        return placed
    own = F.pmod(F.xxhash64("id"), F.when(home, F.col("parts")).otherwise(F.col("guests"))).cast("int")
    group = lambda part, other, role: F.struct(part.cast("int").alias("part"), other.cast("int").alias("other"), role.cast("int").alias("role"))
    parts, guests = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("guests") - 1)
    # Of two parts at home, the later one comes as visitors.
    at_home = F.transform(parts, lambda j: group(F.least("own", j), F.greatest("own", j), F.when(F.col("own") <= j, 0).otherwise(1)))
    at_home = F.concat(at_home, F.transform(guests, lambda g: group(F.col("own"), -1 - g, F.lit(0))))
    visiting = F.transform(parts, lambda j: group(j, -1 - F.col("own"), F.lit(1)))
    whole = F.array(group(F.lit(0), F.lit(0), F.col("role")))
    spread = placed.join(full, _CELL, "left").withColumn("own", own)
    groups = F.when(F.col("parts").isNull(), whole).when(home, at_home).otherwise(visiting)
    spread = spread.withColumn("group", F.explode(groups)).drop("part", "other", "role")
    return spread.select("*", "group.*").select(*placed.columns)


def near_vectors(vectors: DataFrame, *, cosine: float = 0.98, width: int = BLOCK, cell: int = CELL, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector of ``vectors(vec_id, embedding, label)``.

    Two vectors are linked when their labels are equal and not null and their
    cosine is ``cosine`` or more. Vectors that are null, zero, or hold null or
    non-finite components link with nothing, nor do vectors of unlike length
    with each other. Labels of any type are compared as they are, and vectors
    have their own precision. Rows that repeat id, label and vector are one vector; a
    null vec_id is linked with nothing, has no component and is not kept. Extra
    columns are ignored, an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", own_type(vectors, "embedding"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = rows.withColumns({"fit": fit, "h": F.xxhash64("embedding")}).dropDuplicates(["vec_id", "label", "h", "embedding"])
    rows = scratch.keep(rows, "rows")
    same = rows.where("fit").groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    same = scratch.keep(same.withColumn("dim", F.size("embedding")), "same")

    point = "label long, dim int, block int, cx int, cy int, part int, other int, role int, id long, point array<float>"
    placed = scratch.keep(same.select("id", F.xxhash64("label").alias("label"), "dim", "embedding").mapInArrow(_place(cosine, width, seed), point), "placed")
    placed = in_parts(placed, cell, scratch)
    dealt = placed.repartition(*_KEY).sortWithinPartitions(*_KEY, "role")
    pairs = dealt.mapInArrow(_meet(cosine, width), "a long, b long").where("a < b").distinct()
    pairs = scratch.keep(pairs, "pairs")

    named = lambda a, e: same.select(F.col("id").alias(a), F.col("embedding").alias(e), F.col("label").alias(f"l{a}"))
    both = pairs.join(named("a", "ea"), "a").join(named("b", "eb"), "b").where("la = lb").select("a", "b", "ea", "eb")
    links = scratch.keep(both.mapInArrow(_cosines(cosine), "a long, b long"), "links")

    ends = links.union(links.select("b", "a"))
    others = ends.join(same.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    names = connected_components(links, scratch)
    told = same.join(others, same["id"] == others["a"], "left").join(names, same["id"] == names["node"], "left")
    told = told.select("label", "h", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    told = scratch.keep(told, "told")
    out = rows.withColumn("label", F.when(F.col("fit"), F.col("label"))).join(told, ["label", "h", "embedding"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
