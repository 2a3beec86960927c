"""Connected components of an edge table by contraction.

Each round every node hooks onto the smallest of its neighbours and itself, all
edges move to the hooks, and edges inside one node vanish. Odd rounds compare
ids as they are, which folds a star onto its smallest member at once; the other
rounds compare them under a fresh random order, so that a constant share of the
nodes goes and the rounds grow with the logarithm of the longest path. Every
step is a join or an aggregate with map-side combine; tables of each round are
written to the shared folder, so that lineage stays short and a lost executor
costs one task.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """``(node, component)`` for every id in ``edges`` (long columns ``a``, ``b``), as a written table.

    ``component`` is the smallest id reachable. Repeated edges are harmless;
    self-loops and rows with a null end are left out, and an id that stands in
    no other edge is not listed; an empty table gives an empty result. ``edges``
    is read several times and should be a written table.
    """
    rnd = random.Random(seed)
    live = edges.select("a", "b").where("a <> b")
    hooks: list[DataFrame] = []
    most = 0
    while n := live.count():
        most = most or n
        mask = F.lit(rnd.getrandbits(62) if len(hooks) % 2 else 0).cast("long")
        both = live.union(live.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        up = F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask)
        hook = scratch.keep(least.select(F.col("a").alias("node"), up.alias("up")), "hook", 2 * n)
        hooks.append(hook)
        moved = live.join(hook.select(F.col("node").alias("a"), F.col("up").alias("a2")), "a").select("a2", "b")
        moved = moved.join(hook.select(F.col("node").alias("b"), F.col("up").alias("b2")), "b")
        stale, live = live, scratch.keep(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "moved", n)
        if len(hooks) > 1:  # the first table is the caller's
            scratch.drop(stale)
    if not hooks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = hooks[-1]
    for hook in reversed(hooks[:-1]):
        upper = roots.select(F.col("node").alias("up"), F.col("up").alias("top"))
        roots = hook.join(upper, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    if len(hooks) > 1:
        roots = scratch.keep(roots, "roots", 2 * most)
    names = roots.groupBy("up").agg(F.min("node").alias("component"))
    out = scratch.keep(roots.join(names, "up").select("node", "component"), "names", 2 * most)
    scratch.drop(live, roots, *hooks)
    return out
