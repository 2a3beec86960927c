"""Ranks and exact order statistics of whole tables, by ranges of the order instead of one sort or one buffer.

``repartitionByRange`` deals rows to ranges of all order columns together and
each task sorts its own; a row's place is its place in the range plus the rows
of the ranges before. The ranges are written to the shared folder first: the
places are then fixed, whatever is computed again later, and the counts of the
ranges are read from what was written.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specgrid.sources.io import work_dir

#: A task's number and a row's place in it share a long, 33 bits are the place's.
_PLACE_BITS = 33
#: Rank error of the sketch that brackets a quantile is 1 / SKETCH.
SKETCH = 1000
#: Tables up to here need no bracket.
SMALL = 100_000


def ranged(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``order``, with range ``_part`` and place ``_local`` in it, both from 0; nulls come first."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(*([parts] if parts else []), *[F.col(c) for c in order]).sortWithinPartitions(*order)
    at = dealt.withColumn("_at", F.monotonically_increasing_id())
    out = at.withColumns({"_part": F.shiftright("_at", _PLACE_BITS).cast("int"), "_local": F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("_at")
    path = work_dir(spark, "ranged")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def global_rank(df: DataFrame, *order: str, name: str = "rank", total: str | None = None, parts: int | None = None) -> DataFrame:
    """1, 2, ... in the order of ``order``, without a sort in one task (W8); ``total`` names a column for the number of rows.

    Rows that are equal in all of ``order`` are ranked in some order that stays
    the same. Beside the data there is one row a range.
    """
    dealt = ranged(df, *order, parts=parts)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = [F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total)] if total else []
    shift = F.broadcast(counts.select("_part", before.alias("_before"), *every))  # one row a range
    return dealt.join(shift, "_part").withColumn(name, F.col("_local") + F.col("_before") + 1).drop("_part", "_local", "_before")


def rank_within(df: DataFrame, group: str, *order: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """1, 2, ... in each group in the order of ``order``, though a group may hold most of the rows.

    A large group spans many ranges; beside the data there is one row for each
    range and group in it.
    """
    dealt = ranged(df, group, *order, parts=parts)
    own = dealt.groupBy("_part", F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    past = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = own.select(F.col("_part").alias("_at"), "_group", (F.coalesce(F.sum("_n").over(past), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = dealt.join(shift, (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn(name, F.col("_local") + F.col("_shift") + 1).drop("_part", "_local", "_at", "_group", "_shift")


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _at_ranks(df: DataFrame, col: str, ranks: list[int], brackets: list[tuple[float, float]] | None) -> dict[int, float] | None:
    """Values at ranks (from 0), counting equal values inside ``brackets`` and all other rows by the gap they lie in; None if a rank lies in a gap."""
    v = F.col(col).cast("double")
    seg = F.lit(1)
    if brackets is not None:
        seg = sum((F.when(v > hi, 2).when(v >= lo, 1).otherwise(0) for lo, hi in brackets), F.lit(0))
    inside = df.where(v.isNotNull()).select(seg.alias("seg"), v.alias("v"))
    kept = inside.groupBy("seg", F.when(F.col("seg") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = ranged(kept, "seg", "v")
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0))
    whole = dealt.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = dealt.withColumn("upto", upto).join(F.broadcast(whole.select("_part", before.alias("_before"))), "_part")
    told = told.select("seg", "v", (F.col("upto") + F.col("_before")).alias("end"), "n")
    hit = F.lit(False)
    for k in ranks:
        hit = hit | ((F.col("end") > k) & (F.col("end") - F.col("n") <= k))
    rows = told.where(hit).collect()  # at most one row a rank
    found = {k: r for k in ranks for r in rows if r.end - r.n <= k < r.end}
    if any(found[k].seg % 2 == 0 for k in ranks):
        return None
    return {k: found[k].v for k in ranks}


def bracket_shares(shares: Sequence[float]) -> list[float]:
    """Shares on both sides of each wanted one, farther away than the sketch may err."""
    room = 3 / SKETCH
    return [x for q in shares for x in (max(q - room, 0.0), min(q + room, 1.0))]


def quantiles(df: DataFrame, col: str, shares: Sequence[float], n: int, sketch: Sequence[float] | None = None) -> list[float | None]:
    """Exact quantiles of the ``n`` values of ``col`` that are not null, between neighbours in proportion.

    ``sketch`` are approximate quantiles at ``bracket_shares``. One pass counts the
    values between each pair, about 0.6 % of the rows for each share and equal ones
    together, and how many rows lie below, between and above; the wanted ranks are
    then looked up among those counts, dealt over ranges. Should the sketch have
    missed a rank, all values are counted. No task holds more than its range.
    """
    if not n:
        return [None for _ in shares]
    at = [q * (n - 1) for q in shares]
    ranks = sorted({k for p in at for k in (math.floor(p), math.ceil(p))})
    brackets = _merged(list(zip(sketch[::2], sketch[1::2], strict=True))) if sketch and n > SMALL else None
    found = _at_ranks(df, col, ranks, brackets)
    if found is None:
        found = _at_ranks(df, col, ranks, None)
    out = []
    for p in at:
        lo, hi = found[math.floor(p)], found[math.ceil(p)]
        out.append(lo if lo == hi else lo + (hi - lo) * (p - math.floor(p)))
    return out
