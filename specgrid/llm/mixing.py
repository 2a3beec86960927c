"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, its source's
target over its source's size. The whole part is taken as it is; the fractions
are rounded by a pivotal walk from the longest document to the shortest: a document
goes to 0 or 1 at once and trades its probability mass, weighted by words, with as
many of the next ones as can bear it; where those are too few, two trade at a time
until one of them holds 0 or 1. Words are conserved at each step, each document's
probability in expectation, and what stays fractional is one of the shortest.

Rows of a source are dealt over groups of bounded size by a hash; each group
ends with at most one fraction, these residuals meet in groups again, and so on:
a reduction tree whose last fraction is rounded to the nearer side. Documents too
long for a group to bear are rounded in a tree of their own before; the words won
or lost there are spread over the rest of the source. In a source of one group, a
document that all others together cannot make up for goes to the side that they
can, as being near the target counts for more than its own chance. Rows equal in all columns
are counted first and hold one fraction together, however many they are. All draws
depend on hashes of ids and a seed alone, so reruns agree however rows are partitioned.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.llm.common import WORD_PATTERN, Scratch, ship

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # 150 % of all words
CEILING = 2  # times a source's own words
#: Rows that one group of the reduction tree rounds together, about.
FAN_IN = 1000
#: A document with more words than such a part of an average group goes first, with others like it.
LONG_PART = 16
#: Equal rows that one task writes out in a row.
_CHUNK = 4096
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``source, source_size, n, target`` from rows ``(source, size)``; a row may stand for several (``size`` is then their sum).

    Sources by code point, null last, take the weights in turn. Targets share
    ``share`` of all words by weight; what lies above ``ceiling`` times a
    source's size is dealt again by weight until none is above. The windows run
    over one row a source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = (F.col("source_size") * ceiling).cast("double")
    per = per.withColumns({"cap": cap, "ratio": cap / F.col("w")})
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * share[0] / share[1]
    # Level that the sources from here on would get if all before them stood at their ceiling.
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    shared = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(shared * F.col("w"), F.col("cap")))
    return per.select("source", "source_size", "n", target.alias("target"))


def _pairs(p: np.ndarray, weight: np.ndarray, draws: np.ndarray, start: int) -> int:
    """Rounds the fractions of ``p`` from ``start`` on in pairs; the index of the one left over, -1 if none."""
    held = -1
    for j in range(start, len(p)):
        b = p[j]
        if b <= _EPS or b >= 1 - _EPS:
            p[j] = round(b)
            continue
        if held < 0:
            held = j
            continue
        a, wa, wb = p[held], weight[held], weight[j]
        up = min((1 - a) * wa, b * wb)  # mass that can go to the held one
        down = min(a * wa, (1 - b) * wb)
        move = up if draws[j] * (up + down) < down else -down
        a, b = a + move / wa, b - move / wb
        p[held], p[j] = a, b
        for k in (held, j):
            if p[k] <= _EPS or p[k] >= 1 - _EPS:
                p[k] = round(p[k])
        free = [k for k in (held, j) if 0 < p[k] < 1]
        held = free[0] if free else -1
    return held


def pivot(p: np.ndarray, weight: np.ndarray, draws: np.ndarray, near: bool = False) -> int:
    """Rounds the fractions ``p`` in place, heaviest first; the index of the one left over, -1 if none.

    The first one goes up or down for good; the next ones share the mass that it
    gives or takes, each in proportion to what it can bear both ways. With ``near``,
    one that all others together could not make up for goes to the side that they can.
    """
    n = len(p)
    for j in range(n):
        a, wa = p[j], weight[j]
        if a <= _EPS or a >= 1 - _EPS:
            p[j] = round(a)
            continue
        ahead = 32
        while True:
            to = min(n, j + 1 + ahead)
            b, w = p[j + 1 : to], weight[j + 1 : to]
            room = w * np.minimum(b / (1 - a), (1 - b) / a)
            total = np.cumsum(room)
            k = int(np.searchsorted(total, wa)) + 1
            if k <= len(total):
                break
            if to == n:
                k = 0
                break
            ahead *= 4
        if not k:
            takes, gives = (b * w).sum() >= (1 - a) * wa, ((1 - b) * w).sum() >= a * wa
            if not near or not (takes or gives):
                return _pairs(p, weight, draws, j)
            up = takes and (draws[j] < a or not gives)
            b = b - b * (1 - a) * wa / (b * w).sum() if up else b + (1 - b) * a * wa / ((1 - b) * w).sum()
            b[b <= _EPS], b[b >= 1 - _EPS] = 0, 1
            p[j + 1 :] = b
            p[j] = float(up)
            continue
        up = draws[j] < a
        b = b[:k] + (-(1 - a) if up else a) * wa * room[:k] / total[k - 1] / w[:k]
        b[b <= _EPS], b[b >= 1 - _EPS] = 0, 1
        p[j + 1 : j + 1 + k] = b
        p[j] = float(up)
    return -1


def _round_group(level: int, seed: int, fan_in: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "draw", "row_key"], ascending=[False, True, True], kind="stable", ignore_index=True)
        p = rows["p"].to_numpy(dtype=float).copy()
        name = f"{seed}\0{level}\0{key[0]!r}\0{key[1]}"
        draws = np.random.default_rng(xxhash.xxh3_64_intdigest(name)).random(len(p))
        whole = level == 0 and len(p) > 0 and bool(rows["n"].iloc[0] <= fan_in)  # all of a small source
        left = pivot(p, rows["size"].to_numpy(dtype=float), draws, near=whole)
        rows["p"] = p
        rows["open"] = np.arange(len(p)) == left
        return rows

    return run


def _tree(rows: DataFrame, groups: Column, scratch: Scratch, name: str, *, seed: int, fan_in: int) -> DataFrame:
    """``rows`` with ``p`` rounded to 0 or 1 but for one row a source, the only one that is ``open``."""
    deal = lambda level: F.xxhash64(F.col("doc_id"), F.col("text_hash"), F.lit(seed), F.lit(level))
    rows = rows.withColumns({"part": F.pmod(deal(0), groups).cast("long"), "open": F.lit(True)})
    schema = rows.schema
    done: list[DataFrame] = []
    level = 0
    while True:
        rounded = scratch.keep(rows.groupBy("source", "part").applyInPandas(_round_group(level, seed, fan_in), schema), f"{name}{level}")
        rest = rounded.where("open")
        level += 1
        widest = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if widest <= 1:
            done.append(rounded)
            break
        done.append(rounded.where("NOT open"))
        parts = max(1, -(-widest // fan_in))
        rows = rest.withColumn("part", F.pmod(deal(level), F.lit(parts)).cast("long")).select(*schema.names)
    return functools.reduce(DataFrame.unionByName, done).drop("part")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    ceiling: int = CEILING,
    seed: int = 17,
    fan_in: int = FAN_IN,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs(doc_id, text, source)``.

    ``size`` counts words (a null text has 0, a text of any length is counted whole),
    ``copies`` is how often the mix takes the row, ``taken = copies * size``. A
    document without words is never taken. Null is a source of its own, the last
    one. Rows that repeat a doc_id count each; equal rows may be swapped. Columns
    named in ``keep`` are carried along, others are ignored. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mix")
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), *keep)
    sized = scratch.keep(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("m")), "sized")
    targets = scratch.keep(source_targets(sized.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, ceiling), "targets")

    same = sized["source"].eqNullSafe(targets["source"])
    rows = sized.join(targets, same).select(sized["*"], "source_size", "target", "n")
    rate = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumns(
        {
            "rate": rate,
            "base": F.floor(rate).cast("int"),
            "draw": F.xxhash64(F.col("doc_id"), F.col("text_hash"), F.lit(seed), F.lit(-1)),
            "row_key": F.coalesce(F.col("doc_id"), F.lit(-1)),
            "long": F.col("size") * F.col("n") * LONG_PART > F.col("source_size") * fan_in,
        }
    )
    rows = _fractions(rows)
    groups = F.greatest(F.ceil(F.col("n") / fan_in), F.lit(1))
    free = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    done = []
    if not rows.where(free & F.col("long")).isEmpty():
        few = F.greatest(F.ceil(F.col("n") * LONG_PART / fan_in / fan_in), F.lit(1))  # no more than n * LONG_PART / fan_in rows are long
        told = _tree(rows.where(free & F.col("long")), few, scratch, "long", seed=seed, fan_in=fan_in)
        chance = F.pmod("draw", F.lit(1 << 30)) / (1 << 30)
        told = scratch.keep(told.withColumns({"was": F.col("p"), "p": F.when(~F.col("open"), F.col("p")).otherwise((chance < F.col("p")).cast("double"))}), "long")
        won = told.groupBy("source").agg(F.sum((F.col("m") * (F.col("rate") - F.col("base")) - F.col("lift") - F.col("p")) * F.col("size")).alias("lost"))
        bear = rows.where("NOT long AND size > 0").groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("bearing"))
        won = won.withColumnRenamed("source", "at")
        won = scratch.keep(won.join(bear, won["at"].eqNullSafe(bear["source"])).select("at", (F.col("lost") / F.col("bearing")).alias("shift")), "shift")
        moved = F.col("rate") + F.coalesce(F.col("shift"), F.lit(0.0))
        moved = F.least(F.greatest(moved, F.col("base")), F.col("base") + 1).cast("double")
        moved = F.when(F.col("long") | (F.col("size") == 0), F.col("rate")).otherwise(moved)
        done.append(told.drop("was"))
        rows = rows.where(~(free & F.col("long")))
        rows = _fractions(rows.join(won, rows["source"].eqNullSafe(won["at"]), "left").withColumn("rate", moved).drop("at", "shift"))
    done.append(rows.where(~free).withColumn("open", F.lit(False)))
    done.append(_tree(rows.where(free), groups, scratch, "level", seed=seed, fan_in=fan_in))
    out = functools.reduce(DataFrame.unionByName, done)

    lifted = F.col("lift") + F.round("p").cast("long")  # of the m equal rows, so many have a copy more
    out = out.withColumn("lifted", lifted)
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / _CHUNK)))
    many = out.where(F.col("m") > _CHUNK).withColumn("run", runs).repartition("doc_id", "text_hash", "run")
    out = out.where(F.col("m") <= _CHUNK).withColumn("run", F.lit(0).cast("long")).unionByName(many)
    here = F.least(F.col("m") - F.col("run") * _CHUNK, F.lit(_CHUNK)) - 1
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), here)))
    copies = (F.col("base") + (F.col("i") + F.col("run") * _CHUNK < F.col("lifted")).cast("int")).cast("int")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def _fractions(rows: DataFrame) -> DataFrame:
    """``lift``, how many of the ``m`` equal rows surely have a copy over ``base``, and ``p``, the fraction of one more."""
    over = F.col("m") * (F.col("rate") - F.col("base"))
    lift = F.floor(over + F.lit(_EPS))
    return rows.withColumns({"lift": lift.cast("long"), "p": F.greatest(over - lift, F.lit(0.0))})
