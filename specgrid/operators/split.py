"""Splits, folds and leakage checks over site tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.operators.inventory import seeded
from specgrid.operators.order import global_rank, rank_within


def _ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with the rank of each row's seeded digest and the number of rows."""
    return global_rank(df.withColumn("_md5", seeded(F.col(key), seed)), "_md5", key, name="_rank", total="_n").drop("_md5")


def split(df: DataFrame, key: str, test_size: float, seed: int = 42) -> DataFrame:
    """Hold-out split of exactly ``ceil(n * test_size)`` validation rows, the same in every run (M1)."""
    ranked = _ranked(df, key, seed)
    held = F.col("_rank") <= F.ceil(F.col("_n") * test_size)
    return ranked.withColumn("part", F.when(held, "val").otherwise("train")).drop("_rank", "_n")


def split3(df: DataFrame, key: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """Three parts by two cuts of one order (M2)."""
    ranked = _ranked(df, key, seed)
    a = F.ceil(F.col("_n") * test)
    b = a + F.ceil(F.col("_n") * val)
    part = F.when(F.col("_rank") <= a, "test").when(F.col("_rank") <= b, "val").otherwise("train")
    return ranked.withColumn("part", part).drop("_rank", "_n")


def split_fraction(df: DataFrame, key: str, train: float, data: float, seed: int = 42) -> DataFrame:
    """Train share, of which only the share ``data`` is used; the rest of it is ``unused`` (M3)."""
    ranked = _ranked(df, key, seed)
    b = F.floor(F.col("_n") * train)
    a = F.floor(b * data)
    part = F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= b, "unused").otherwise("val")
    return ranked.withColumn("part", part).drop("_rank", "_n")


def fold_runs(sizes: dict[int, int], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Runs ``(size, first, last, folds)``: groups of one size, by rank from 1, go to ``folds`` in turn.

    ``sizes`` tells how many groups have each size. Dealing groups of one size to
    the lightest fold, the first on ties, fills the folds level by level: fold
    ``f`` takes its groups at loads ``load + j * size``, so all takes are in the
    order of (load div size + j, load mod size, f), and between the levels at
    which a fold joins in, the same folds take turns.
    """
    loads, out = [0] * k, []
    for size in sorted(sizes, reverse=True):
        left, rank = sizes[size], 1
        level, rest = [x // size for x in loads], [x % size for x in loads]
        starts = sorted(set(level))
        for at, until in zip(starts, [*starts[1:], None], strict=True):
            turn = sorted((f for f in range(k) if level[f] <= at), key=lambda f: (rest[f], f))
            n = left if until is None else min(left, (until - at) * len(turn))
            if n:
                out.append((size, rank, rank + n - 1, turn))
            for i, f in enumerate(turn):
                loads[f] += size * (n // len(turn) + (i < n % len(turn)))
            rank, left = rank + n, left - n
    return out


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Whole groups to folds, the largest first (of one size: in their order) to the lightest fold (M4).

    Only the number of groups of each size passes through the driver; which fold
    a group gets follows from its rank among those of its size.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = rank_within(counts, "n", group, name="_rank")
    sizes = {r.n: r["count"] for r in ranked.groupBy("n").count().collect()}
    runs = df.sparkSession.createDataFrame(fold_runs(sizes, k), "n long, first long, last long, turn array<int>")
    dealt = ranked.join(runs, "n").where(F.col("_rank").between(F.col("first"), F.col("last")))
    at = ((F.col("_rank") - F.col("first")) % F.size("turn")).cast("int")
    return df.join(dealt.select(group, F.get("turn", at).alias("fold")), group)


def _by_site(df: DataFrame, group: str, site: str) -> DataFrame:
    """One row a site with its groups and the rows it has in each."""
    pairs = df.where(F.col(group).isNotNull() & F.col(site).isNotNull()).groupBy(group, site).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(site).agg(F.collect_list(F.struct(group, "n")).alias("_own"))  # as long as there are groups


def leave_one_group_out(df: DataFrame, group: str, site: str) -> DataFrame:
    """Fold, training row pairs without the held-out group and without its sites.

    A site's list of groups says which folds may train on it: all others. Rows
    without group or site are left out.
    """
    sites = _by_site(df, group, site)
    every = df.agg(F.collect_set(group)).scalar()
    fold = F.explode(F.array_except(every, F.transform("_own", lambda p: p[group]))).alias("fold")
    return sites.select(site, "_own", fold).select("fold", site, F.explode("_own").alias("p")).select("fold", site, f"p.{group}", "p.n")


def held_out_sizes(df: DataFrame, group: str, site: str) -> DataFrame:
    """``fold, n_sites, n_rows``: pairs of group and site, and rows, that each fold trains on (M5).

    They are all pairs and rows less those of the fold's sites, so nothing is
    listed by fold; a fold that holds every site is not told.
    """
    own = _by_site(df, group, site).select(F.size("_own").cast("long").alias("k"), F.aggregate("_own", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("r"), "_own")
    all_k, all_r = own.agg(F.sum("k")).scalar(), own.agg(F.sum("r")).scalar()
    lost = own.select(F.explode(F.transform("_own", lambda p: p[group])).alias("fold"), "k", "r").groupBy("fold").agg(F.sum("k").alias("k"), F.sum("r").alias("r"))
    out = lost.select("fold", (all_k - F.col("k")).alias("n_sites"), (all_r - F.col("r")).alias("n_rows"))
    return out.where("n_sites > 0")


def leakage_flags(train: DataFrame, val: DataFrame, keys: list[str]) -> DataFrame:
    """Validation rows as ``overlap`` or ``clean`` by keys that training rows share."""
    seen = train.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return val.join(seen, keys, "left").withColumn("leak", F.when(F.col("_seen"), "overlap").otherwise("clean")).drop("_seen")


def fold_zscore(df: DataFrame, fold: str, target: str) -> DataFrame:
    """Target of every fold's rows by mean and population deviation of the other folds' rows (M6).

    The sums of all folds less the fold's own give its training sums, so no row is copied.
    """
    t = F.col(target)
    own = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("s"), F.sum(t * t).alias("q"))
    every = own.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    stats = own.crossJoin(F.broadcast(every)).select(fold, (F.col("all_n") - F.col("n")).alias("m"), (F.col("all_s") - F.col("s")).alias("ms"), (F.col("all_q") - F.col("q")).alias("mq"))
    mean = F.col("ms") / F.col("m")
    std = F.sqrt(F.greatest(F.col("mq") / F.col("m") - mean * mean, F.lit(0.0))) + 1e-6
    stats = stats.select(fold, mean.alias("mean"), std.alias("std"))
    return df.join(stats, fold).withColumn("z", (t - F.col("mean")) / F.col("std"))
