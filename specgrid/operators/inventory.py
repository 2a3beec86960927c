"""Listings of files and granules: differences, unions, audits, first and last ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrid.operators.order import global_rank


def pending(inventory: DataFrame, *stores: DataFrame, key: str = "native_id") -> DataFrame:
    """Ids of the inventory that no store has yet."""
    return inventory.select(key).distinct().join(existing(*stores, key=key), key, "left_anti")


def existing(*stores: DataFrame, key: str = "native_id") -> DataFrame:
    """Ids that any store has."""
    return reduce(DataFrame.unionByName, [s.select(key) for s in stores]).distinct()


def boundary_actions(labeled: DataFrame, other: DataFrame, inventory: DataFrame, key: str = "native_id") -> DataFrame:
    """What to do with each stored file (J6): keep, move, or delete the second copy."""
    a = labeled.select(key).distinct().withColumn("in_a", F.lit(True))
    b = other.select(key).distinct().withColumn("in_b", F.lit(True))
    c = inventory.select(key).distinct().withColumn("wanted", F.lit(True))
    flags = a.join(b, key, "full_outer").join(c, key, "left")
    both, wanted = F.col("in_a") & F.col("in_b"), F.coalesce("wanted", F.lit(False))
    action = (
        F.when(both & wanted, "delete_unlabeled_copy").when(both, "delete_labeled_copy").when(F.col("in_a") & ~wanted, "move_to_unlabeled").when(F.col("in_b") & wanted, "move_to_labeled").otherwise("keep")
    )
    return flags.select(key, action.alias("action"))


def batch_ids(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Ids in order, cut into batches of ``size``."""
    ranked = global_rank(df.select(key).distinct(), key)
    batch = F.floor((F.col("rank") - 1) / size).cast("long")
    return ranked.groupBy(batch.alias("batch")).agg(F.sort_array(F.collect_list(key)).alias("ids"), F.count(F.lit(1)).alias("n"))


def incremental_batch(inventory: DataFrame, done: DataFrame, n: int, key: str = "native_id") -> DataFrame:
    """Next ``n`` ids that are not done, each with the number that remains after this batch (L4)."""
    rest = pending(inventory, done, key=key)
    total = rest.agg(F.count(F.lit(1)).alias("total"))
    return rest.orderBy(key).limit(n).crossJoin(F.broadcast(total)).select(key, F.greatest(F.col("total") - n, F.lit(0)).alias("remaining"))


def union_windows(df: DataFrame, windows: list[tuple[str, str]], ts: str) -> DataFrame:
    """Rows of several date windows, once for each window that holds them."""
    spans = F.array(*[F.struct(F.lit(i).alias("w"), F.to_date(F.lit(a)).alias("a"), F.to_date(F.lit(b)).alias("b")) for i, (a, b) in enumerate(windows)])
    hits = F.filter(spans, lambda s: F.to_date(F.col(ts)).between(s["a"], s["b"]))
    return df.withColumn("window_no", F.explode(F.transform(hits, lambda s: s["w"])))


def storage_audit(listing: DataFrame, size: str) -> DataFrame:
    """Number of files, bytes, mean MB and a readable total."""
    total = listing.agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).cast("long").alias("total_bytes"))
    t = F.col("total_bytes").cast("double")
    text = F.when(t >= 1e9, F.concat(F.round(t / 1e9, 2).cast("string"), F.lit(" GB"))).when(t >= 1e6, F.concat(F.round(t / 1e6, 2).cast("string"), F.lit(" MB")))
    return total.withColumns({"mb_per_file": F.round(t / 1e6 / F.col("n_files"), 6), "readable": text.otherwise(F.concat(F.col("total_bytes").cast("string"), F.lit(" B")))})


def pair_labels(images: DataFrame, labels: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """Images with the label file that their rewritten path names."""
    want = images.withColumn("label_path", F.regexp_replace(path, old, new))
    return want.join(labels.select(F.col(path).alias("label_path")).distinct(), "label_path")


def complete_files(listing: DataFrame, size: str, least: int) -> DataFrame:
    """Files that are not cut short."""
    return listing.where(F.col(size) >= least)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, by the order of seeded digests."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def seeded(key: Column, seed: int) -> Column:
    """Digest that orders rows at random but repeatably."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
