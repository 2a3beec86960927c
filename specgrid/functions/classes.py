"""Land-cover class codes: names and train ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.constants import INVALID


def class_dim(spark: SparkSession, scheme: list[tuple[int, str, int]]) -> DataFrame:
    return spark.createDataFrame(scheme, "code int, name string, train_id int")


def class_name(df: DataFrame, code: str, dim: DataFrame) -> DataFrame:
    """Name of each code, null if unknown (P18); the dimension has a row a class."""
    return df.join(F.broadcast(dim.select(F.col("code").alias(code), "name")), code, "left")


def class_code(df: DataFrame, name: str, dim: DataFrame) -> DataFrame:
    """Code of each class name, null if unknown (P18, inverse)."""
    return df.join(F.broadcast(dim.select(F.col("name").alias(name), "code")), name, "left")


def remap_labels(col: Column, scheme: list[tuple[int, str, int]], inverse: bool = False, compat: bool = False) -> Column:
    """Code to train id, or back; anything else is invalid.

    ``compat`` divides codes by ten after folding the two last classes, as older outputs did.
    """
    if compat:
        folded = F.when(col == 90, 10).when(col == 100, 11).otherwise(col)
        return F.floor(folded / 10).cast("int") - 1
    pairs = [(t, c) if inverse else (c, t) for c, _, t in scheme if t != INVALID]
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.coalesce(F.try_element_at(table, col), F.lit(INVALID))
