"""Heads on fixed site features: fitting by fold, scoring, reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.functions.names import site_id
from specgrid.operators.split import split
from specgrid.operators.stats import regression_metrics, with_baseline


#: Weight of the ridge on standardised features.
RIDGE = 0.1


def _products(origin: list[float]):
    """Sums of products of (1, features, label), all but the 1 taken from ``origin``, of a task's rows by fold."""
    zero = np.array(origin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - zero[:-1]
            y = batch.column("y").to_numpy(zero_copy_only=False) - zero[-1]
            rows, fold = np.column_stack([np.ones(len(x)), x, y]), batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                own = rows[fold == f]
                sums[f] = sums.get(f, 0) + own.T @ own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))], ["fold", "sums"])

    return run


def ridge_head(sums: np.ndarray, origin: list[float], ridge: float = RIDGE) -> tuple[list[float], float]:
    """Weights and intercept of least squares on standardised features and label with a ridge, from sums of products; a constant feature weighs nothing."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    mean = mean + np.array(origin)
    if dev[-1] == 0:
        return [0.0] * (len(dev) - 1), float(mean[-1])
    safe = np.where(dev > 0, dev, 1)
    corr = cov / np.outer(safe, safe)
    w = np.linalg.solve(corr[:-1, :-1] + ridge / dev[-1] * np.eye(len(dev) - 1), corr[:-1, -1]) * (dev[:-1] > 0) * dev[-1] / safe[:-1]
    return w.tolist(), float(mean[-1] - w @ mean[:-1])


def cv_score(df: DataFrame, features: str, label: str, fold: str, ridge: float = RIDGE) -> DataFrame:
    """Metrics of a linear head on the rows of each fold, fitted on those of all others (M7).

    One pass sums the products of features and label by fold; the sums of all
    folds less a fold's own are the normal equations of its training rows, solved
    on the driver, which sees one small matrix a fold. A second pass scores. Rows
    without features, label or fold are left out; features have one length.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL AND fold IS NOT NULL AND forall(x, v -> v IS NOT NULL)")
    one = rows.first()
    if one is None:
        return regression_metrics(rows.select("fold", F.col("y").alias("actual"), F.col("y").alias("predicted")), ["fold"])
    origin = [*one.x, one.y]
    d = len(origin) + 1
    parts = rows.mapInArrow(_products(origin), "fold int, sums array<double>").select("fold", F.posexplode("sums").alias("pos", "v"))
    sums: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fold", "pos").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.fold, np.zeros(d * d))[r.pos] = r.v
    whole = sum(sums.values())
    heads = [(f, *ridge_head((whole - s).reshape(d, d), origin, ridge)) for f, s in sums.items() if (whole - s)[0] > 0]
    fitted = F.broadcast(df.sparkSession.createDataFrame(heads, "fold int, w array<double>, b double"))  # one row a fold
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.col("b"), lambda s, v: s + v)
    return regression_metrics(rows.join(fitted, "fold").select("fold", F.col("y").alias("actual"), dot.alias("predicted")), ["fold"])


def cv_score_forest(df: DataFrame, features: str, label: str, fold: str, folds: Sequence[int]) -> DataFrame:
    """The same with a random forest, whose fits share nothing: one for each fold, over a table read once."""
    vec = df.select(array_to_vector(F.col(features)).alias("_x"), F.col(label).cast("double").alias("_y"), F.col(fold).alias("fold")).persist()
    fit = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=20, seed=1)
    models = [(f, fit.fit(vec.where(F.col("fold") != f))) for f in folds]
    held = [m.transform(vec.where(F.col("fold") == f)).select("fold", F.col("_y").alias("actual"), F.col("prediction").alias("predicted")) for f, m in models]
    return regression_metrics(reduce(DataFrame.unionByName, held), ["fold"])


def score_linear(df: DataFrame, features: str, weights: Sequence[float], bias: float, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """Dot product with stored weights, scaled back (M8)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("score", (dot + bias) * std + mean)


def site_features(cells: DataFrame, key: str = "id") -> DataFrame:
    """Mean and population deviation of each band of a site's patch, in band order."""
    by = cells.groupBy(key, "band").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("band", "m", "s")))
    return by.groupBy(key).agg(rows.alias("r")).select(key, F.transform("r", lambda x: x["m"]).alias("means"), F.transform("r", lambda x: x["s"]).alias("stds"))


def evaluation_report(pred: DataFrame) -> DataFrame:
    """Every row with its error and the mean guess."""
    return with_baseline(pred).select("id", "split", "actual", "predicted", (F.col("predicted") - F.col("actual")).alias("error"), "baseline_guess")


def holdout_report(pred: DataFrame, sites: DataFrame) -> DataFrame:
    """Held-out rows with site name, place and errors; the error's sign is actual - predicted here."""
    rows = pred.where("split = 'val'").join(sites.select("site_id", "lat", "lon"), "site_id")
    error = F.col("actual") - F.col("predicted")
    name = site_id(F.lit(None).cast("string"), F.col("lat"), F.col("lon"))
    return rows.select("id", name.alias("site"), "lat", "lon", "actual", "predicted", error.alias("error"), F.abs(error).alias("abs_error"), "flightline")


def validation_sites(mapping: DataFrame, key: str, test_size: float, seed: int = 42) -> DataFrame:
    """Mapping rows of the validation part."""
    return split(mapping, key, test_size, seed).where("part = 'val'").drop("part")
