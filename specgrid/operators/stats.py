"""Band statistics, regression and class metrics, ranks over whole tables, training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.operators.order import SKETCH, bracket_shares, global_rank, quantiles


def moments(df: DataFrame, value: str = "value", by: Sequence[str] = ("band",)) -> DataFrame:
    """``n``, ``mean`` and ``m2`` (squares about the mean) of each group, on a table or a stream (T5).

    Spark keeps and merges just these, so nothing cancels however far from zero
    the values lie; ``merge_moments`` puts results of several tables together.
    """
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_moments(parts: DataFrame, by: Sequence[str] = ("band",)) -> DataFrame:
    """Moments of all rows from those of parts of them: the squares within the parts and, by size, of their means about the whole mean."""
    whole = parts.groupBy(*by).agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    off = F.col("mean") - F.col("all_mean")
    both = parts.where("n > 0").join(whole, list(by))
    return both.groupBy(*by, "all_n", "all_mean").agg(F.sum(F.col("m2") + F.col("n") * off * off).alias("m2")).select(*by, F.col("all_n").alias("n"), F.col("all_mean").alias("mean"), "m2")


def deviations(told: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Moments with ``m2`` turned into the population deviation, at least ``floor``."""
    return told.withColumn("std", F.greatest(F.sqrt(F.col("m2") / F.col("n")), F.lit(floor))).drop("m2")


def band_stats(cells: DataFrame, valid: str = "all", floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation by band (A1, M10 when grouped)."""
    if valid == "positive":
        cells = cells.where("value > 0")
    return deviations(moments(cells), floor)


def band_max(cells: DataFrame) -> DataFrame:
    """Maximum by band."""
    return cells.groupBy("band").agg(F.max("value").alias("max_value"))


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """R2 = 1 - SSE/SST (0 for one row), RMSE, MAE, MSE and count, in one pass."""
    a, e = F.col(actual), F.col(predicted) - F.col(actual)
    n, sse = F.count(a), F.sum(e * e)
    sst = F.var_pop(a) * n
    return [
        n.alias("n"),
        F.when(n <= 1, 0.0).otherwise(1 - F.try_divide(sse, sst)).alias("r2"),
        F.sqrt(sse / n).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (sse / n).alias("mse"),
    ]


def regression_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of the whole table or by group."""
    return df.groupBy(*by).agg(*metric_columns())


def with_baseline(pred: DataFrame) -> DataFrame:
    """Each row with the mean of the train rows as a guess."""
    guess = pred.where("split = 'train'").agg(F.avg("actual").alias("baseline_guess"))
    return pred.crossJoin(F.broadcast(guess))


def fold_baseline(df: DataFrame, fold: str, target: str = "actual") -> DataFrame:
    """Errors of a guess on each fold's rows: the mean of the other folds' rows (M9), from the sums of all less the fold's own.

    The errors follow from the fold's moments but for the absolute ones, for which
    the guesses, one a fold, meet the rows. Null targets count nowhere.
    """
    rows = df.where(F.col(target).isNotNull())
    own = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"))
    all_n, all_s = own.agg(F.sum("n")).scalar(), own.agg(F.sum("s")).scalar()
    guess = own.select(fold, F.try_divide(all_s - F.col("s"), all_n - F.col("n")).alias("guess"))
    e = F.col("guess") - F.col(target)
    return rows.join(guess, fold).groupBy(fold, "guess").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def vs_baseline(pred: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Metrics against those of the mean guess, with the gain in percent, null if the guess makes no error."""
    e, b = F.col("predicted") - F.col("actual"), F.col("baseline_guess") - F.col("actual")
    out = with_baseline(pred).groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(b * b)).alias("base_rmse"), F.avg(F.abs(b)).alias("base_mae")
    )
    gain = lambda m, base: (1 - F.try_divide(m, base)) * 100
    return out.withColumns({"rmse_gain": gain("rmse", "base_rmse"), "mae_gain": gain("mae", "base_mae")})


def residual_histogram(df: DataFrame, bins: int = 15) -> DataFrame:
    """Errors in equal bins between least and greatest, all in the first if they are equal."""
    e = df.select((F.col("predicted") - F.col("actual")).alias("e"))
    ends = e.agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("e") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return e.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stretch(cells: DataFrame, keys: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values of each group between two percentiles as 0..255, 0 if they hardly differ (A9); a value within 5e-7 of a step is on it."""
    ends = cells.groupBy(*keys).agg(F.percentile("value", [low, high]).alias("p"))
    lo, span = F.col("p")[0], F.col("p")[1] - F.col("p")[0]
    ratio = F.least(F.greatest((F.col("value") - lo) / span, F.lit(0.0)), F.lit(1.0))
    return cells.join(ends, list(keys)).withColumn("u8", F.when(span < 1e-6, 0).otherwise(F.floor(F.round(ratio * 255, 6))).cast("short")).drop("p")


def target_stats(df: DataFrame, col: str = "richness") -> DataFrame:
    """Mean, population deviation + 1e-6, least and greatest (A10)."""
    return df.agg(F.avg(col).alias("mean"), (F.stddev_pop(col) + 1e-6).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))


def fold_summary(folds: DataFrame, metric: str = "r2") -> DataFrame:
    """Mean and sample deviation over folds, nulls left out."""
    return folds.agg(F.count(metric).alias("n_folds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def class_accuracy(df: DataFrame, label: str, predicted: str, ignore: int | None = None) -> DataFrame:
    """Share of right rows, and the mean of the shares by class."""
    if ignore is not None:
        df = df.where(F.col(label) != ignore)
    right = F.sum((F.col(label) == F.col(predicted)).cast("int"))
    by = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), right.alias("k"))
    return by.agg(F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("accuracy"), F.avg(F.col("k") / F.col("n")).alias("macro_accuracy"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of a column.

    One pass takes the aggregates and a sketch, a second one counts what lies
    around the quartiles; the third reads only that.
    """
    shares = [0.25, 0.5, 0.75]
    told = df.agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"),
        F.percentile_approx(F.col(col).cast("double"), bracket_shares(shares), SKETCH).alias("sketch"),
    ).first()
    quartiles = dict(zip(("q25", "q50", "q75"), quantiles(df, col, shares, told.n, told.sketch), strict=True))
    kind = dict(df.dtypes)[col]
    values = {"n": F.lit(told.n), "mean": F.lit(told["mean"]).cast("double"), "std": F.lit(told.std).cast("double"), "min": F.lit(told["min"]).cast(kind)}
    values |= {k: F.lit(v).cast("double") for k, v in quartiles.items()} | {"max": F.lit(told["max"]).cast(kind)}
    return df.sparkSession.range(1).select(*[v.alias(k) for k, v in values.items()])


def split_counts(df: DataFrame, group: str, split: str) -> DataFrame:
    """Rows and distinct groups by split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))


def throughput(transfers: DataFrame, by: Sequence[str] = ("worker",)) -> DataFrame:
    """Bytes over the time between first and last."""
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ts").cast("timestamp")) / 1e6
    out = transfers.groupBy(*by).agg(F.sum("bytes").alias("total_bytes"), seconds.alias("seconds"))
    return out.withColumn("mb_per_s", F.try_divide(F.col("total_bytes") / 1e6, F.col("seconds")))


def within_thresholds(df: DataFrame, limits: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Share of errors up to each limit."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    return df.groupBy(*by).agg(*[F.avg((e <= t).cast("double")).alias(f"within_{str(t).replace('.', '_')}") for t in limits])


def leak_classes(df: DataFrame, flag: str) -> DataFrame:
    """Metrics by class of a flag and for all rows together, in one pass."""
    out = df.groupingSets([[F.col(flag)], []], F.col(flag)).agg(*metric_columns(), F.grouping(flag).alias("g"))
    return out.withColumn("class", F.when(F.col("g") == 1, "combined").otherwise(F.col(flag))).drop("g", flag)


def error_cdf(df: DataFrame, key: str = "id") -> DataFrame:
    """Sorted absolute errors with their rank over the number of rows."""
    e = df.select(key, F.abs(F.col("predicted") - F.col("actual")).alias("abs_error"))
    return global_rank(e, "abs_error", key, total="n").select(key, "abs_error", (F.col("rank") / F.col("n")).alias("cdf"))


def epoch_means(log: DataFrame) -> DataFrame:
    """Mean metric of each epoch."""
    return log.groupBy("epoch").agg(F.avg("metric").alias("mean_metric"), F.count(F.lit(1)).alias("n"))


def early_stop(log: DataFrame, patience: int, run: str = "run", step: str = "step", metric: str = "metric") -> DataFrame:
    """Running best of each run, steps since it, and the rows up to the first stop."""
    w = Window.partitionBy(run).orderBy(step)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(metric).over(past)
    out = log.withColumns({"best_before": best, "n": F.row_number().over(w)})
    out = out.withColumn("is_best", F.col("best_before").isNull() | (F.col(metric) > F.col("best_before")))
    out = out.withColumn("last_best", F.last(F.when(F.col("is_best"), F.col("n")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("since", F.col("n") - F.col("last_best"))
    out = out.withColumn("stops", F.max((F.col("since") >= patience).cast("int")).over(past))
    kept = out.where(F.coalesce("stops", F.lit(0)) == 0)
    return kept.select(run, step, metric, F.greatest("best_before", metric).alias("best"), "is_best", "since")


def trailing_mean(log: DataFrame, n: int, run: str = "run", step: str = "step", metric: str = "metric") -> DataFrame:
    """Mean of the last ``n`` values of a run."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(-n + 1, 0)
    return log.select(run, step, F.avg(metric).over(w).alias("trailing"))


def best_epoch(log: DataFrame, by: str = "run") -> DataFrame:
    """Best step of each run, the first on ties."""
    top = F.max_by(F.struct("step", "epoch", "metric"), F.struct(F.col("metric"), -F.col("step")))
    return log.groupBy(by).agg(top.alias("t")).select(by, "t.*")


def eval_epochs(log: DataFrame, epochs: int, steps_per_epoch: int, max_steps: int) -> DataFrame:
    """Rows of the epochs to validate after (W11): each of ``epochs`` if they hold more than ``max_steps`` steps, else as many spread from 0 to the last one reached."""
    if steps_per_epoch * epochs > max_steps:
        chosen = list(range(epochs))
    else:
        last = max_steps // steps_per_epoch
        chosen = [i * last // (epochs - 1) for i in range(epochs)] if epochs > 1 else [0] * epochs
    return log.where(F.col("epoch").isin(chosen))


def top_errors(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Rows with the largest absolute errors."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    return df.withColumn("abs_error", e).orderBy(F.desc("abs_error"), key).limit(n)
