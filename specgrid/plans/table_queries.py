"""Inventories, metrics, ranks, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrid.constants import DFC, WORLDCOVER
from specgrid.functions import geo
from specgrid.functions import names as nm
from specgrid.functions.classes import class_code, class_dim, class_name, remap_labels
from specgrid.operators import inventory as iv
from specgrid.operators import mapping as mp
from specgrid.operators import model as md
from specgrid.operators import order as od
from specgrid.operators import split as sp
from specgrid.operators import stats as st
from specgrid.plans.registry import query
from specgrid.plans.views import duck, table, view
from specgrid.sources import io

PRED, LOG = duck("v_pred"), duck("v_log")


def _pred(spark, sf):
    return view(spark, sf, "v_pred")


def _log(spark, sf):
    return view(spark, sf, "v_log")


def _r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


_METRICS = """count(*) AS n, round(1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)), 8) AS r2, round(sqrt(avg((predicted - actual) ** 2)), 8) AS rmse,
 round(avg(abs(predicted - actual)), 8) AS mae, round(avg((predicted - actual) ** 2), 8) AS mse"""


@query("a6_metrics_by_split", PRED + f"SELECT split, {_METRICS} FROM v_pred GROUP BY 1")
def a6_metrics_by_split(spark, sf):
    return _r(st.regression_metrics(_pred(spark, sf), ["split"]), 8, "r2", "rmse", "mae", "mse")


@query("a6_metrics_by_flightline", PRED + f"SELECT flightline, {_METRICS} FROM v_pred GROUP BY 1")
def a6_metrics_by_flightline(spark, sf):
    return _r(st.regression_metrics(_pred(spark, sf), ["flightline"]), 8, "r2", "rmse", "mae", "mse")


_BASE = PRED[:-1] + ", g AS (SELECT avg(actual) AS baseline_guess FROM v_pred WHERE split = 'train')\n"


@query(
    "a7_vs_baseline",
    _BASE
    + """, m AS (SELECT split, sqrt(avg((predicted - actual) ** 2)) AS rmse, avg(abs(predicted - actual)) AS mae, sqrt(avg((baseline_guess - actual) ** 2)) AS base_rmse, avg(abs(baseline_guess - actual)) AS base_mae FROM v_pred, g GROUP BY 1)
SELECT split, round(rmse, 8) AS rmse, round(mae, 8) AS mae, round(base_rmse, 8) AS base_rmse, round(base_mae, 8) AS base_mae, round((1 - rmse / base_rmse) * 100, 6) AS rmse_gain, round((1 - mae / base_mae) * 100, 6) AS mae_gain FROM m""",
)
def a7_vs_baseline(spark, sf):
    return _r(_r(st.vs_baseline(_pred(spark, sf)), 8, "rmse", "mae", "base_rmse", "base_mae"), 6, "rmse_gain", "mae_gain")


@query("j11_with_baseline", _BASE + "SELECT id, round(baseline_guess, 8) AS baseline_guess, predicted - actual AS error FROM v_pred, g")
def j11_with_baseline(spark, sf):
    return st.with_baseline(_pred(spark, sf)).select("id", F.round("baseline_guess", 8).alias("baseline_guess"), (F.col("predicted") - F.col("actual")).alias("error"))


@query("m11_evaluation_report", _BASE + "SELECT id, split, actual, predicted, round(predicted - actual, 8) AS error, round(baseline_guess, 8) AS baseline_guess FROM v_pred, g")
def m11_evaluation_report(spark, sf):
    return _r(md.evaluation_report(_pred(spark, sf)), 8, "error", "baseline_guess")


@query("m9_mean_baseline", PRED + "SELECT split, round(avg(actual), 8) AS guess FROM v_pred GROUP BY 1")
def m9_mean_baseline(spark, sf):
    return _pred(spark, sf).groupBy("split").agg(F.round(F.avg("actual"), 8).alias("guess"))


@query(
    "m9_fold_baseline",
    PRED[:-1]
    + """, p AS (SELECT flightline % 7 AS fold, actual FROM v_pred), g AS (SELECT f.fold, avg(actual) AS guess FROM (SELECT DISTINCT fold FROM p) f JOIN p ON p.fold <> f.fold GROUP BY 1)
SELECT fold, round(guess, 8) AS guess, count(*) AS n, round(sqrt(avg((guess - actual) ** 2)), 8) AS rmse, round(avg(abs(guess - actual)), 8) AS mae FROM p JOIN g USING (fold) GROUP BY 1, guess""",
)
def m9_fold_baseline(spark, sf):
    p = _pred(spark, sf).select((F.col("flightline") % 7).alias("fold"), "actual")
    return _r(st.fold_baseline(p, "fold"), 8, "guess", "rmse", "mae")


@query(
    "a8_residual_histogram",
    PRED[:-1] + ", e AS (SELECT round(predicted - actual, 6) AS e FROM v_pred), b AS (SELECT min(e) AS lo, max(e) AS hi FROM e)\nSELECT CAST(least(floor((e - lo) / (hi - lo) * 15), 14) AS INT) AS bin, count(*) AS n FROM e, b GROUP BY 1",
)
def a8_residual_histogram(spark, sf):
    p = _pred(spark, sf)
    e = p.withColumns({"predicted": F.round(F.col("predicted") - F.col("actual"), 6), "actual": F.lit(0.0)})
    return st.residual_histogram(e, 15)


@query("a10_target_stats", duck("v_sites") + "SELECT round(avg(richness), 8) AS mean, round(stddev_pop(richness) + 1e-6, 8) AS std, min(richness) AS min, max(richness) AS max FROM v_sites")
def a10_target_stats(spark, sf):
    return _r(st.target_stats(view(spark, sf, "v_sites")), 8, "mean", "std")


@query("a11_fold_summary", PRED[:-1] + ", f AS (SELECT flightline, 1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)) AS r2 FROM v_pred GROUP BY 1)\nSELECT count(r2) AS n_folds, round(avg(r2), 8) AS mean, round(stddev_samp(r2), 8) AS std FROM f")
def a11_fold_summary(spark, sf):
    return _r(st.fold_summary(st.regression_metrics(_pred(spark, sf), ["flightline"])), 8, "mean", "std")


@query("a12_class_accuracy", "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(k) / sum(n), 9) AS accuracy, round(avg(k / n), 9) AS macro_accuracy FROM (SELECT quality, count(*) AS n, sum(CAST(quality = toxic AS INT)) AS k FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1)")
def a12_class_accuracy(spark, sf):
    rows = table(spark, sf, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return _r(st.class_accuracy(rows, "quality", "toxic"), 9, "accuracy", "macro_accuracy")


@query("j13_pair_pixels", "SELECT count(*) AS n, CAST(sum(CAST(quality = toxic AS INT)) AS BIGINT) AS agree FROM labels JOIN documents USING (doc_id) WHERE quality <> -1")
def j13_pair_pixels(spark, sf):
    from specgrid.operators.patch import pair_pixels

    labels = table(spark, sf, "labels")
    pairs = pair_pixels(table(spark, sf, "documents").select("doc_id").join(labels.select("doc_id", "toxic"), "doc_id"), labels.select("doc_id", F.col("quality").alias("label")), ["doc_id"])
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("toxic")).cast("int")).alias("agree"))


@query("a13_describe_sites", duck("v_sites") + "SELECT count(lat) AS n, round(avg(lat), 8) AS mean, round(stddev_samp(lat), 8) AS std, min(lat) AS min, round(quantile_cont(lat, 0.25), 8) AS q25, round(quantile_cont(lat, 0.5), 8) AS q50, round(quantile_cont(lat, 0.75), 8) AS q75, max(lat) AS max FROM v_sites")
def a13_describe_sites(spark, sf):
    return _r(st.describe(view(spark, sf, "v_sites"), "lat"), 8, "mean", "std", "q25", "q50", "q75")


@query("a14_split_counts", PRED + "SELECT split, count(*) AS n_rows, count(DISTINCT flightline) AS n_groups FROM v_pred GROUP BY 1")
def a14_split_counts(spark, sf):
    return st.split_counts(_pred(spark, sf), "flightline", "split")


@query("a17_throughput", LOG + "SELECT worker, CAST(sum(bytes) AS BIGINT) AS total_bytes, round(sum(bytes) / 1e6 / (epoch(max(ts)) - epoch(min(ts))), 8) AS mb_per_s FROM v_log GROUP BY 1")
def a17_throughput(spark, sf):
    return _r(st.throughput(_log(spark, sf)), 8, "mb_per_s").drop("seconds")


@query("a18_within_thresholds", PRED + "SELECT split, round(avg(CAST(abs(predicted - actual) <= 2.5 AS INT)), 9) AS within_2_5, round(avg(CAST(abs(predicted - actual) <= 5.0 AS INT)), 9) AS within_5_0 FROM v_pred GROUP BY 1")
def a18_within_thresholds(spark, sf):
    return _r(st.within_thresholds(_pred(spark, sf), [2.5, 5.0], ["split"]), 9, "within_2_5", "within_5_0")


@query("a21_epoch_means", LOG + "SELECT epoch, round(avg(metric), 8) AS mean_metric, count(*) AS n FROM v_log GROUP BY 1")
def a21_epoch_means(spark, sf):
    return _r(st.epoch_means(_log(spark, sf)), 8, "mean_metric")


@query(
    "w6_early_stop",
    LOG[:-1]
    + """, a AS (SELECT run, step, metric, row_number() OVER w AS n, max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM v_log WINDOW w AS (PARTITION BY run ORDER BY step)),
b AS (SELECT *, (bb IS NULL OR metric > bb) AS is_best FROM a), c AS (SELECT *, n - max(CASE WHEN is_best THEN n END) OVER (PARTITION BY run ORDER BY step) AS since FROM b),
d AS (SELECT *, coalesce(max(CAST(since >= 25 AS INT)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM c)
SELECT run, step, greatest(bb, metric) AS best, is_best, CAST(since AS INT) AS since FROM d WHERE stops = 0""",
)
def w6_early_stop(spark, sf):
    return st.early_stop(_log(spark, sf), 25).select("run", "step", "best", "is_best", F.col("since").cast("int").alias("since"))


@query("w7_trailing_mean", LOG + "SELECT run, step, round(avg(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS trailing FROM v_log")
def w7_trailing_mean(spark, sf):
    return _r(st.trailing_mean(_log(spark, sf), 10), 8, "trailing")


@query("w8_global_rank", PRED + "SELECT id, row_number() OVER (ORDER BY actual, id) AS rank FROM v_pred")
def w8_global_rank(spark, sf):
    return od.global_rank(_pred(spark, sf).select("id", "actual"), "actual", "id").select("id", "rank")


@query("w9_error_cdf", PRED + "SELECT id, round(row_number() OVER (ORDER BY round(abs(predicted - actual), 6), id) / (SELECT count(*) FROM v_pred), 9) AS cdf FROM v_pred")
def w9_error_cdf(spark, sf):
    e = _pred(spark, sf).withColumns({"predicted": F.round(F.abs(F.col("predicted") - F.col("actual")), 6), "actual": F.lit(0.0)})
    return _r(st.error_cdf(e), 9, "cdf").drop("abs_error")


@query("w11_eval_epochs", LOG + "SELECT step, epoch FROM v_log WHERE epoch IN (0, 3, 6, 10)")
def w11_eval_epochs(spark, sf):
    return st.eval_epochs(_log(spark, sf), 4, 100, 1000).select("step", "epoch")


@query("w11_every_epoch", LOG + "SELECT step, epoch FROM v_log WHERE epoch < 4")
def w11_every_epoch(spark, sf):
    return st.eval_epochs(_log(spark, sf), 4, 100, 300).select("step", "epoch")


@query("w12_best_epoch", LOG + "SELECT run, step, epoch, metric FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, step) AS rn FROM v_log) WHERE rn = 1")
def w12_best_epoch(spark, sf):
    return st.best_epoch(_log(spark, sf))


@query("l6_top_errors", PRED + "SELECT id, round(abs(predicted - actual), 6) AS abs_error FROM v_pred ORDER BY 2 DESC, 1 LIMIT 20")
def l6_top_errors(spark, sf):
    e = _pred(spark, sf).withColumns({"predicted": F.round(F.abs(F.col("predicted") - F.col("actual")), 6), "actual": F.lit(0.0)})
    return st.top_errors(e, 20).select("id", "abs_error")


@query("l1_total_order", "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS pos FROM part ORDER BY 3 LIMIT 50")
def l1_total_order(spark, sf):
    from pyspark.sql import Window

    first = table(spark, sf, "part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey").limit(50)
    return first.withColumn("pos", F.row_number().over(Window.orderBy("p_name", "p_partkey")).cast("long"))


@query("l2_first_n", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 100")
def l2_first_n(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("l3_head_tail", PRED + "(SELECT id, 'head' AS part FROM v_pred ORDER BY id LIMIT 15) UNION ALL (SELECT id, 'tail' AS part FROM v_pred ORDER BY id DESC LIMIT 5)")
def l3_head_tail(spark, sf):
    p = _pred(spark, sf).select("id")
    return p.orderBy("id").limit(15).withColumn("part", F.lit("head")).union(p.orderBy(F.desc("id")).limit(5).withColumn("part", F.lit("tail")))


_IDS = "inv AS (SELECT o_orderkey AS native_id FROM orders), s1 AS (SELECT DISTINCT l_orderkey AS native_id FROM lineitem WHERE l_quantity > 40), s2 AS (SELECT o_orderkey AS native_id FROM orders WHERE o_custkey % 5 = 0)"


def _ids(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    key = lambda df, c: df.select(F.col(c).alias("native_id"))
    return key(o, "o_orderkey"), key(li.where("l_quantity > 40"), "l_orderkey"), key(o.where("o_custkey % 5 = 0"), "o_orderkey")


@query("j5_pending", f"WITH {_IDS} SELECT DISTINCT native_id FROM inv WHERE native_id NOT IN (SELECT * FROM s1) AND native_id NOT IN (SELECT * FROM s2)")
def j5_pending(spark, sf):
    inv, a, b = _ids(spark, sf)
    return iv.pending(inv, a, b)


@query(
    "j6_boundary_actions",
    f"""WITH {_IDS}, w AS (SELECT native_id FROM inv WHERE native_id % 3 = 0), f AS (SELECT coalesce(a.native_id, b.native_id) AS native_id, a.native_id IS NOT NULL AS ia, b.native_id IS NOT NULL AS ib FROM (SELECT DISTINCT native_id FROM s1) a FULL OUTER JOIN (SELECT DISTINCT native_id FROM s2) b USING (native_id))
SELECT native_id, CASE WHEN ia AND ib AND native_id IN (SELECT * FROM w) THEN 'delete_unlabeled_copy' WHEN ia AND ib THEN 'delete_labeled_copy' WHEN ia AND native_id NOT IN (SELECT * FROM w) THEN 'move_to_unlabeled'
 WHEN ib AND native_id IN (SELECT * FROM w) THEN 'move_to_labeled' ELSE 'keep' END AS action FROM f""",
)
def j6_boundary_actions(spark, sf):
    inv, a, b = _ids(spark, sf)
    return iv.boundary_actions(a, b, inv.where("native_id % 3 = 0"))


@query("j12_batch_ids", "SELECT batch, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS ids FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS BIGINT) AS batch FROM orders) GROUP BY 1")
def j12_batch_ids(spark, sf):
    out = iv.batch_ids(table(spark, sf, "orders"), "o_orderkey", 50)
    return out.select("batch", "n", F.array_join("ids", ",").alias("ids"))


@query("l4_incremental_batch", f"WITH {_IDS}, r AS (SELECT DISTINCT native_id FROM inv WHERE native_id NOT IN (SELECT * FROM s1)) SELECT native_id, greatest((SELECT count(*) FROM r) - 25, 0) AS remaining FROM r ORDER BY 1 LIMIT 25")
def l4_incremental_batch(spark, sf):
    inv, a, _ = _ids(spark, sf)
    return iv.incremental_batch(inv, a, 25)


@query("l5_sample_n", PRED + "SELECT id FROM v_pred ORDER BY md5(concat('42:', id)), id LIMIT 200")
def l5_sample_n(spark, sf):
    return iv.sample_n(_pred(spark, sf), "id", 200).select("id")


@query("u1_union_sources", "SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def u1_union_sources(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    return a.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


@query(
    "u2_union_windows",
    "SELECT window_no, o_orderkey FROM (SELECT CAST(0 AS INT) AS window_no, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-06-30' UNION ALL SELECT 1, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31')",
)
def u2_union_windows(spark, sf):
    out = iv.union_windows(table(spark, sf, "orders"), [("1994-01-01", "1995-06-30"), ("1995-01-01", "1996-12-31")], "o_orderdate")
    return out.select("window_no", "o_orderkey")


@query("p13_in_window", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def p13_in_window(spark, sf):
    return table(spark, sf, "orders").where(nm.in_window(F.col("o_orderdate").cast("timestamp_ntz"), "1995-01-01", "1995-12-31")).select("o_orderkey")


@query("u3_existing", f"WITH {_IDS} SELECT native_id FROM s1 UNION SELECT native_id FROM s2")
def u3_existing(spark, sf):
    _, a, b = _ids(spark, sf)
    return iv.existing(a, b)


@query("u4_difference", f"WITH {_IDS} SELECT native_id FROM inv EXCEPT SELECT native_id FROM s2")
def u4_difference(spark, sf):
    inv, _, b = _ids(spark, sf)
    return inv.subtract(b)


@query("u5_intersection", f"WITH {_IDS} SELECT native_id FROM s1 INTERSECT SELECT native_id FROM s2")
def u5_intersection(spark, sf):
    _, a, b = _ids(spark, sf)
    return a.intersect(b)


@query("u6_distinct", "SELECT DISTINCT o_custkey FROM orders")
def u6_distinct(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").distinct()


_LEAK = PRED[:-1] + ", f AS (SELECT v.*, CASE WHEN site_id IN (SELECT site_id FROM v_pred WHERE split = 'train' AND flightline < 30) THEN 'overlap' ELSE 'clean' END AS leak FROM v_pred v WHERE split = 'val')\n"


def _leak(spark, sf):
    p = _pred(spark, sf)
    return sp.leakage_flags(p.where("split = 'train' AND flightline < 30"), p.where("split = 'val'"), ["site_id"])


@query("j8_leakage_audit", _LEAK + "SELECT id, leak FROM f")
def j8_leakage_audit(spark, sf):
    return _leak(spark, sf).select("id", "leak")


@query("u7_leak_classes", _LEAK + f'SELECT coalesce(leak, \'combined\') AS "class", {_METRICS} FROM f GROUP BY GROUPING SETS ((leak), ())')
def u7_leak_classes(spark, sf):
    return _r(st.leak_classes(_leak(spark, sf), "leak"), 8, "r2", "rmse", "mae", "mse")


_LOGO = PRED[:-1] + ", g AS (SELECT flightline % 10 AS grp, site_id FROM v_pred), p AS (SELECT grp, site_id, count(*) AS n FROM g GROUP BY 1, 2)\n"
_LOGO_ROWS = "SELECT f.fold, t.grp, t.site_id, t.n FROM p t, (SELECT DISTINCT grp AS fold FROM p) f WHERE t.grp <> f.fold AND NOT EXISTS (SELECT 1 FROM p h WHERE h.grp = f.fold AND h.site_id = t.site_id)"


def _grouped(spark, sf):
    return _pred(spark, sf).select((F.col("flightline") % 10).alias("grp"), "site_id")


@query("j9_lofo_pairs", _LOGO + _LOGO_ROWS)
def j9_lofo_pairs(spark, sf):
    return sp.leave_one_group_out(_grouped(spark, sf), "grp", "site_id").select("fold", "grp", "site_id", "n")


@query("m5_leave_one_group_out", _LOGO + f"SELECT fold, count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS n_rows FROM ({_LOGO_ROWS}) GROUP BY 1")
def m5_leave_one_group_out(spark, sf):
    return sp.held_out_sizes(_grouped(spark, sf), "grp", "site_id")


_RANKED = PRED[:-1] + ", r AS (SELECT id, row_number() OVER (ORDER BY md5(concat('42:', id)), id) AS k, count(*) OVER () AS n FROM v_pred)\n"


@query("m1_split", _RANKED + "SELECT id, CASE WHEN k <= ceil(n * 0.2e0) THEN 'val' ELSE 'train' END AS part FROM r")
def m1_split(spark, sf):
    return sp.split(_pred(spark, sf).select("id"), "id", 0.2)


@query("m2_split3", _RANKED + "SELECT id, CASE WHEN k <= ceil(n * 0.2e0) THEN 'test' WHEN k <= ceil(n * 0.2e0) + ceil(n * 0.2e0) THEN 'val' ELSE 'train' END AS part FROM r")
def m2_split3(spark, sf):
    return sp.split3(_pred(spark, sf).select("id"), "id", 0.2, 0.2)


@query("m3_split_fraction", _RANKED + "SELECT id, CASE WHEN k <= floor(floor(n * 0.8e0) * 0.5e0) THEN 'train' WHEN k <= floor(n * 0.8e0) THEN 'unused' ELSE 'val' END AS part FROM r")
def m3_split_fraction(spark, sf):
    return sp.split_fraction(_pred(spark, sf).select("id"), "id", 0.8, 0.5)


@query("m13_validation_sites", _RANKED + "SELECT id FROM r WHERE k <= ceil(n * 0.1e0)")
def m13_validation_sites(spark, sf):
    return md.validation_sites(_pred(spark, sf).select("id"), "id", 0.1)


@query(
    "m4_group_kfold",
    duck(
        "v_pred",
        more="""c AS (SELECT flightline, count(*) AS n FROM v_pred GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, flightline) AS i FROM c),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS flightline, -1 AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
 UNION ALL SELECT o.i, o.flightline, CAST(list_position(w.loads, list_min(w.loads)) - 1 AS INT), list_transform(range(1, 6), lambda j: w.loads[j] + CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN o.n ELSE 0 END)
 FROM w JOIN o ON o.i = w.i + 1)""",
        recursive=True,
    )
    + "SELECT flightline, CAST(fold AS INT) AS fold FROM w WHERE i > 0",
)
def m4_group_kfold(spark, sf):
    return sp.group_kfold(_pred(spark, sf), "flightline", 5).select("flightline", "fold").distinct()


@query(
    "m6_fold_zscore",
    PRED[:-1]
    + """, p AS (SELECT id, flightline % 5 AS fold, actual FROM v_pred), f AS (SELECT DISTINCT fold FROM p), s AS (SELECT f.fold, avg(actual) AS mean, stddev_pop(actual) + 1e-6 AS std FROM f JOIN p ON p.fold <> f.fold GROUP BY 1)
SELECT id, round((actual - mean) / std, 7) AS z FROM p JOIN s USING (fold)""",
)
def m6_fold_zscore(spark, sf):
    p = _pred(spark, sf).select("id", (F.col("flightline") % 5).alias("fold"), "actual")
    return sp.fold_zscore(p, "fold", "actual").select("id", F.round("z", 7).alias("z"))


@query("m7_cv_score")
def m7_cv_score(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), "label", (F.col("vec_id") % 3).cast("int").alias("fold"))
    return _r(md.cv_score(v, "x", "label", "fold"), 8, "r2", "rmse", "mae", "mse")


_SUMS = ", ".join(f"avg({a} * {b}) - avg({a}) * avg({b}) AS {n}" for n, a, b in (("ss", "a", "a"), ("st", "a", "b"), ("tt", "b", "b"), ("sy", "a", "y"), ("ty", "b", "y"), ("yy", "y", "y")))
_HEAD = f"""WITH r AS (SELECT vec_id % 3 AS fold, list_avg(CAST(embedding AS DOUBLE[])[1:32]) AS a, list_avg(CAST(embedding AS DOUBLE[])[33:64]) AS b, CAST(label AS DOUBLE) AS y FROM embeddings),
g AS (SELECT f.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, {_SUMS} FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold <> f.fold GROUP BY 1),
h AS (SELECT *, 1 + 0.1e0 / sqrt(yy) AS d, st / sqrt(ss * tt) AS c, sy / sqrt(ss * yy) AS p, ty / sqrt(tt * yy) AS q FROM g),
w AS (SELECT *, (d * p - c * q) / (d * d - c * c) * sqrt(yy / ss) AS wa, (d * q - c * p) / (d * d - c * c) * sqrt(yy / tt) AS wb FROM h),
v_pred AS (SELECT CAST(fold AS INT) AS fold, y AS actual, my + wa * (a - ma) + wb * (b - mb) AS predicted FROM r JOIN w USING (fold))
"""


@query("m7_cv_score_blocks", _HEAD + f"SELECT fold, {_METRICS} FROM v_pred GROUP BY 1")
def m7_cv_score_blocks(spark, sf):
    """The head on the means of both halves of a vector, whose normal equations SQL can solve."""
    half = lambda at: F.aggregate(F.slice("x", at, 32), F.lit(0.0), lambda s, v: s + v) / 32
    v = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), "label", (F.col("vec_id") % 3).cast("int").alias("fold"))
    return _r(md.cv_score(v.withColumn("x", F.array(half(1), half(33))), "x", "label", "fold"), 8, "r2", "rmse", "mae", "mse")


@query("m8_score_linear", "SELECT vec_id, round((list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (i - 1) / 64e0)) + 0.5e0) * 2 + 10, 7) AS score FROM embeddings")
def m8_score_linear(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return md.score_linear(v, "x", [i / 64 for i in range(64)], 0.5, 10.0, 2.0).select("vec_id", F.round("score", 7).alias("score"))


@query(
    "m12_holdout_report",
    duck("v_pred", "v_sites") + "SELECT id, printf('Site_%.4f_%.4f', lat, lon) AS site, round(actual - predicted, 8) AS error, round(abs(actual - predicted), 8) AS abs_error, flightline FROM v_pred JOIN v_sites USING (site_id) WHERE split = 'val'",
)
def m12_holdout_report(spark, sf):
    out = md.holdout_report(_pred(spark, sf), view(spark, sf, "v_sites"))
    return _r(out.select("id", "site", "error", "abs_error", "flightline"), 8, "error", "abs_error")


@query("x12_target_zscore", duck("v_sites") + "SELECT site_id, round((richness - m) / s, 7) AS z FROM v_sites, (SELECT avg(richness) AS m, stddev_pop(richness) + 1e-6 AS s FROM v_sites)")
def x12_target_zscore(spark, sf):
    s = view(spark, sf, "v_sites")
    return s.crossJoin(F.broadcast(st.target_stats(s))).select("site_id", F.round((F.col("richness") - F.col("mean")) / F.col("std"), 7).alias("z"))


@query("s1_read_sites", duck("v_sites") + "SELECT CAST(site_id AS VARCHAR) AS site_id, lat, lon, richness FROM v_sites")
def s1_read_sites(spark, sf):
    """CSV files under two spellings of the columns, read by the same reader."""
    s, out = view(spark, sf, "v_sites"), []
    for part, names in (("site_id % 2 = 0", ("SiteID", "Latitude", "Longitude", "Richness")), ("site_id % 2 = 1", ("site_id", "latitude", "longitude", "richness"))):
        path = io.work_dir(spark, "sites")
        io.write_report(s.where(part).select("site_id", "lat", "lon", "richness").toDF(*names), path)
        out.append(io.read_sites(spark, path).select("site_id", "lat", "lon", "richness"))
    return out[0].unionByName(out[1])


@query("s12_storage_audit", "SELECT count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_bytes, round(sum(n_chars) / 1e6 / count(*), 6) AS mb_per_file, CASE WHEN sum(n_chars) >= 1e9 THEN round(sum(n_chars) / 1e9, 2) || ' GB' WHEN sum(n_chars) >= 1e6 THEN round(sum(n_chars) / 1e6, 2) || ' MB' ELSE sum(n_chars) || ' B' END AS readable FROM documents")
def s12_storage_audit(spark, sf):
    return iv.storage_audit(table(spark, sf, "documents"), "n_chars")


@query("p16_complete_files", "SELECT doc_id FROM documents WHERE n_chars >= 1000")
def p16_complete_files(spark, sf):
    return iv.complete_files(table(spark, sf, "documents"), "n_chars", 1000).select("doc_id")


@query("p2_basename", "SELECT page_id, regexp_extract(url, '[^/\\\\]*$') AS base FROM pages")
def p2_basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", nm.basename(F.col("url")).alias("base"))


@query("p14_filter_name", "SELECT page_id FROM pages WHERE contains(url, 'blog')")
def p14_filter_name(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").contains("blog")).select("page_id")


@query("w2_dedup_files", "SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '[^/\\\\]*$') ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def w2_dedup_files(spark, sf):
    return mp.dedup_first(table(spark, sf, "pages").select("page_id", "url"), [nm.basename(F.col("url"))], ["page_id"]).select("page_id")


@query("s13_pair_labels", "SELECT a.page_id, b.page_id AS label_id FROM pages a JOIN pages b ON b.url = regexp_replace(a.url, '^http:', 'https:') WHERE a.url LIKE 'http:%'")
def s13_pair_labels(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    paired = iv.pair_labels(p.where("url LIKE 'http:%'"), p, "url", "^http:", "https:")
    return paired.select("page_id", F.col("label_path").alias("url")).join(p.select(F.col("page_id").alias("label_id"), "url"), "url").select("page_id", "label_id")


@query(
    "s13_image_labels",
    "SELECT p_partkey, l_orderkey FROM part JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_linenumber = 1) ON l_partkey = p_partkey",
)
def s13_image_labels(spark, sf):
    """Image files of parts with the label files of order lines, by the path that an image's path names."""
    images = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/cubes/images/t"), "p_partkey", F.lit("_SPECTRAL_IMAGE.TIF")).alias("path"))
    lines = table(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.concat(F.lit("/cubes/labels/t"), "l_partkey", F.lit("_LABEL.TIF")).alias("path")).distinct()
    paired = iv.pair_labels(images, lines, "path", "/images/(.*)_SPECTRAL_IMAGE[.]TIF$", "/labels/$1_LABEL.TIF")
    return paired.select("p_partkey", F.col("label_path").alias("path")).join(lines, "path").select("p_partkey", "l_orderkey")


_WC = " ".join(f"WHEN {c} THEN {t}" for c, _, t in WORLDCOVER)
_IDS = " ".join(f"WHEN '{n}' THEN {c}" for c, n, _ in DFC)
_DF = " ".join(f"WHEN {c} THEN {t}" for c, _, t in DFC)
_NAMES = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in WORLDCOVER)
_CODE = "CAST(p_size % 11 * 10 AS INT)"


@query("p19_remap_labels", f"SELECT p_partkey, coalesce(CASE {_CODE} {_WC} END, -1) AS worldcover, coalesce(CASE p_size % 12 {_DF} END, -1) AS dfc FROM part")
def p19_remap_labels(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", remap_labels(F.expr(_CODE), WORLDCOVER).alias("worldcover"), remap_labels((F.col("p_size") % 12).cast("int"), DFC).alias("dfc"))


@query("p18_class_name", f"SELECT p_partkey, CASE {_CODE} {_NAMES} END AS name FROM part")
def p18_class_name(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(_CODE).alias("code"))
    return class_name(p, "code", class_dim(spark, WORLDCOVER)).select("p_partkey", "name")


@query("p18_class_code", f"SELECT p_partkey, CASE name {_IDS} END AS code FROM (SELECT p_partkey, CASE p_size % 13 {' '.join(f"WHEN {c} THEN '{n}'" for c, n, _ in DFC)} ELSE 'none' END AS name FROM part)")
def p18_class_code(spark, sf):
    dim = class_dim(spark, DFC)
    p = class_name(table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 13).cast("int").alias("size")), "size", dim)
    return class_code(p.select("p_partkey", F.coalesce("name", F.lit("none")).alias("name")), "name", dim).select("p_partkey", "code")


@query("p11_inside_tile", "SELECT o_orderkey, (o_orderkey % 64 > 8 AND o_orderkey % 64 < 56 AND o_custkey % 64 > 8 AND o_custkey % 64 < 56) AS inside FROM orders")
def p11_inside_tile(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", geo.inside_tile(F.col("o_orderkey") % 64, F.col("o_custkey") % 64, 8).alias("inside"))


@query("t2_throughput_windows", LOG + "SELECT CAST(epoch(time_bucket(INTERVAL '2 seconds', ts)) AS BIGINT) AS window_start, worker, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS n FROM v_log GROUP BY 1, 2")
def t2_throughput_windows(spark, sf):
    from specgrid.streaming.jobs import throughput

    return throughput(_log(spark, sf)).withColumn("window_start", F.unix_timestamp(F.col("window_start").cast("timestamp")))


@query("t4_latest_status", LOG + "SELECT worker, arg_max(status, {'t': ts, 's': step}) AS status FROM v_log GROUP BY 1")
def t4_latest_status(spark, sf):
    from specgrid.streaming.jobs import latest_status

    return latest_status(_log(spark, sf)).drop("ts")
