"""Queries that feed a table to a stream in batches, each run going on from the checkpoint of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import specgrid.plans.table_queries  # noqa: F401
from specgrid.operators import stats as st
from specgrid.plans.registry import SQL, query
from specgrid.plans.views import duck, view
from specgrid.sources import io
from specgrid.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Arrival of a log row: thirds of the log in turn; of ten rows one comes a batch later, and one as the last of all.
_BATCH = "CASE WHEN step % 10 = 6 THEN 4 ELSE LEAST(CAST(floor(step * 3e0 / {n}) AS INT), 2) + CASE WHEN step % 10 = 3 THEN 1 ELSE 0 END END"


def _feed(spark, name: str, rows: DataFrame, batch: str, start: Callable[[DataFrame, str, str], object]) -> str:
    """Writes the rows batch by batch and runs the stream to its end after each; where its results are."""
    src, dst, at = (io.work_dir(spark, f"{name}-{x}") for x in ("src", "dst", "at"))
    rows = rows.withColumn("_batch", F.expr(batch))
    for number in sorted(r[0] for r in rows.select("_batch").distinct().collect()):
        rows.where(F.col("_batch") == number).drop("_batch").write.mode("append").parquet(src)
        start(spark.readStream.schema(rows.drop("_batch").schema).parquet(src), dst, at).awaitTermination()
    return dst


def _arrivals(rows: DataFrame) -> str:
    return _BATCH.format(n=rows.count())


@query(
    "t2_throughput_stream",
    duck("v_log")[:-1]
    + f""", a AS (SELECT *, {_BATCH.format(n="(SELECT count(*) FROM v_log)")} AS batch, time_bucket(INTERVAL '2 seconds', ts) AS start FROM v_log),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '10 seconds' AS mark FROM a GROUP BY 1)
SELECT CAST(epoch(start) AS BIGINT) AS window_start, worker, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS n FROM a JOIN m USING (batch)
WHERE (mark IS NULL OR start + INTERVAL '2 seconds' > mark) AND start + INTERVAL '2 seconds' <= (SELECT max(ts) FROM v_log) - INTERVAL '10 seconds' GROUP BY 1, 2""",
)
def t2_throughput_stream(spark, sf):
    log = view(spark, sf, "v_log").select("step", "worker", F.col("ts").cast("timestamp").alias("ts"), "bytes")
    dst = _feed(spark, "throughput", log, _arrivals(log), lambda rows, dst, at: jobs.append_stream(jobs.throughput(rows), dst, at))
    out = spark.read.schema("window_start timestamp, worker long, total_bytes long, n long").parquet(dst)
    return out.withColumn("window_start", F.unix_timestamp("window_start"))


@query("t3_early_stop_stream", SQL["w6_early_stop"])
def t3_early_stop_stream(spark, sf):
    log = view(spark, sf, "v_log").select("run", "step", "metric")
    # Thirds of the log in order; rows of the first one that come again at the end are late.
    thirds = f"explode(CASE WHEN step * 3 < {log.count()} AND step % 7 = 0 THEN array(0, 3) ELSE array(LEAST(CAST(floor(step * 3e0 / {log.count()}) AS INT), 2)) END)"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        dst = _feed(spark, "stop", log, thirds, lambda rows, dst, at: jobs.append_stream(jobs.early_stop_stream(rows, 25), dst, at))
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema("run long, step long, best double, is_best boolean, since int").parquet(dst)


@query("t4_latest_status_stream", SQL["t4_latest_status"])
def t4_latest_status_stream(spark, sf):
    log = view(spark, sf, "v_log").select("step", "worker", "ts", "status")
    dst = _feed(spark, "status", log, _arrivals(log), lambda rows, dst, at: jobs.latest_stream(jobs.latest_status(rows), dst, at))
    return jobs.read_latest(spark, dst, "worker long, status string")


@query(
    "t5_band_moments_stream",
    duck("v_cells") + "SELECT band, count(*) AS n, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-6), 6) AS std FROM v_cells GROUP BY 1",
)
def t5_band_moments_stream(spark, sf):
    """Fed with values a million away from zero."""
    cells = view(spark, sf, "v_cells").select("id", "band", (F.col("value") + 1e6).alias("value"))
    dst = _feed(spark, "moments", cells, "CAST(id % 3 AS INT)", lambda rows, dst, at: jobs.latest_stream(st.deviations(st.moments(rows)), dst, at))
    out = jobs.read_latest(spark, dst, "band int, n long, mean double, std double")
    return out.select("band", "n", F.round(F.col("mean") - 1e6, 6).alias("mean"), F.round("std", 6).alias("std"))
