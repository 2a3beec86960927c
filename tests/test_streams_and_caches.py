"""Restarts, replays, late rows, moments that merge, and caches that know their inputs."""

import os
import statistics

import pytest
from pyspark.sql import functions as F

from specgrid.operators import stats
from specgrid.plans.views import view
from specgrid.sources import io
from specgrid.streaming import jobs


def test_replayed_batch_adds_nothing(spark, tmp_path):
    src, dst, at = (f"{tmp_path}/{x}" for x in ("src", "dst", "at"))

    def run(rows, checkpoint=at):
        if rows is not None:
            spark.createDataFrame(rows, "granule_id long, v long").write.mode("append").parquet(src)
        jobs.ingest_stream(spark, src, "granule_id long, v long", dst, checkpoint).awaitTermination()
        return sorted(map(tuple, spark.read.schema("granule_id long, v long").parquet(dst).select("granule_id", "v").collect()))

    run([(1, 1), (2, 1), (2, 1)])
    first = run([(2, 2), (3, 2), (None, 2)])
    assert first == [(1, 1), (2, 1), (3, 2)]
    # a failure after the second batch was written and before it was committed
    for name in ("1", ".1.crc"):
        os.remove(f"{at}/commits/{name}")
    assert run(None) == first
    # another stream, whose batches have the same numbers, loses nothing and adds nothing twice
    assert [k for k, _ in run([(9, 9)], f"{at}2")] == [1, 2, 3, 9]


def test_early_stop_restarts_and_drops_late_rows(spark, data, tmp_path):
    log = view(spark, data, "v_log").select("run", "step", "metric")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in ("step < 300", "step >= 300 AND step < 700 OR step % 11 = 0 AND step < 300", "step >= 700"):
        log.where(part).write.mode("append").parquet(f"{tmp_path}/log")
        jobs.append_stream(jobs.early_stop_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), 25), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    got = sorted((r.run, r.step, r.best, r.since) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r.run, r.step, r.best, r.since) for r in stats.early_stop(log, 25).collect())


def test_latest_is_the_last_whole_one(spark, tmp_path):
    dst = f"{tmp_path}/out"
    assert jobs.read_latest(spark, dst, "a long").count() == 0
    for n in (2, 10):
        spark.range(n).select(F.col("id").alias("a")).write.parquet(f"{dst}/batch={n}")
    spark.range(50).select(F.col("id").alias("a")).write.parquet(f"{dst}/batch=11")
    os.remove(f"{dst}/batch=11/_SUCCESS")
    assert jobs.read_latest(spark, dst, "a long").count() == 10


def test_moments_far_from_zero(spark):
    values = [(i % 3, 1e6 + (i * 7919 % 1009) / 1e6) for i in range(3000)]
    df = spark.createDataFrame([*values, (0, None), (5, None)], "band int, value double")
    real = {b: [v for k, v in values if k == b] for b in range(3)}
    for r in stats.band_stats(df).where("n > 0").collect():
        assert r.n == 1000 and r["mean"] == pytest.approx(statistics.fmean(real[r.band]), abs=1e-9) and r.std == pytest.approx(statistics.pstdev(real[r.band]), rel=1e-6)
    parts = [stats.moments(df.where(f"value IS NULL OR pmod(hash(value), 4) = {i}")) for i in range(4)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    merged = stats.merge_moments(whole)
    assert sorted(r.band for r in merged.collect()) == [0, 1, 2]
    for r in merged.collect():
        assert r.n == 1000 and r["mean"] == pytest.approx(statistics.fmean(real[r.band]), abs=1e-9)
        assert r.m2 == pytest.approx(statistics.pvariance(real[r.band]) * 1000, rel=1e-6)


def test_cut_off_write_is_never_read(spark, tmp_path, monkeypatch):
    path, calls = f"{tmp_path}/cache", []

    def build(n, fail=False):
        def run():
            calls.append(n)
            df = spark.range(n)
            return df.select(F.when(F.col("id") == n - 1, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("long").alias("id")) if fail else df

        return run

    with pytest.raises(Exception, match="killed"):
        io.cached(spark, build(1000, fail=True), path, params={"v": 1}).count()
    assert io.cached(spark, build(7), path, params={"v": 1}).count() == 7
    # whole data without a marker, as after a kill between the two steps
    spark.range(99).write.parquet(f"{path}/{io.fingerprint(spark, (), {'v': 2})}-lost")
    assert io.cached(spark, build(8), path, params={"v": 2}).count() == 8
    assert io.cached(spark, build(9), path, params={"v": 1}).count() == 7
    assert io.cached(spark, build(9), path, refresh=True, params={"v": 1}).count() == 9
    assert calls == [1000, 7, 8, 9]


def test_changed_input_is_built_anew(spark, tmp_path):
    src, path = f"{tmp_path}/src", f"{tmp_path}/cache"
    spark.range(5).write.parquet(src)
    read = lambda: spark.read.parquet(src)
    assert io.cached(spark, read, path, inputs=[read()]).count() == 5
    assert io.cached(spark, lambda: read().where("false"), path, inputs=[read()]).count() == 5
    spark.range(3).write.mode("append").parquet(src)
    assert io.cached(spark, read, path, inputs=[read()]).count() == 8
