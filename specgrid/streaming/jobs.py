"""Incremental ingest, throughput windows, early stop, latest status and running band statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from specgrid.sources.io import exists, listing


def ingest_stream(spark: SparkSession, src: str, schema: str, dst: str, checkpoint: str, key: str = "granule_id"):
    """Every new granule once (T1): files seen before are skipped by the source, ids stored before by an anti-join.

    A batch has a folder of its own under the stream's id, written over when the
    batch runs again after a failure; ids are compared with those of other batches
    only, so a batch that was written but not committed comes out the same. Rows
    without an id are left out.
    """
    stream: list[str] = []

    def store(batch: DataFrame, number: int) -> None:
        if not stream:
            stream.append(json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if exists(spark, dst):
            others = spark.read.schema(f"{schema}, stream string, batch long").parquet(dst).where((F.col("stream") != stream[0]) | (F.col("batch") < number))
            new = new.join(others.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{dst}/stream={stream[0]}/batch={number}")

    return spark.readStream.schema(schema).parquet(src).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(df: DataFrame, dst: str, checkpoint: str):
    """Rows of a stream as files, each exactly once."""
    return df.writeStream.format("parquet").outputMode("append").option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(df: DataFrame, dst: str, checkpoint: str):
    """The whole result of a streaming aggregate after each batch; a batch that runs again writes the same folder again.

    ``read_latest`` reads the last whole one.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/batch={number}")

    return df.writeStream.foreachBatch(store).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, dst: str, schema: str) -> DataFrame:
    """Result after the last batch that ``latest_stream`` has written whole; no rows before the first."""
    done = listing(spark, dst, "_SUCCESS")
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{dst}/batch={max(int(f.rpartition('=')[2]) for f in done)}")


def throughput(events: DataFrame, delay: str = "10 seconds", width: str = "2 seconds") -> DataFrame:
    """Bytes of each worker in tumbling windows (T2), on a table or a stream.

    A stream counts a row unless its window ended at or before the latest time of
    all earlier batches less ``delay``; in append mode a window comes out, once,
    when the latest time less ``delay`` has reached its end.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    out = events.groupBy(F.window("ts", width).alias("w"), "worker").agg(F.sum("bytes").alias("total_bytes"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "worker", "total_bytes", "n")


def latest_status(events: DataFrame) -> DataFrame:
    """Last status of each worker (T4)."""
    return events.groupBy("worker").agg(F.max_by("status", F.struct("ts", "step")).alias("status"), F.max("ts").alias("ts"))


def band_stats(cells: DataFrame) -> DataFrame:
    """Sums by band (T5)."""
    return cells.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))


class EarlyStop(StatefulProcessor):
    """Best value of a run and rows since it, of packs of rows; rows not after the last one seen count as late and are left out."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "best double, since int, last long, stopped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, since, last, stopped = self.state.get() if self.state.exists() else (None, 0, -1, False)
        if stopped:
            return
        packs = pd.concat(list(rows))
        steps, metrics = np.concatenate(packs["step"].to_list()), np.concatenate(packs["metric"].to_list()).astype(float)
        order = np.argsort(steps, kind="stable")
        out = []
        for step, metric in zip(steps[order].tolist(), metrics[order].tolist(), strict=True):
            if step <= last:
                continue
            is_best = best is None or metric > best
            best, since, last = (metric, 0, step) if is_best else (best, since + 1, step)
            out.append((key[0], step, metric, best, is_best, since))
            if since >= self.patience:
                stopped = True
                break
        self.state.update((best, int(since), int(last), bool(stopped)))
        yield pd.DataFrame(out, columns=["run", "step", "metric", "best", "is_best", "since"])

    def close(self) -> None:
        pass


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a run and Arrow batch, its steps and metrics as arrays: the stateful operator takes its rows one by one, at a cost each."""
    for batch in batches:
        out = pa.Table.from_batches([batch]).group_by("run", use_threads=False).aggregate([("step", "list"), ("metric", "list")])
        yield from out.select(["run", "step_list", "metric_list"]).rename_columns(["run", "step", "metric"]).to_batches()


def early_stop_stream(log: DataFrame, patience: int) -> DataFrame:
    """Running best and early stop of each run as rows arrive (T3), every row once.

    A row whose step is not after the last one of its run in earlier batches is
    late and left out, so are rows after the stop. Needs the RocksDB state store.
    """
    rows = log.select(F.col("run").cast("long").alias("run"), F.col("step").cast("long").alias("step"), F.col("metric").cast("double").alias("metric"))
    return rows.mapInArrow(_packed, "run long, step array<long>, metric array<double>").groupBy("run").transformWithStateInPandas(
        EarlyStop(patience), outputStructType="run long, step long, metric double, best double, is_best boolean, since int", outputMode="Append", timeMode="None"
    )
