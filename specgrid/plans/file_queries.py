"""Queries that write files and read them back, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrid.operators import patch as pt
from specgrid.plans.pixel_queries import patch_probe, site_pixels
from specgrid.plans.registry import QUERIES, SQL, query
from specgrid.plans.views import duck, table, view
from specgrid.sources import io
from specgrid.streaming.jobs import ingest_stream


@query("s5_read_inventory", "SELECT trim(concat('  g', l_partkey, ' ')) AS native_id FROM lineitem WHERE l_linenumber % 3 <> 0")
def s5_read_inventory(spark, sf):
    path = io.work_dir(spark, "inventory")
    line = F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat(F.lit("  g"), F.col("l_partkey"), F.lit(" ")))
    table(spark, sf, "lineitem").select(line).write.text(path)
    return io.read_inventory(spark, path)


@query("s6_write_inventory", "SELECT DISTINCT concat('g', l_partkey) AS native_id FROM lineitem")
def s6_write_inventory(spark, sf):
    path = io.work_dir(spark, "inventory")
    io.write_inventory(table(spark, sf, "lineitem").select(F.concat(F.lit("g"), F.col("l_partkey")).alias("native_id")), path)
    return io.read_inventory(spark, path)


@query("s7_mapping_cache", duck("v_sites") + "SELECT site_id, lat, lon FROM v_sites")
def s7_mapping_cache(spark, sf):
    path, sites = io.work_dir(spark, "mapping"), view(spark, sf, "v_sites")
    build = lambda: sites.select("site_id", "lat", "lon")
    io.cached(spark, build, path, inputs=[sites], params={"patch": 16})
    return io.cached(spark, lambda: build().where("false"), path, inputs=[sites], params={"patch": 16})  # reads what the first one stored


@query("s8_band_stats_cache", SQL["a1_band_stats"])
def s8_band_stats_cache(spark, sf):
    return io.cached(spark, lambda: QUERIES["a1_band_stats"](spark, sf), io.work_dir(spark, "band-stats"), inputs=[table(spark, sf, "embeddings")])


@query("s9_write_report", duck("v_pred") + "SELECT id, split, actual, predicted FROM v_pred")
def s9_write_report(spark, sf):
    path = io.work_dir(spark, "report")
    io.write_report(view(spark, sf, "v_pred").select("id", "split", "actual", "predicted"), path)
    return spark.read.option("header", True).schema("id long, split string, actual double, predicted double").csv(path)


def _cube(spark, sf) -> str:
    path = io.work_dir(spark, "cube")
    io.write_cube(view(spark, sf, "v_pixels").select((F.col("tile_id") % 8).alias("granule_id"), "tile_id", "y", "x", "value"), path, side=4)
    return path


@query("s15_write_cube", duck("v_pixels") + "SELECT CAST(tile_id % 8 AS INT) AS granule_id, tile_id, y, x, value FROM v_pixels")
def s15_write_cube(spark, sf):
    return spark.read.parquet(_cube(spark, sf)).select("granule_id", "tile_id", "y", "x", "value")


@query("j3_cube_windows", SQL["j3_extract_patches"])
def j3_cube_windows(spark, sf):
    cube = spark.read.parquet(_cube(spark, sf))
    m = site_pixels(spark, sf).withColumn("granule_id", (F.col("tile_id") % 8).cast("int"))
    return patch_probe(pt.cube_windows(cube, 4, m, 2, 2, ("granule_id", "tile_id")), 4)


@query("s2_list_granules", "SELECT CAST(vec_id % 8 AS INT) AS granule_id, CAST(4 AS BIGINT) AS n_files FROM embeddings GROUP BY 1")
def s2_list_granules(spark, sf):
    files = io.list_granules(spark, [_cube(spark, sf)], ".parquet")
    granule = F.regexp_extract("path", r"granule_id=([0-9]+)/", 1).cast("int").alias("granule_id")
    return files.groupBy(granule).agg(F.count(F.lit(1)).alias("n_files"))


@query("t1_ingest", "SELECT DISTINCT l_orderkey AS granule_id FROM lineitem")
def t1_ingest(spark, sf):
    src, dst, at = (io.work_dir(spark, f"ingest-{x}") for x in ("src", "dst", "at"))
    for line in (1, 2):  # the second batch of files brings ids that are stored already
        table(spark, sf, "lineitem").where(f"l_linenumber % 2 = {line - 1}").select(F.col("l_orderkey").alias("granule_id")).write.mode("append").parquet(src)
        ingest_stream(spark, src, "granule_id long", dst, at).awaitTermination()
    return spark.read.schema("granule_id long").parquet(dst).select("granule_id")
