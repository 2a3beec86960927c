"""The standard tables re-dressed as sites, granules, predictions, logs, pixels, spectra and patches.

Each view exists as a DataFrame and as DuckDB SQL (``duck``), with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SITES = """c_custkey AS site_id,
 -34.6e0 + (c_custkey * 7919 % 10007) / 10007e0 * 1.6e0 AS lat,
 18.4e0 + (c_custkey * 104729 % 10009) / 10009e0 * 5e0 AS lon,
 CAST(floor(2e0 + (c_acctbal + 1000e0) / 11000e0 * 37e0) AS DOUBLE) AS richness"""
_GRANULES = """s_suppkey AS gid, concat('ang20231022t', lpad(CAST(s_suppkey % 24 AS VARCHAR(9)),2,'0'),
 lpad(CAST(s_suppkey % 60 AS VARCHAR(9)),2,'0'), lpad(CAST(s_suppkey * 7 % 60 AS VARCHAR(9)),2,'0'), '_',
 lpad(CAST(s_suppkey % 1000 AS VARCHAR(9)),3,'0'), '_L2B') AS granule_id,
 240000e0 + (s_suppkey * 7919 % 499) * 1000e0 AS origin_x, 30e0 AS pixel_w,
 6170000e0 + (s_suppkey * 104729 % 181) * 1000e0 AS origin_y, -30e0 AS pixel_h,
 600 + s_suppkey % 200 AS width, 600 + s_suppkey % 150 AS height"""
_PRED = """o_orderkey AS id, o_custkey % 97 AS flightline, o_custkey AS site_id,
 CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split,
 CAST(floor(2e0 + o_totalprice % 37e0) AS DOUBLE) AS actual,
 CAST(14e0 + 0.4e0 * floor(2e0 + o_totalprice % 37e0) + (o_orderkey % 11 - 5) AS DOUBLE) AS predicted"""
_LOG = """event_id AS step, CAST(floor(event_id / 100e0) AS BIGINT) AS epoch, user_id % 8 AS run, user_id % 4 AS worker, ts,
 event_type AS status, value AS metric, CAST(floor(value * 1000e0) AS BIGINT) AS bytes"""
_PLAIN = {"v_sites": ("customer", _SITES), "v_granules": ("supplier", _GRANULES), "v_pred": ("orders", _PRED), "v_log": ("events", _LOG)}

_DUCK = {k: f"SELECT {sql} FROM {t}" for k, (t, sql) in _PLAIN.items()} | {
    "v_pixels": """SELECT vec_id AS tile_id, CAST(floor((i-1) / 8e0) AS INT) AS y, CAST((i-1) % 8 AS INT) AS x,
 CAST(embedding[i] AS DOUBLE) AS value, label FROM embeddings, range(1, 65) t(i)""",
    "v_cells": """SELECT vec_id AS id, CAST(i - 1 AS INT) AS band, CAST(embedding[i] AS DOUBLE) AS value, label FROM embeddings, range(1, 65) t(i)""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of v_sites, v_granules, v_pred, v_log, v_pixels, v_cells, v_spectra."""
    if name in _PLAIN:
        base, sql = _PLAIN[name]
        return table(spark, sf, base).selectExpr(*_split(sql))
    vec = table(spark, sf, "embeddings")
    if name == "v_pixels":
        cells = vec.selectExpr("vec_id AS tile_id", "label", "posexplode(embedding) AS (pos, val)")
        return cells.selectExpr("tile_id", "CAST(floor(pos / 8e0) AS INT) AS y", "pos % 8 AS x", "CAST(val AS DOUBLE) AS value", "label")
    if name == "v_cells":
        return vec.selectExpr("vec_id AS id", "label", "posexplode(embedding) AS (band, val)").selectExpr("id", "band", "CAST(val AS DOUBLE) AS value", "label")
    if name == "v_spectra":
        return vec.selectExpr("vec_id AS id", "CAST(embedding AS ARRAY<DOUBLE>) AS s", "label")
    raise KeyError(name)


def _split(sql: str) -> list[str]:
    """Select list to single expressions: commas outside parentheses and quotes."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(sql):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif not quoted and c == "," and not depth:
            out.append(sql[at:i].strip())
            at = i + 1
    return [*out, sql[at:].strip()]


def duck(*names: str, more: str = "", recursive: bool = False) -> str:
    """``WITH`` clause of the views, and of further common tables in ``more``."""
    parts = [f"{n} AS ({_DUCK[n]})" for n in names] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
