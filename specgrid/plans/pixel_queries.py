"""Spectra, pixels, patches, tokens and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgrid.constants import GAPS_NM, linspace
from specgrid.functions import spectral as sx
from specgrid.operators import model as md
from specgrid.operators import order as od
from specgrid.operators import patch as pt
from specgrid.operators import stats as st
from specgrid.plans.registry import query
from specgrid.plans.views import duck, table, view
from specgrid.sources import io

AXIS = [400.0 + i * 2050.0 / 63.0 for i in range(64)]
GRID = linspace(400.0, 2450.0, 200)
CELLS, PIX = duck("v_cells"), duck("v_pixels")


def _spectra(spark, sf):
    return view(spark, sf, "v_spectra")


def _long(df, col="s", digits=8):
    """Arrays to rows (id, pos, value), rounded, for comparison."""
    return df.select("id", F.posexplode(col).alias("pos", "value")).select("id", "pos", F.round("value", digits).alias("value"))


def _arr(values):
    return "[" + ", ".join(repr(float(v)) + ("" if "e" in repr(float(v)) else "e0") for v in values) + "]"


def _select(expr: str, n: int, digits: int = 8) -> str:
    """Rows (id, pos, value) of an expression over embedding ``e`` (doubles) and 1-based position ``i``."""
    return f"SELECT vec_id AS id, CAST(i - 1 AS INT) AS pos, round({expr}, {digits}) AS value FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), range(1, {n + 1}) t(i)"


GOOD = [i for i in range(64) if i % 7 != 3]
BAD = [0, 1, 10, 11, 12, 63]


@query("x1_select_bands", _select(f"e[{[g + 1 for g in GOOD]}[i]]", len(GOOD)))
def x1_select_bands(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.select_bands(F.col("s"), GOOD).alias("s")))


@query("x2_drop_bands", _select(f"e[{[i + 1 for i in range(64) if i not in BAD]}[i]]", 58))
def x2_drop_bands(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.drop_bands(F.col("s"), BAD).alias("s")))


@query("x3_fit_bands", _select("CASE WHEN i <= 64 THEN e[i] ELSE 0e0 END", 70) + " UNION ALL " + _select("e[i]", 50).replace("vec_id AS id", "-vec_id - 1 AS id"))
def x3_fit_bands(spark, sf):
    s = _spectra(spark, sf)
    return _long(s.select("id", sx.fit_bands(F.col("s"), 70).alias("s"))).union(_long(s.select((-F.col("id") - 1).alias("id"), sx.fit_bands(F.col("s"), 50).alias("s"))))


@query("x4_pick_bands", _select("e[[61, 41, 21][i]]", 3))
def x4_pick_bands(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.pick_bands(F.col("s"), [60, 40, 20]).alias("s")))


def _holes(spark, sf):
    hole = lambda v, i: F.when((F.col("id") + i) % 17 == 0, -10000.0).otherwise(v)
    return _spectra(spark, sf).withColumn("s", F.transform("s", hole))


@query("x5_clean_values", _select("CASE WHEN (vec_id + i - 1) % 17 = 0 THEN 0e0 ELSE e[i] END", 64))
def x5_clean_values(spark, sf):
    return _long(_holes(spark, sf).select("id", sx.clean_values(F.col("s")).alias("s")))


@query("x6_adaptive_clip", _select("CASE WHEN list_max(e) * 60 > 20 THEN least(greatest(e[i] * 60, 0e0), 15000e0) ELSE least(greatest(e[i] * 60, 0e0), 1.5e0) END", 64))
def x6_adaptive_clip(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.adaptive_clip(F.transform("s", lambda v: v * 60)).alias("s")))


@query("x7_clip", _select("least(greatest(e[i], -0.1e0), 0.2e0)", 64))
def x7_clip(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.clip(F.col("s"), -0.1, 0.2).alias("s")))


# Place of the i-th of 200 wavelengths among the 64, both spread evenly over the same range.
_AT = "((i - 1) * 63e0 / 199e0)"
_RES = f"e[CAST(floor({_AT}) AS INT) + 1] * (1 - ({_AT} - floor({_AT}))) + e[least(CAST(floor({_AT}) AS INT) + 2, 64)] * ({_AT} - floor({_AT}))"


@query("x8_resample", _select(_RES, 200, 7))
def x8_resample(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.resample(F.col("s"), AXIS, GRID).alias("s")), digits=7)


_GAP = " OR ".join(f"{_arr(AXIS)}[i] BETWEEN {lo}e0 AND {hi}e0" for lo, hi in GAPS_NM)


@query("x9_mask_gaps", _select(f"CASE WHEN {_GAP} THEN 0e0 ELSE e[i] END", 64))
def x9_mask_gaps(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.mask_gaps(F.col("s"), AXIS).alias("s")))


def _stats_row(spark, sf):
    stats = st.band_stats(view(spark, sf, "v_cells"))
    rows = F.array_sort(F.collect_list(F.struct("band", "mean", "std")))
    return stats.agg(rows.alias("r")).select(F.transform("r", lambda x: x["mean"]).alias("mean"), F.transform("r", lambda x: x["std"]).alias("std"))


_STATS = CELLS[:-1] + ", st AS (SELECT band, avg(value) AS mean, greatest(stddev_pop(value), 1e-6) AS std, max(value) AS top FROM v_cells GROUP BY 1)\n"


@query("x10_standardize", _STATS + "SELECT id, band AS pos, round((value - mean) / std, 6) AS value FROM v_cells JOIN st USING (band)")
def x10_standardize(spark, sf):
    s = _spectra(spark, sf).crossJoin(F.broadcast(_stats_row(spark, sf)))
    return _long(s.select("id", sx.standardize(F.col("s"), F.col("mean"), F.col("std")).alias("s")), digits=6)


@query("x10_destandardize", CELLS + "SELECT id, band AS pos, round(value, 6) AS value FROM v_cells")
def x10_destandardize(spark, sf):
    s = _spectra(spark, sf).crossJoin(F.broadcast(_stats_row(spark, sf)))
    z = sx.standardize(F.col("s"), F.col("mean"), F.col("std"))
    return _long(s.select("id", sx.destandardize(z, F.col("mean"), F.col("std")).alias("s")), digits=6)


@query("x11_max_normalize", _STATS + "SELECT id, band AS pos, round(value / top, 7) AS value FROM v_cells JOIN st USING (band)")
def x11_max_normalize(spark, sf):
    tops = st.band_max(view(spark, sf, "v_cells")).agg(F.array_sort(F.collect_list(F.struct("band", "max_value"))).alias("r")).select(F.transform("r", lambda x: x["max_value"]).alias("tops"))
    return _long(_spectra(spark, sf).crossJoin(F.broadcast(tops)).select("id", sx.max_normalize(F.col("s"), F.col("tops")).alias("s")), digits=7)


@query("x23_block_means", _select("list_avg(e[(i - 1) * 10 + 1 : least(i * 10, 64)])", 7))
def x23_block_means(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.block_means(F.col("s"), 10).alias("s")))


@query("x24_linspace", _select("e[1] + 400e0 + (i - 1) * 2050e0 / 199", 200, 7))
def x24_linspace(spark, sf):
    line = F.zip_with(sx.linspace(400.0, 2450.0, 200), F.array_repeat(F.col("s")[0], 200), lambda a, b: a + b)
    return _long(_spectra(spark, sf).select("id", line.alias("s")), digits=7)


_WAVE = "round(CASE WHEN i % 8 < 4 THEN sin({v} / power(10000e0, i % 4 / 4e0)) ELSE cos({v} / power(10000e0, i % 4 / 4e0)) END, 8)"


@query("x25_sincos", PIX + f"SELECT tile_id AS id, y, x, i AS pos, CASE WHEN i < 8 THEN {_WAVE.format(v='x')} ELSE {_WAVE.format(v='y')} END AS value FROM v_pixels, (SELECT CAST(unnest(range(16)) AS INT) AS i)")
def x25_sincos(spark, sf):
    p = view(spark, sf, "v_pixels").select(F.col("tile_id").alias("id"), "y", "x", F.posexplode(sx.sincos_2d(F.col("y"), F.col("x"), 16)).alias("pos", "value"))
    return p.withColumn("value", F.round("value", 8))


@query("x25_sincos_rows", PIX + "SELECT tile_id AS id, y, x, i AS pos, round(CASE WHEN i < 12 THEN sin(y / power(10000e0, (i - 8) / 4e0)) ELSE cos(y / power(10000e0, (i - 12) / 4e0)) END, 8) AS value FROM v_pixels, (SELECT CAST(unnest(range(8, 16)) AS INT) AS i)")
def x25_sincos_rows(spark, sf):
    """The row half of ``x25_sincos``."""
    p = view(spark, sf, "v_pixels").select(F.col("tile_id").alias("id"), "y", "x", F.posexplode(sx.sincos_2d(F.col("y"), F.col("x"), 16)).alias("pos", "value"))
    return p.where("pos >= 8").withColumn("value", F.round("value", 8))


@query("f1_pipeline", _select("least(greatest(CASE WHEN i % 2 = 1 THEN e[i] * 2 ELSE 0e0 END, -0.2e0), 0.3e0)", 64))
def f1_pipeline(spark, sf):
    odd = lambda d: d.withColumn("s", F.transform("s", lambda v, i: F.when(i % 2 == 0, v * 2).otherwise(0.0)))
    return _long(sx.pipeline(_spectra(spark, sf), [odd, lambda d: d.withColumn("s", sx.clip(F.col("s"), -0.2, 0.3))]))


def _turn(name, index, turn):
    @query(name, _select(f"e[CAST({index} AS INT) + 1]", 64))
    def turned(spark, sf):
        return _long(_spectra(spark, sf).select("id", turn(F.col("s")).alias("s")))


# patches are 4 bands of 4 x 4, row-major; p = i - 1
_C, _Y, _X = "((i - 1) // 16)", "((i - 1) % 16 // 4)", "((i - 1) % 4)"
_turn("x13_rot90", f"{_C} * 16 + {_X} * 4 + 3 - {_Y}", lambda s: sx.rot90(s, 4, 4, 1))
_turn("x13_rot180", f"{_C} * 16 + (3 - {_Y}) * 4 + 3 - {_X}", lambda s: sx.rot90(s, 4, 4, 2))
_turn("x13_rot270", f"{_C} * 16 + (3 - {_X}) * 4 + {_Y}", lambda s: sx.rot90(s, 4, 4, 3))
_turn("x14_hflip", f"{_C} * 16 + {_Y} * 4 + 3 - {_X}", lambda s: sx.hflip(s, 4, 4))
_turn("x27_band_image_all", "i - 1", lambda s: F.concat(*[sx.band_image(s, b, 4, 4) for b in range(4)]))


@query("x28_spectrum_at", _select("e[(i - 1) * 16 + 2 * 4 + 1 + 1]", 4))
def x28_spectrum_at(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.spectrum_at(F.col("s"), 4, 4, 4, 2, 1).alias("s")))


@query("x27_band_image", _select("e[16 + i]", 16))
def x27_band_image(spark, sf):
    return _long(_spectra(spark, sf).select("id", sx.band_image(F.col("s"), 1, 4, 4).alias("s")))


_V = "CAST(('0x' || substr(md5(concat('42:', vec_id)), 1, 8)) AS BIGINT) % 8"
_ROT = f"""CASE v % 4 WHEN 0 THEN {_C} * 16 + {_Y} * 4 + xx WHEN 1 THEN {_C} * 16 + xx * 4 + 3 - {_Y} WHEN 2 THEN {_C} * 16 + (3 - {_Y}) * 4 + 3 - xx ELSE {_C} * 16 + (3 - xx) * 4 + {_Y} END"""


@query(
    "x15_augment",
    f"SELECT vec_id AS id, CAST(v AS INT) AS variant, CAST(i - 1 AS INT) AS pos, round(e[CAST({_ROT} AS INT) + 1], 8) AS value FROM (SELECT vec_id, v, e, i, CASE WHEN v >= 4 THEN 3 - (i - 1) % 4 ELSE (i - 1) % 4 END AS xx FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_V} AS v FROM embeddings), range(1, 65) t(i))",
)
def x15_augment(spark, sf):
    out = pt.augment(_spectra(spark, sf), "s", 4, 4)
    return out.select("id", "variant", F.posexplode("s").alias("pos", "value")).withColumn("value", F.round("value", 8))


_TOK = "SELECT vec_id AS id, CAST(c // 2 AS INT) AS spectral_group, CAST(y // 2 * 2 + x // 2 AS INT) AS spatial_idx, CAST(c % 2 * 4 + y % 2 * 2 + x % 2 AS INT) AS o, CAST(embedding[c * 16 + y * 4 + x + 1] AS DOUBLE) AS value FROM embeddings, range(4) a(c), range(4) b(y), range(4) d(x)"


def _tokens(spark, sf):
    return pt.tokenize(_spectra(spark, sf), "s", (4, 4, 4), (2, 2, 2))


@query("x16_tokenize", f"SELECT id, spectral_group, spatial_idx, o, round(value, 8) AS value FROM ({_TOK})")
def x16_tokenize(spark, sf):
    t = _tokens(spark, sf).select("id", "spectral_group", "spatial_idx", F.posexplode("token").alias("o", "value"))
    return t.withColumn("value", F.round("value", 8))


@query("x17_untokenize", _select("CASE WHEN (i - 1) // 32 = 0 AND (i - 1) % 16 // 8 = 0 AND (i - 1) % 4 // 2 = 0 THEN 9e0 ELSE e[i] END", 64))
def x17_untokenize(spark, sf):
    t = _tokens(spark, sf)
    new = t.where("spectral_group = 0 AND spatial_idx = 0").withColumn("token", F.transform("token", lambda _: F.lit(9.0)))
    return _long(pt.untokenize(t, (4, 4, 4), (2, 2, 2), overlay=new), "values")


def _masked(blocks, ratio, seed=42):
    k = int(blocks * ratio)
    return f"mk AS (SELECT id, block FROM (SELECT vec_id AS id, CAST(b AS INT) AS block, row_number() OVER (PARTITION BY vec_id ORDER BY md5(concat('{seed}:', vec_id, ':', b)), b) AS rn FROM embeddings, range({blocks}) t(b)) WHERE rn <= {k})"


def _ids(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))


@query("x20_block_mask", f"WITH {_masked(16, 0.6)} SELECT id, block FROM mk")
def x20_block_mask(spark, sf):
    return pt.block_mask(_ids(spark, sf), 16, 0.6)


@query("x21_token_mask", f"WITH {_masked(8, 0.75, 7)} SELECT id, block FROM mk")
def x21_token_mask(spark, sf):
    return pt.block_mask(_ids(spark, sf), 8, 0.75, seed=7)


@query("x22_apply_mask", f"WITH {_masked(4, 0.5)} SELECT t.id, spectral_group, spatial_idx, block IS NOT NULL AS masked, o, round(CASE WHEN block IS NOT NULL THEN -1e0 ELSE value END, 8) AS value FROM ({_TOK}) t LEFT JOIN mk ON mk.id = t.id AND block = spatial_idx")
def x22_apply_mask(spark, sf):
    out = pt.apply_mask(_tokens(spark, sf), pt.block_mask(_ids(spark, sf), 4, 0.5), -1.0)
    return out.select("id", "spectral_group", "spatial_idx", "masked", F.posexplode("token").alias("o", "value")).withColumn("value", F.round("value", 8))


def _error(kind):
    expr = "avg(abs(value * 0.1e0))" if kind == "l1" else "sum((value * 0.1e0) ** 2) / (count(*) + 1e-8)"

    @query(f"a16_masked_{kind}", f"WITH {_masked(4, 0.5)} SELECT round({expr}, 9) AS error FROM ({_TOK}) t JOIN mk ON mk.id = t.id AND block = spatial_idx")
    def masked(spark, sf):
        t = _tokens(spark, sf)
        recon = t.withColumn("token", F.transform("token", lambda v: v * 0.9))
        return pt.masked_error(t, recon, pt.block_mask(_ids(spark, sf), 4, 0.5), kind).withColumn("error", F.round("error", 9))


_error("l1")
_error("mse")


@query("a1_band_stats", CELLS + "SELECT band, count(*) AS n, round(avg(value), 8) AS mean, round(greatest(stddev_pop(value), 1e-6), 7) AS std FROM v_cells GROUP BY 1")
def a1_band_stats(spark, sf):
    return st.band_stats(view(spark, sf, "v_cells")).select("band", "n", F.round("mean", 8).alias("mean"), F.round("std", 7).alias("std"))


@query("a1_band_stats_positive", CELLS + "SELECT band, count(*) AS n, round(avg(value), 8) AS mean, round(greatest(stddev_pop(value), 1e-6), 7) AS std FROM v_cells WHERE value > 0 GROUP BY 1")
def a1_band_stats_positive(spark, sf):
    return st.band_stats(view(spark, sf, "v_cells"), "positive").select("band", "n", F.round("mean", 8).alias("mean"), F.round("std", 7).alias("std"))


@query("a20_band_max", CELLS + "SELECT band, max(value) AS max_value FROM v_cells GROUP BY 1")
def a20_band_max(spark, sf):
    return st.band_max(view(spark, sf, "v_cells"))


@query("m10_site_features", CELLS + "SELECT id, band AS pos, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std FROM (SELECT id, CAST(band // 16 AS INT) AS band, value FROM v_cells) GROUP BY 1, 2")
def m10_site_features(spark, sf):
    cells = view(spark, sf, "v_cells").withColumn("band", F.floor(F.col("band") / 16).cast("int"))
    both = md.site_features(cells).select("id", F.posexplode(F.arrays_zip("means", "stds")).alias("pos", "p"))
    return both.select("id", "pos", F.round("p.means", 8).alias("mean"), F.round("p.stds", 8).alias("std"))


@query(
    "a9_stretch",
    CELLS[:-1] + ", q AS (SELECT id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM v_cells GROUP BY 1)\nSELECT id, band, CAST(CASE WHEN hi - lo < 1e-6 THEN 0 ELSE floor(round(least(greatest((value - lo) / (hi - lo), 0e0), 1e0) * 255, 6)) END AS INT) AS u8 FROM v_cells JOIN q USING (id)",
)
def a9_stretch(spark, sf):
    return st.stretch(view(spark, sf, "v_cells"), ["id"]).select("id", "band", F.col("u8").cast("int").alias("u8"))


@query("a2_downsample", PIX + "SELECT tile_id, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, round(avg(value), 8) AS value FROM v_pixels WHERE y < 6 AND x < 6 GROUP BY 1, 2, 3")
def a2_downsample(spark, sf):
    return pt.downsample(view(spark, sf, "v_pixels"), 3, 8).withColumn("value", F.round("value", 8))


@query("a15_pool_mean", PIX + "SELECT tile_id, round(avg(value), 8) AS pooled FROM v_pixels GROUP BY 1")
def a15_pool_mean(spark, sf):
    return pt.pool_mean(view(spark, sf, "v_pixels")).withColumn("pooled", F.round("pooled", 8))


def _patches(name, before, after):
    sql = PIX + f"""SELECT m.vec_id AS site_id, p.tile_id, round(sum(p.value * ((p.y - m.vec_id % 8 + {before}) * 10 + (p.x - m.vec_id % 5 + {before}) + 1)), 6) AS probe FROM embeddings m JOIN v_pixels p
ON p.tile_id = m.vec_id AND p.y >= m.vec_id % 8 - {before} AND p.y < m.vec_id % 8 + {after} AND p.x >= m.vec_id % 5 - {before} AND p.x < m.vec_id % 5 + {after} GROUP BY 1, 2 HAVING count(*) = {(before + after) ** 2}"""

    @query(name, sql)
    def patches(spark, sf):
        return patch_probe(pt.extract_patches(site_pixels(spark, sf), view(spark, sf, "v_pixels"), before, after), before + after)


def site_pixels(spark, sf):
    """A site in each tile, at a pixel that depends on its id."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("site_id"), F.col("vec_id").alias("tile_id"), (F.col("vec_id") % 8).cast("int").alias("y_idx"), (F.col("vec_id") % 5).cast("int").alias("x_idx"))


def patch_probe(patches, n):
    """One number of each patch that depends on all values and their places."""
    probe = F.aggregate(F.transform("values", lambda v, i: v * (F.floor(i / n) * 10 + i % n + 1)), F.lit(0.0), lambda s, v: s + v)
    return patches.select("site_id", "tile_id", F.round(probe, 6).alias("probe"))


_patches("j3_extract_patches", 2, 2)
_patches("j4_centered_patches", 1, 2)


@query("x18_tile", PIX + "SELECT tile_id, CAST(y // 3 AS INT) AS tile_y, CAST(x // 3 AS INT) AS tile_x, count(*) AS n, round(sum(value), 7) AS total FROM v_pixels WHERE y < 6 AND x < 6 GROUP BY 1, 2, 3")
def x18_tile(spark, sf):
    t = pt.tile(view(spark, sf, "v_pixels"), 3, 8)
    return t.groupBy("tile_id", "tile_y", "tile_x").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 7).alias("total"))


@query("x19_center_label", PIX + "SELECT tile_id, CAST(y // 3 AS INT) AS tile_y, CAST(x // 3 AS INT) AS tile_x, value FROM v_pixels WHERE y < 6 AND x < 6 AND y % 3 = 1 AND x % 3 = 1")
def x19_center_label(spark, sf):
    return pt.center_label(pt.tile(view(spark, sf, "v_pixels"), 3, 8), 3).select("tile_id", "tile_y", "tile_x", "value")


@query("w4_class_quota", PIX + "SELECT label, tile_id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tile_id, y, x) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tile_id, y, x) AS rn FROM v_pixels) WHERE rn > 30 AND x > 1 AND x < 7 AND y > 1 AND y < 7) WHERE rk <= 20")
def w4_class_quota(spark, sf):
    return pt.class_quota(view(spark, sf, "v_pixels"), 20, 30, "label", ["tile_id", "y", "x"], 1, 8).select("label", "tile_id", "y", "x")


_DRAW = "CAST(('0x' || substr(md5(concat('42:{0}:', vec_id, ':', a)), 1, 8)) AS BIGINT) % 5"
_SAMPLED = PIX[:-1] + f""", c AS (SELECT vec_id AS tile_id, CAST(a AS INT) AS attempt, CAST({_DRAW.format('y')} AS INT) AS y0, CAST({_DRAW.format('x')} AS INT) AS x0 FROM embeddings, range(20) t(a)),
f AS (SELECT c.tile_id, attempt, y0, x0 FROM c JOIN v_pixels p ON p.tile_id = c.tile_id AND p.value > 0 AND ((p.y - y0 IN (0, 3) AND p.x - x0 IN (0, 3)) OR (p.y - y0 = 2 AND p.x - x0 = 2)) GROUP BY ALL HAVING count(*) = 5),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY attempt) AS rn FROM f) WHERE rn <= 2)\n"""


def _sampled(spark, sf):
    return pt.sample_patches(view(spark, sf, "v_pixels"), 2, 20, 8, 4)


@query("w5_sample_patches", _SAMPLED + "SELECT tile_id, attempt, y0, x0 FROM s")
def w5_sample_patches(spark, sf):
    return _sampled(spark, sf)


@query("a19_patch_quota", _SAMPLED + "SELECT vec_id AS tile_id, count(s.attempt) AS found, count(s.attempt) < 2 AS is_short FROM embeddings LEFT JOIN s ON s.tile_id = vec_id GROUP BY 1")
def a19_patch_quota(spark, sf):
    return pt.patch_quota_report(_sampled(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile_id")), 2)


@query("w10_center_masked", PIX + "SELECT tile_id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY (y - 3.5e0) ** 2 + (x - 3.5e0) ** 2, y, x) AS rn FROM v_pixels WHERE value > 0.1e0) WHERE rn = 1")
def w10_center_masked(spark, sf):
    return pt.center_masked(view(spark, sf, "v_pixels").where("value > 0.1"), 8)


# Taps of 16 places among 8, half-pixel centres: the cubic kernel with a = -0.75 over the four nearest, clamped to the edges.
_TAPS = """c AS (SELECT i, (i + 0.5e0) * 8 / 16 - 0.5e0 AS c FROM range(16) r(i)), t AS (SELECT i, floor(c) + o AS j, abs(c - floor(c) - o) AS d FROM c, range(-1, 3) s(o)),
w AS (SELECT i, CAST(least(greatest(j, 0), 7) AS INT) AS s, CASE WHEN d <= 1 THEN 1.25e0 * d ** 3 - 2.25e0 * d ** 2 + 1 WHEN d < 2 THEN -0.75e0 * d ** 3 + 3.75e0 * d ** 2 - 6 * d + 3 ELSE 0e0 END AS w FROM t)"""


@query("x26_resize_grid", PIX[:-1] + f", {_TAPS}\nSELECT tile_id, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, round(sum(value * a.w * b.w), 7) AS value FROM v_pixels p JOIN w a ON a.s = p.y JOIN w b ON b.s = p.x GROUP BY 1, 2, 3")
def x26_resize_grid(spark, sf):
    return pt.resize_grid(view(spark, sf, "v_pixels").drop("label"), 8, 16).withColumn("value", F.round("value", 7))


@query("p15_drop_empty", "SELECT vec_id AS id FROM embeddings WHERE len(list_filter(embedding[17:32], lambda v: v < 0)) / 16e0 <= 0.5e0")
def p15_drop_empty(spark, sf):
    s = _spectra(spark, sf).withColumn("s", F.transform("s", lambda v: F.greatest(v, F.lit(0.0))))
    return pt.drop_empty(s, "s", 1, 4, 4).select("id")


_MEANS = "SELECT vec_id AS id, CAST(i - 1 AS INT) AS block, list_avg(CAST(embedding AS DOUBLE[])[(i - 1) * 10 + 1 : least(i * 10, 64)]) AS value FROM embeddings, range(1, 8) t(i)"


@query("j10_nearest_block", f"WITH m AS ({_MEANS}), r AS (SELECT block AS rb, value AS rv FROM m WHERE id = 0) SELECT id, block, CAST(arg_min(rb, abs(rv - value) * 1000000 + rb * 1e-9) AS INT) AS nearest FROM m, r GROUP BY 1, 2")
def j10_nearest_block(spark, sf):
    m = _spectra(spark, sf).select("id", sx.block_means(F.col("s"), 10).alias("means"))
    blocks = m.select("id", F.posexplode("means").alias("block", "value"))
    return pt.nearest_block(blocks, m.where("id = 0")).select("id", "block", "nearest")


@query("s14_pixel_locations", PIX + "SELECT label AS class, CAST(row_number() OVER (PARTITION BY label ORDER BY tile_id, y, x) - 1 AS INT) AS ord, tile_id, y, x FROM v_pixels WHERE value > 0.2e0")
def s14_pixel_locations(spark, sf):
    p = view(spark, sf, "v_pixels").where("value > 0.2").select(F.col("label").alias("class"), "tile_id", "y", "x")
    ranked = od.rank_within(p, "class", "tile_id", "y", "x")
    return ranked.select("class", (F.col("rank") - 1).cast("int").alias("ord"), "tile_id", "y", "x")


@query("s16_describe_source", "SELECT count(*) AS n_rows, min(len(embedding)) AS min_bands, max(len(embedding)) AS max_bands, 'id:bigint, s:array<double>, label:int' AS fields FROM embeddings")
def s16_describe_source(spark, sf):
    out = io.describe_source(_spectra(spark, sf), "s")
    return out.withColumns({c: F.col(c).cast("long") for c in ("min_bands", "max_bands")})


@query(
    "s11_pack_metadata",
    "SELECT CAST(i - 1 AS INT) AS pos, round(400e0 + (i - 1) * 2050e0 / 63e0, 6) AS wavelength, CAST(64 AS BIGINT) AS bands, CAST(4 AS BIGINT) AS height, CAST(4 AS BIGINT) AS width, (SELECT count(DISTINCT vec_id) FROM embeddings) AS count, round(sum(CAST(embedding[i] AS DOUBLE)), 6) AS total FROM embeddings, range(1, 65) t(i) GROUP BY i",
)
def s11_pack_metadata(spark, sf):
    """A pack written and read back: one row a band, with the sum of its values over all patches."""
    path = io.work_dir(spark, "pack")
    io.export_pack(_spectra(spark, sf), AXIS, path, 4, 4)
    told = spark.read.json(f"{path}/metadata").select("bands", "count", "height", "width", F.posexplode("wavelengths").alias("pos", "wavelength"))
    sums = spark.read.parquet(f"{path}/patches").select(F.posexplode("s").alias("pos", "v")).groupBy("pos").agg(F.round(F.sum("v"), 6).alias("total"))
    return told.withColumn("wavelength", F.round("wavelength", 6)).join(sums, "pos")


@query("s14_read_locations", PIX + "SELECT tile_id AS class, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY y, x) - 1 AS INT) AS ord, y, x FROM v_pixels WHERE value > 0.2e0")
def s14_read_locations(spark, sf):
    """Lists of places by tile, written and read back one row a place."""
    path = io.work_dir(spark, "locations")
    places = F.sort_array(F.collect_list(F.struct("y", "x"))).alias("locations")  # a tile has 64 places
    view(spark, sf, "v_pixels").where("value > 0.2").groupBy(F.col("tile_id").alias("class")).agg(places).write.parquet(path)
    return io.read_pixel_locations(spark, path)


@query("t5_band_sums", CELLS + "SELECT band, count(*) AS n, round(sum(value), 6) AS s, round(sum(value * value), 6) AS q FROM v_cells GROUP BY 1")
def t5_band_sums(spark, sf):
    from specgrid.streaming.jobs import band_stats

    return band_stats(view(spark, sf, "v_cells")).select("band", "n", F.round("s", 6).alias("s"), F.round("q", 6).alias("q"))
