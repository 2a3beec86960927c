"""Functions over ``ARRAY<DOUBLE>`` spectra with higher-order functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrid.constants import GAPS_NM


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def select_bands(col: Column, good: Sequence[int]) -> Column:
    """Bands at the given indices, in that order."""
    return F.transform(literal([int(g) for g in good]), lambda i: F.get(col, i))


pick_bands = select_bands


def drop_bands(col: Column, bad: Sequence[int]) -> Column:
    """All bands but those at the given indices."""
    gone = literal([int(b) for b in bad])
    return F.filter(col, lambda v, i: ~F.array_contains(gone, i))


def fit_bands(col: Column, n: int) -> Column:
    """First ``n`` bands, filled up with zeros."""
    return F.slice(F.concat(col, F.array_repeat(F.lit(0.0), n)), 1, n)


def clean_values(col: Column, threshold: float | None = -9000.0) -> Column:
    """Null, NaN, infinite and NoData values as 0."""

    def one(v: Column) -> Column:
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        return F.when(bad if threshold is None else bad | (v <= threshold), 0.0).otherwise(v)

    return F.transform(col, one)


def clip(col: Column, low: float, high: float) -> Column:
    """Values between two bounds."""
    return F.transform(col, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def adaptive_clip(col: Column) -> Column:
    """Integer-scaled spectra to 0..15000, reflectances to 0..1.5."""
    return F.when(F.array_max(col) > 20, clip(col, 0.0, 15000.0)).otherwise(clip(col, 0.0, 1.5))


def resample_weights(source: Sequence[float], target: Sequence[float]) -> list[tuple[int, float]]:
    """For each target position the left source index and the right neighbour's weight; -1 outside."""
    out = []
    for g in target:
        if g < source[0] or g > source[-1]:
            out.append((-1, 0.0))
            continue
        i = 0
        while i < len(source) - 2 and source[i + 1] < g:
            i += 1
        out.append((i, (g - source[i]) / (source[i + 1] - source[i])))
    return out


def resample(col: Column, source: Sequence[float], target: Sequence[float]) -> Column:
    """Linear interpolation onto another axis, 0 outside the source's range.

    The weights depend on the two axes alone and enter the plan as literals.
    """
    w = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in resample_weights(source, target)])
    one = lambda p: F.when(p["i"] < 0, 0.0).otherwise(F.get(col, p["i"]) * (1 - p["f"]) + F.get(col, p["i"] + 1) * p["f"])
    return F.transform(w, one)


def mask_gaps(col: Column, axis: Sequence[float], gaps: Sequence[tuple[float, float]] = GAPS_NM) -> Column:
    """Values inside absorption gaps as 0."""
    gone = literal([any(lo <= g <= hi for lo, hi in gaps) for g in axis])
    return F.transform(col, lambda v, i: F.when(F.get(gone, i), 0.0).otherwise(v))


def standardize(col: Column, mean: Column, std: Column) -> Column:
    """(v - mean) / std by band."""
    return F.zip_with(F.zip_with(col, mean, lambda v, m: v - m), std, lambda v, s: v / s)


def destandardize(col: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(col, std, lambda v, s: v * s), mean, lambda v, m: v + m)


def max_normalize(col: Column, maxs: Column) -> Column:
    """v / max by band (X11)."""
    return F.zip_with(col, maxs, lambda v, m: v / m)


def block_means(col: Column, depth: int) -> Column:
    """Mean of every ``depth`` values, the last block may be shorter."""
    starts = F.sequence(F.lit(0), F.size(col) - 1, F.lit(depth))

    def one(i: Column) -> Column:
        part = F.slice(col, i + 1, depth)
        return F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / F.size(part)

    return F.transform(starts, one)


def linspace(start: float, stop: float, n: int) -> Column:
    """Evenly spaced axis."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(start) + i * F.lit(stop - start) / F.lit(n - 1))


def sincos_features(pos: Column, dim: int) -> Column:
    """Sines, then cosines, of a position at ``dim / 2`` frequencies."""
    half = F.sequence(F.lit(0), F.lit(dim // 2 - 1))
    angle = lambda i: pos / F.pow(F.lit(10000.0), i / F.lit(dim / 2))
    return F.concat(F.transform(half, lambda i: F.sin(angle(i))), F.transform(half, lambda i: F.cos(angle(i))))


def sincos_2d(row: Column, col: Column, dim: int) -> Column:
    """Column features first, then row features."""
    return F.concat(sincos_features(col, dim // 2), sincos_features(row, dim // 2))


def rot90(values: Column, h: int, w: int, k: int) -> Column:
    """Quarter turns counter-clockwise of each band of a row-major patch."""
    k %= 4
    n = h * w
    oh, ow = (w, h) if k % 2 else (h, w)

    def source(i: Column) -> Column:
        c, r, x = F.floor(i / n), F.floor(i % n / ow), i % ow
        y0, x0 = {0: (r, x), 1: (x, w - 1 - r), 2: (h - 1 - r, w - 1 - x), 3: (h - 1 - x, r)}[k]
        return (c * n + y0 * w + x0).cast("int")

    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, source(i)))


def hflip(values: Column, h: int, w: int) -> Column:
    """Mirror image of each band."""
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, i - i % w + (w - 1 - i % w)))


def band_image(values: Column, band: int, h: int, w: int) -> Column:
    """One band of a patch."""
    return F.slice(values, band * h * w + 1, h * w)


def spectrum_at(values: Column, c: int, h: int, w: int, y: int, x: int) -> Column:
    """All bands at one pixel."""
    return F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda i: F.get(values, (i * h + y) * w + x))


def pipeline(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Steps one after the other (F1)."""
    for step in steps:
        df = df.transform(step)
    return df
