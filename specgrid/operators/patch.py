"""Patches, tokens, masks and tiles of pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.functions import geo
from specgrid.functions.spectral import hflip, rot90
from specgrid.operators.inventory import seeded

#: Cells of a task that resizes tiles.
RESIZED = 100_000


def downsample(pixels: DataFrame, factor: int, size: int, keys: Sequence[str] = ("tile_id",), nodata: float | None = None) -> DataFrame:
    """Mean of ``factor`` x ``factor`` blocks, remainder rows and columns cropped (A2)."""
    edge = size - size % factor
    value = F.col("value") if nodata is None else F.when(F.col("value") > nodata, F.col("value"))
    inside = pixels.where((F.col("y") < edge) & (F.col("x") < edge))
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return inside.groupBy(*keys, at("y"), at("x")).agg(F.avg(value).alias("value"))


def _block(v: Column, side: int) -> Column:
    return F.floor(v / side).cast("int")


def window_blocks(mapping: DataFrame, before: int, after: int, side: int) -> DataFrame:
    """Mapped pixels with each block ``by, bx`` of ``side`` pixels that their window touches: at most four where it is not wider than a block."""
    span = lambda c: F.sequence(_block(F.col(c) - before, side), _block(F.col(c) + after - 1, side))
    return mapping.withColumn("by", F.explode(span("y_idx"))).withColumn("bx", F.explode(span("x_idx")))


def _windows(met: DataFrame, before: int, after: int, keys: Sequence[str]) -> DataFrame:
    """Whole windows from pixels that met a site in one of its blocks."""
    off = {"dy": F.col("y") - F.col("y_idx"), "dx": F.col("x") - F.col("x_idx")}
    got = met.withColumns(off).where(F.col("dy").between(-before, after - 1) & F.col("dx").between(-before, after - 1))
    cells = F.array_sort(F.collect_list(F.struct("dy", "dx", "value")))
    out = got.groupBy("site_id", *keys, "y_idx", "x_idx").agg(cells.alias("cells"))
    n = before + after
    return out.where(F.size("cells") == n * n).select("site_id", *keys, F.transform("cells", lambda c: c["value"]).alias("values"))


def extract_patches(mapping: DataFrame, pixels: DataFrame, before: int, after: int, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Window ``[y - before, y + after) x [x - before, x + after)`` around each mapped pixel (J3, J4), from any table of pixels.

    A window is listed under the blocks, as wide as itself, that it touches, four
    at most; pixels meet it by an equi-join on their block. Windows that miss a
    pixel are dropped. For a stored cube ``cube_windows`` reads less.
    """
    side = before + after
    want = window_blocks(mapping, before, after, side)
    have = pixels.select(*keys, "y", "x", "value", _block(F.col("y"), side).alias("by"), _block(F.col("x"), side).alias("bx"))
    return _windows(want.join(have, [*keys, "by", "bx"]), before, after, keys)


#: Windows up to here may be sent to all executors; their rows are a few numbers each.
SENT_WINDOWS = 200_000
#: Ranges of codes that a scan is given.
CODE_RANGES = 32


def code_ranges(codes: Sequence[int], width: int, most: int = CODE_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover ``[c * width, (c + 1) * width)`` of all codes; the smallest gaps are closed first."""
    cells = sorted(set(codes))
    gaps = sorted((b - a for a, b in zip(cells, cells[1:], strict=False)), reverse=True)
    least = max(gaps[most - 1] if len(gaps) >= most else 1, 1)
    out: list[tuple[int, int]] = []
    for c in cells:
        if out and c * width - out[-1][1] < least * width:
            out[-1] = (out[-1][0], (c + 1) * width)
        else:
            out.append((c * width, (c + 1) * width))
    return out


def cube_windows(cube: DataFrame, side: int, mapping: DataFrame, before: int, after: int, keys: Sequence[str] = ("granule_id",)) -> DataFrame:
    """The windows of ``extract_patches`` from a cube written with blocks of ``side`` pixels.

    Pixels lie in folders of granule and block and, inside, along the Z-order
    curve. Windows meet them by granule and block, both of them folders: while the
    windows are few enough to be sent to all executors (counted first), folders
    without windows are pruned at run time and pixels are not shuffled, only those
    inside windows are, to put these together. Beyond that both sides are shuffled
    by block. Within the files, the windows' places of a fine grid, of which an
    image has a bounded number, become a few ranges of codes, which skip row groups.
    """
    want = window_blocks(mapping, before, after, side).where("by >= 0 AND bx >= 0")
    want = want.withColumn("block", geo.morton(F.col("by"), F.col("bx"))).drop("by", "bx")
    fine = 1 << max(0, (before + after - 1).bit_length())
    places = window_blocks(mapping, before, after, fine).where("by >= 0 AND bx >= 0").select(geo.morton(F.col("by"), F.col("bx")).alias("c")).distinct()
    ranges = code_ranges([r.c for r in places.collect()], fine * fine)  # bounded by the size of an image
    near = F.lit(False)
    for lo, hi in ranges:
        near = near | ((F.col("code") >= lo) & (F.col("code") < hi))
    if want.limit(SENT_WINDOWS + 1).count() <= SENT_WINDOWS:
        want = F.broadcast(want)
    have = cube.where(near).select(*keys, "block", "y", "x", "value")
    return _windows(have.join(want, [*keys, "block"]), before, after, keys)


def pair_pixels(pred: DataFrame, label: DataFrame, keys: Sequence[str], ignore: int = -1) -> DataFrame:
    """Predictions with their labels, invalid labels left out."""
    return pred.join(label.where(F.col("label") != ignore), list(keys))


def tile(pixels: DataFrame, size: int, extent: int) -> DataFrame:
    """Non-overlapping tiles, the border cropped."""
    edge = extent - extent % size
    inside = pixels.where((F.col("y") < edge) & (F.col("x") < edge))
    div = lambda c: F.floor(F.col(c) / size).cast("int")
    return inside.withColumns({"tile_y": div("y"), "tile_x": div("x"), "y": (F.col("y") % size).cast("int"), "x": (F.col("x") % size).cast("int")})


def center_label(tiles: DataFrame, size: int) -> DataFrame:
    """Pixel in the middle of each tile."""
    return tiles.where((F.col("y") == size // 2) & (F.col("x") == size // 2))


def tokenize(patches: DataFrame, values: str, shape: tuple[int, int, int], p: tuple[int, int, int], key: str = "id") -> DataFrame:
    """Blocks ``(c p0)(h p1)(w p2) -> c, (h w), (p0 p1 p2)``, one row a token (X16); index arithmetic, no shuffle."""
    (_, h, w), (p0, p1, p2) = shape, p
    groups, ch, cw = shape[0] // p0, h // p1, w // p2

    def at(g: Column, s: Column, o: Column) -> Column:
        c = g * p0 + F.floor(o / (p1 * p2))
        y = F.floor(s / cw) * p1 + F.floor(o % (p1 * p2) / p2)
        x = s % cw * p2 + o % p2
        return ((c * h + y) * w + x).cast("int")

    out = patches.select(key, values, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("spectral_group"))
    out = out.select(key, values, "spectral_group", F.explode(F.sequence(F.lit(0), F.lit(ch * cw - 1))).alias("spatial_idx"))
    offsets = F.sequence(F.lit(0), F.lit(p0 * p1 * p2 - 1))
    token = F.transform(offsets, lambda o: F.get(F.col(values), at(F.col("spectral_group"), F.col("spatial_idx"), o)))
    return out.select(key, "spectral_group", "spatial_idx", token.alias("token"))


def untokenize(tokens: DataFrame, shape: tuple[int, int, int], p: tuple[int, int, int], key: str = "id", overlay: DataFrame | None = None) -> DataFrame:
    """Patches back from tokens, some of them replaced by those in ``overlay``."""
    (_, h, w), (p0, p1, p2) = shape, p
    cw = w // p2
    if overlay is not None:
        new = overlay.select(key, "spectral_group", "spatial_idx", F.col("token").alias("_new"))
        tokens = tokens.join(new, [key, "spectral_group", "spatial_idx"], "left").withColumn("token", F.coalesce("_new", "token"))
    cells = tokens.select(key, "spectral_group", "spatial_idx", F.posexplode("token").alias("o", "v"))
    c = F.col("spectral_group") * p0 + F.floor(F.col("o") / (p1 * p2))
    y = F.floor(F.col("spatial_idx") / cw) * p1 + F.floor(F.col("o") % (p1 * p2) / p2)
    x = F.col("spatial_idx") % cw * p2 + F.col("o") % p2
    cells = cells.select(key, ((c * h + y) * w + x).alias("at"), "v")
    whole = F.array_sort(F.collect_list(F.struct("at", "v")))
    return cells.groupBy(key).agg(F.transform(whole, lambda s: s["v"]).alias("values"))


def block_mask(ids: DataFrame, blocks: int, ratio: float, seed: int = 42, key: str = "id") -> DataFrame:
    """``floor(ratio * blocks)`` blocks of each patch, at random but repeatably."""
    k = int(ratio * blocks)
    pick = lambda b: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), b.cast("string"))).alias("h"), b.alias("b"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), pick))
    return ids.select(key, F.explode(F.slice(F.transform(order, lambda s: s["b"]), 1, k)).alias("block"))


def apply_mask(tokens: DataFrame, mask: DataFrame, value: float, key: str = "id") -> DataFrame:
    """Tokens of masked places set to one value, over all spectral groups."""
    marks = mask.select(key, F.col("block").alias("spatial_idx"), F.lit(True).alias("masked"))
    out = tokens.join(marks, [key, "spatial_idx"], "left")
    masked = F.coalesce("masked", F.lit(False))
    return out.withColumns({"masked": masked, "token": F.when(masked, F.transform("token", lambda _: F.lit(value))).otherwise(F.col("token"))})


def masked_error(tokens: DataFrame, recon: DataFrame, mask: DataFrame, kind: str = "l1", key: str = "id") -> DataFrame:
    """Mean error over masked tokens only."""
    marks = mask.select(key, F.col("block").alias("spatial_idx"))
    other = recon.select(key, "spectral_group", "spatial_idx", F.col("token").alias("r"))
    both = tokens.join(marks, [key, "spatial_idx"]).join(other, [key, "spectral_group", "spatial_idx"])
    d = both.select(F.explode(F.zip_with("token", "r", lambda a, b: a - b)).alias("d"))
    if kind == "l1":
        return d.agg(F.avg(F.abs("d")).alias("error"))
    return d.agg((F.sum(F.col("d") * F.col("d")) / (F.count(F.lit(1)) + 1e-8)).alias("error"))


def pool_mean(pixels: DataFrame, key: str = "tile_id") -> DataFrame:
    """Mean of a site's pixel predictions."""
    return pixels.groupBy(key).agg(F.avg("value").alias("pooled"))


def class_quota(locs: DataFrame, k: int, offset: int, cls: str, order: Sequence[str], patch: int, size: int) -> DataFrame:
    """After the first ``offset`` of each class, the first ``k`` inside the border."""
    w = Window.partitionBy(cls).orderBy(*order)
    rest = locs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") > offset)
    rest = rest.where(geo.inside_tile(F.col("x"), F.col("y"), patch, size))
    return rest.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def sample_patches(pixels: DataFrame, k: int, tries: int, side: int, patch: int, seed: int = 42) -> DataFrame:
    """Up to ``k`` random patch origins a tile whose four corners and middle are valid.

    A tile's valid pixels become one list of places; its attempts are tried
    against that in its own row, so they are never joined and never sent anywhere.
    """
    free, e, m = side - patch + 1, patch - 1, patch // 2
    draw = lambda a, n, at: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{a}:"), F.col("tile_id").cast("string"), F.lit(":"), at.cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")
    whole = F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)
    valid = pixels.where((F.col("value") > 0) & whole).groupBy("tile_id").agg(F.collect_list((F.col("y") * side + F.col("x")).cast("int")).alias("_valid"))
    tried = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.struct(t.alias("attempt"), draw("y", free, t).alias("y0"), draw("x", free, t).alias("x0")))
    probes = sorted({a * side + b for a, b in ((0, 0), (0, e), (e, 0), (e, e), (m, m))})

    def fine(t: Column) -> Column:
        asked = F.array(*[t["y0"] * side + t["x0"] + p for p in probes])
        once = F.size(F.filter("_valid", lambda v: F.array_contains(asked, v))) == len(probes)  # a pixel told twice is not valid
        return F.forall(asked, lambda p: F.array_contains("_valid", p)) & once

    found = valid.withColumn("_tried", tried).select("tile_id", F.explode(F.slice(F.filter("_tried", fine), 1, k)).alias("t"))
    return found.select("tile_id", "t.attempt", "t.y0", "t.x0")


def patch_quota_report(sampled: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Patches found for each tile, and whether it is short of the quota."""
    found = sampled.groupBy("tile_id").agg(F.count(F.lit(1)).alias("found"))
    return ids.join(found, "tile_id", "left").select("tile_id", F.coalesce("found", F.lit(0)).alias("found")).withColumn("is_short", F.col("found") < k)


def center_masked(mask: DataFrame, side: int, key: str = "tile_id") -> DataFrame:
    """Masked pixel nearest to the middle."""
    mid = (side - 1) / 2
    d = (F.col("y") - mid) * (F.col("y") - mid) + (F.col("x") - mid) * (F.col("x") - mid)
    return mask.groupBy(key).agg(F.min_by(F.struct("y", "x"), F.struct(d, "y", "x")).alias("p")).select(key, "p.y", "p.x")


def resize_grid(cells: DataFrame, old: int, new: int, keys: Sequence[str] = ("tile_id",), a: float = -0.75) -> DataFrame:
    """Bicubic resize with half-pixel centres and clamped edges (X26): two passes of a four-tap weight table.

    Cells are dealt by ``keys`` once, in tasks of about ``RESIZED``; both passes stay inside them.
    """

    def weight(t: float) -> float:
        t = abs(t)
        if t <= 1:
            return (a + 2) * t**3 - (a + 3) * t**2 + 1
        return a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0

    taps: dict[int, dict[int, float]] = {}
    for i in range(new):
        c = (i + 0.5) * old / new - 0.5
        base = int(c // 1)
        for j in range(base - 1, base + 3):
            s = min(max(j, 0), old - 1)
            taps.setdefault(s, {})[i] = taps.setdefault(s, {}).get(i, 0.0) + weight(c - j)
    table = F.create_map(
        *[x for s, to in taps.items() for x in (F.lit(s), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in to.items()]))]
    )
    cells = cells.repartition(cells.count() // RESIZED + 1, *keys)
    for axis, other in (("y", "x"), ("x", "y")):
        spread = cells.withColumn("t", F.explode(F.element_at(table, F.col(axis))))
        cells = spread.groupBy(*keys, F.col("t.i").alias(axis), other).agg(F.sum(F.col("value") * F.col("t.w")).alias("value"))
    return cells


def drop_empty(patches: DataFrame, values: str, band: int, h: int, w: int, most: float = 0.5) -> DataFrame:
    """Patches of which at most the share ``most`` of one band is zero."""
    part = F.slice(values, band * h * w + 1, h * w)
    return patches.where(F.size(F.filter(part, lambda v: v == 0)) / (h * w) <= most)


def nearest_block(blocks: DataFrame, ref: DataFrame) -> DataFrame:
    """Closest reference block of each block mean, the first on ties.

    ``ref`` is one row holding the array of reference means.
    """
    one = F.broadcast(ref.select(F.col("means").alias("ref")))
    d = F.transform("ref", lambda r, i: F.struct(F.abs(r - F.col("value")).alias("d"), i.alias("i")))
    return blocks.crossJoin(one).withColumn("nearest", F.array_min(d)["i"]).drop("ref")


def augment(patches: DataFrame, values: str, h: int, w: int, seed: int = 42, key: str = "id") -> DataFrame:
    """One of the eight turns and mirrors of each patch, at random but repeatably."""
    pick = (F.conv(F.substring(seeded(F.col(key), seed), 1, 8), 16, 10).cast("long") % 8).cast("int")
    out = F.col(values)
    turned = [rot90(out, h, w, k) for k in range(4)]
    turned += [hflip(t, h, w) for t in turned]
    chosen = F.when(F.lit(False), out)
    for i, t in enumerate(turned):
        chosen = chosen.when(F.col("variant") == i, t)
    return patches.withColumn("variant", pick).withColumn(values, chosen)
