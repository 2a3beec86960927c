"""Joins of sites, boxes and granules, and what is counted on them."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.functions import geo
from specgrid.operators.order import global_rank
from specgrid.sources.io import work_dir


#: Cells that a box is wide at most: in a join of pairs, where it is looked up, and where its inner cells are counted.
WIDE, COVERED, COUNTED = 8, 16, 32
#: Pairs that a task of a range join tries, about.
TRIED = 2_000_000
#: Boxes of a task that lists their cells.
DEALT = 1_000
#: Tried pairs for which a patch is worked out once, on average, at least; below it patches are worked out a pair.
SHARED = 16
#: Rows of a task that projects sites or boxes.
KEPT = 20_000
_KEY = ["lv", "cx", "cy"]


def kept(rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(rows)`` written once, for steps of much arithmetic that joins read more than once.

    The filters that Spark derives from a join go down through projections, where
    each use of a column writes its whole series out again. Rows are dealt over
    tasks first, as a small file is one task however long its rows take.
    """
    return _written(work(rows.repartition(rows.count() // KEPT + 1)), "kept")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located_sites(sites: DataFrame) -> DataFrame:
    """Sites with easting ``e`` and northing ``n``."""
    return kept(sites, lambda df: geo.with_utm(df, "lon", "lat"))


def _level(box: tuple[Column, ...], cell: float, wide: int) -> Column:
    """First level of the grid on which a box is at most ``wide`` cells wide; -1 for boxes that no level holds, met by all points."""
    x0, x1, y0, y1 = box
    size = F.greatest(x1 - x0, y1 - y0)
    level = F.greatest(F.ceil(F.log2(size / (cell * wide))), F.lit(0)).cast("int")
    return F.when(F.isnan(size) | (size == float("inf")), -1).otherwise(level)


def _filed(boxes: DataFrame, box: tuple[str, str, str, str], cell: float, wide: int = 1) -> DataFrame:
    """Boxes under ``lv, cx, cy``: level and cells of the grid on which they touch a few cells only."""
    x0, x1, y0, y1 = (F.col(c).cast("double") for c in box)
    side = cell * F.pow(F.lit(2.0), F.col("lv"))
    cells = lambda a, b: F.when(F.col("lv") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(a / side), F.floor(b / side)))
    fits = boxes.where((x0 <= x1) & (y0 <= y1)).withColumn("lv", _level((x0, x1, y0, y1), cell, wide))
    return fits.withColumn("cx", F.explode(cells(x0, x1))).withColumn("cy", F.explode(cells(y0, y1)))


def _listed(points: DataFrame, filed: DataFrame, px: str, py: str, cell: float) -> DataFrame:
    """Points under their cell of each level that ``filed`` has; one that is not a number lies in none but the whole plane."""
    probes = points.withColumn("lv", F.explode(filed.agg(F.collect_set("lv")).scalar()))
    side = cell * F.pow(F.lit(2.0), F.col("lv"))
    at = lambda c: F.when(F.col("lv") < 0, F.lit(0).cast("long")).when(~F.isnan(F.col(c).cast("double")), F.floor(F.col(c).cast("double") / side))
    return probes.withColumns({"cx": at(px), "cy": at(py)})


def range_join(points: DataFrame, boxes: DataFrame, px: str, py: str, box: tuple[str, str, str, str], cell: float) -> DataFrame:
    """Points in boxes of any size (J1): an equi-join on the cells of a hierarchy of grids, then the exact test.

    ``box`` names the columns x_min, x_max, y_min, y_max, ``cell`` is a usual box's
    side. A box is filed at the first level on which it is at most ``WIDE`` cells
    wide, so one that spans the world costs as much as a small one. A point is
    listed under its cell of each level that has boxes: their number is bounded by
    the logarithm of the sizes, and an aggregate finds them as one value. A pair
    meets once. Points and boxes of each cell are counted first: the join has as
    many tasks as the tried pairs ask for, whatever the size of its inputs, and the
    points of a cell with very many pairs are dealt over parts. Rows with a null
    coordinate or bound, and boxes that end before they start, meet nothing;
    infinite bounds are met like any other.
    """
    filed = _filed(boxes, box, cell / WIDE, WIDE)
    probes = _listed(points, filed, px, py, cell / WIDE)
    return _pairs(probes, filed, _tried(probes, filed, _KEY), px, py, box, _KEY, points.columns)


def _tried(probes: DataFrame, filed: DataFrame, key: list[str]) -> DataFrame:
    """Points ``_p`` and boxes ``_b`` that meet under each ``key``: a cell, or classes of boxes in it that meet all its points."""
    return probes.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_p")).join(filed.groupBy(*key).agg(F.count(F.lit(1)).alias("_b")), _KEY)


def _pairs(probes: DataFrame, filed: DataFrame, tried: DataFrame, px: str, py: str, box: tuple[str, str, str, str], key: list[str], names: list[str], work: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Join of ``range_join``: points (columns ``names``) and boxes of the same ``key``, after ``work`` on the points of each task."""
    x0, x1, y0, y1 = box
    pairs, given = F.col("_p") * F.col("_b"), key
    all_pairs, most = tried.agg(F.sum(pairs), F.max(pairs)).first()
    parts = (all_pairs or 0) // TRIED + 1
    if (most or 0) > 2 * TRIED:
        heavy = tried.select(*given, F.ceil(pairs / TRIED).cast("int").alias("_k")).where("_k > 1")
        dealt = lambda df, to: df.join(heavy, given, "left").withColumn("_part", to).drop("_k")
        k = F.coalesce("_k", F.lit(1))
        probes = dealt(probes, F.pmod(F.xxhash64(*names), k).cast("int"))
        filed, key = dealt(filed, F.explode(F.sequence(F.lit(0), k - 1))), [*given, "_part"]
    inside = F.col(px).between(F.col(x0), F.col(x1)) & F.col(py).between(F.col(y0), F.col(y1))
    probes, filed = probes.repartition(parts, *key), filed.repartition(parts, *key)
    if work:  # a merge sorts what was worked out; other joins work it out again for each pair
        probes, filed = work(probes), filed.hint("merge")
    return probes.join(filed, key).where(inside).drop(*key)


@dataclass(frozen=True)
class Meeting:
    """Points, boxes and when a point is in a box: ``exact`` is sure outside ``box`` not to hold and inside ``sure``, a smaller box, to hold.

    What is asked about a meeting, other than its pairs, is told by cells: those
    that lie in a box as a whole are not looked into. Only points in cells on a
    box's edge are tested. Joins are hinted: Spark takes the
    listed cells of boxes for as small as the boxes and would broadcast them.
    """

    points: DataFrame
    boxes: DataFrame
    px: str
    py: str
    box: tuple[str, str, str, str]
    sure: tuple[str, str, str, str]
    exact: Column
    cell: float

    def split(self, boxes: DataFrame, wide: int, label: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Boxes with a number ``_id``, boxes under the cells inside them, boxes under the other cells that they touch, and points under their cells.

        A task lists boxes of one ``label`` that lie near each other, so that cells
        they have in common become one row before they are sent.
        """
        cell = self.cell / wide
        x0, x1, y0, y1 = ends = tuple(F.col(c).cast("double") for c in self.box)
        side = cell * F.pow(F.lit(2.0), F.col("lv"))
        far = F.greatest(*[F.abs(c) for c in ends]) / side > 1e15  # beyond it the numbers of cells are not exact
        placed = boxes.where((x0 <= x1) & (y0 <= y1)).withColumn("lv", _level(ends, cell, wide)).withColumn("lv", F.when(far, -1).otherwise(F.col("lv")))
        at = lambda c, by=0: F.when(F.col("lv") < 0, F.lit(0).cast("long")).otherwise(F.floor(F.col(c).cast("double") / side) + by)
        outer = dict(zip(("_x0", "_x1", "_y0", "_y1"), map(at, self.box), strict=True))
        inner = {n: at(c, by) for n, c, by in zip(("_u0", "_u1", "_v0", "_v1"), self.sure, (1, -1, 1, -1), strict=True)}
        placed = placed.withColumns(outer | inner).withColumn("_id", F.monotonically_increasing_id())
        placed = _written(placed, "boxes")  # a row a box; its cells are numbers from here on
        placed = placed.repartitionByRange(placed.count() // DEALT + 1, *(label or []), "lv", "_v0", "_u0", "_id")
        holds = F.coalesce((F.col("lv") >= 0) & (F.col("_u0") <= F.col("_u1")) & (F.col("_v0") <= F.col("_v1")), F.lit(False))
        drop = lambda df: df.drop(*outer, *inner)
        whole = placed.where(holds).withColumn("cx", F.explode(F.sequence("_u0", "_u1"))).withColumn("cy", F.explode(F.sequence("_v0", "_v1")))
        beside = F.concat(F.sequence(F.col("_x0"), F.col("_u0") - 1), F.sequence(F.col("_u1") + 1, F.col("_x1")))
        rest = F.when(holds & F.col("cy").between(F.col("_v0"), F.col("_v1")), beside).otherwise(F.sequence("_x0", "_x1"))
        edge = placed.withColumn("cy", F.explode(F.sequence("_y0", "_y1"))).withColumn("cx", F.explode(rest))
        return drop(placed), drop(whole), drop(edge), _listed(self.points, placed, self.px, self.py, cell)

    def counts(self, *keys: str) -> DataFrame:
        """Pairs of the boxes of each ``keys`` as ``n_pairs``, if there are any; cells inside a box add the number of their points."""
        placed, whole, edge, probes = self.split(self.boxes, COUNTED)
        held = probes.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_held"))
        inside = whole.select("_id", *_KEY).join(held.hint("shuffle_hash"), _KEY).groupBy("_id").agg(F.sum("_held").alias("n_pairs"))
        tested = edge.join(probes.hint("merge"), _KEY).where(self.exact).groupBy("_id").agg(F.count(F.lit(1)).alias("n_pairs"))
        found = inside.unionByName(tested).groupBy("_id").agg(F.sum("n_pairs").alias("n_pairs"))
        return placed.select("_id", *keys).join(found, "_id").groupBy(*keys).agg(F.sum("n_pairs").alias("n_pairs"))

    def covered(self, keep: list[str], label: list[str]) -> DataFrame:
        """Distinct points (columns ``keep``) and labels of boxes that they are in; a cell that a label covers needs no test for it."""
        probes, full, tested = self._full(label)
        return probes.join(full.hint("merge"), _KEY).select(*keep, *label).unionByName(tested.select(*keep, *label)).distinct()

    def alike(self, key: str, label: list[str]) -> DataFrame:
        """``covered([key], label)`` with the keys of equal cells and labels told by the smallest of them: ``key``, ``label`` and the keys' number ``n_alike``.

        A cell that labels cover is a row for each of them, whatever the number of its points.
        """
        probes, full, tested = self._full(label)
        own = probes.join(full.select(*_KEY).distinct().hint("merge"), _KEY, "left_semi").select(key, F.struct(*_KEY).alias("_cell"), F.lit(None).alias("_more"))
        own = own.unionByName(tested.select(key, F.lit(None).alias("_cell"), F.struct(*label).alias("_more")))
        sets = [F.sort_array(F.collect_set(c)).alias(c) for c in ("_cell", "_more")]
        equal = own.groupBy(key).agg(*sets).groupBy("_cell", "_more").agg(F.min(key).alias(key), F.count(key).alias("n_alike"))
        equal = _written(equal, "alike")
        keep = [key, "n_alike"]
        by_cell = equal.select(*keep, F.explode("_cell").alias("_cell")).select(*keep, "_cell.*").join(full.hint("merge"), _KEY)
        return by_cell.select(*keep, *label).unionByName(equal.select(*keep, F.explode("_more").alias("_more")).select(*keep, "_more.*")).distinct()

    def _full(self, label: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Points under their cells, cells that a box of a label covers, written once, and the other cells' points with boxes they are in."""
        placed, whole, edge, probes = self.split(self.boxes, COVERED, label)
        full = _written(whole.select(*label, *_KEY).distinct(), "full")
        left = edge.select("_id", *label, *_KEY).join(full.hint("merge"), [*label, *_KEY], "left_anti")
        return probes, full, self._tested(placed.drop(*label), left, probes)

    def _tested(self, placed: DataFrame, edge: DataFrame, probes: DataFrame) -> DataFrame:
        """Pairs in the cells of ``edge``, of which most were told without them: boxes' columns join those that are left."""
        return edge.join(placed.drop("lv"), "_id").join(probes.hint("merge"), _KEY).where(self.exact)

    def first_box(self, keep: list[str], *order: str) -> DataFrame:
        """Distinct points with the first box, in ``order``, that they are in: on a cell's edges only boxes before the first that covers it are tested."""
        numbered = global_rank(self.boxes, *order, name="_no")
        placed, whole, edge, probes = self.split(numbered, COVERED)
        best = _written(whole.groupBy(*_KEY).agg(F.min("_no").alias("_best")), "best")
        left = edge.select("_id", "_no", *_KEY).join(best.hint("merge"), _KEY, "left").where("_best IS NULL OR _no < _best")
        tested = self._tested(placed.drop("_no"), left, probes)
        either = probes.join(best, _KEY).select(*keep, F.col("_best").alias("_no")).unionByName(tested.select(*keep, "_no"))
        return either.groupBy(*keep).agg(F.min("_no").alias("_no")).join(numbered, "_no").drop("_no")


def in_boxes(points: DataFrame, boxes: DataFrame, px: str, py: str, box: tuple[str, str, str, str], cell: float = 0.3) -> Meeting:
    """Points in plain boxes, ends included."""
    x0, x1, y0, y1 = box
    return Meeting(points, boxes, px, py, box, box, F.col(px).between(F.col(x0), F.col(x1)) & F.col(py).between(F.col(y0), F.col(y1)), cell)


_GRANULE_BOX, _PATCH_BOX = ("bx0", "bx1", "by0", "by1"), ("px0", "px1", "py0", "py1")


def _granule_boxes(granules: DataFrame) -> DataFrame:
    x1, y1 = F.col("origin_x") + F.col("width") * F.col("pixel_w"), F.col("origin_y") + F.col("height") * F.col("pixel_h")
    return granules.withColumns({"bx0": F.least("origin_x", x1), "bx1": F.greatest("origin_x", x1), "by0": F.least("origin_y", y1), "by1": F.greatest("origin_y", y1)})


def _pixel() -> dict[str, Column]:
    x, y = geo.pixel_index(F.col("e"), F.col("n"), F.col("origin_x"), F.col("pixel_w"), F.col("origin_y"), F.col("pixel_h"))
    return {"x_idx": x, "y_idx": y}


def map_sites(sites: DataFrame, granules: DataFrame, patch: int = 16, cell: float = 24_000.0) -> DataFrame:
    """Site-to-pixel join (J2): one row per site and granule whose patch fits, with pixel indices."""
    return _fitting(range_join(located_sites(sites), kept(granules, _granule_boxes), "e", "n", _GRANULE_BOX, cell), patch // 2)


def _fitting(pairs: DataFrame, half: int) -> DataFrame:
    return pairs.withColumns(_pixel()).where(geo.fits_patch(F.col("x_idx"), F.col("y_idx"), F.col("width"), F.col("height"), half)).drop(*_GRANULE_BOX)


_LATTICE = ["_ax", "_ay", "_pw", "_ph"]  # in the order of origin_x, origin_y, pixel_w, pixel_h


def _lattices(cell: float) -> dict[str, Column]:
    """Pixel sizes and an anchor of the pixels of a box filed under a cell: places from which ``e`` and ``n`` in both have the same pixel borders.

    Whole numbers are counted from the pixel border next to the cell, so that
    granules on one lattice share it. There a quotient rounds over no border and
    borders are exact, as the distances stay below the coordinates themselves (a
    quotient's last digit is then smaller than what a coordinate's last digit
    makes of it). Other granules are anchored at their own origin.
    """
    side, out = cell * F.pow(F.lit(2.0), F.col("lv")), {}
    for a, p, (lo, hi), origin, step, at in (("_ax", "_pw", _GRANULE_BOX[:2], "origin_x", "pixel_w", "cx"), ("_ay", "_ph", _GRANULE_BOX[2:], "origin_y", "pixel_h", "cy")):
        o, w, far = F.col(origin).cast("double"), F.col(step).cast("double"), [F.abs(F.col(c).cast("double")) for c in (lo, hi)]
        whole = (F.col("lv") >= 0) & (o % 1 == 0) & (w % 1 == 0) & (w != 0) & (F.greatest(*far) < 2.0**50)
        whole &= F.col(hi) - F.col(lo) + side + 2 * F.abs(w) <= F.least(*far)
        edge = F.when(w > 0, F.col(at)).otherwise(F.col(at) + 1) * side
        out |= {a: F.when(whole, o + w * F.floor((edge - o) / w)).otherwise(o), p: w}
    return out


def patch_bounds(sites: DataFrame, granules: DataFrame, patch: int = 16, cell: float = 24_000.0, digits: int | None = None) -> DataFrame:
    """The pairs of ``map_sites`` with the longitude/latitude box of their patch (G5), rounded to ``digits``.

    Granules of one lattice of pixels see a site in the same place, so the series is
    worked out once for a site, a cell and each lattice that granules of the cell
    have, and not once a pair, where that serves at least ``SHARED`` tried pairs on
    average.
    """
    half, ends = patch // 2, ("lat_min", "lat_max", "lon_min", "lon_max")
    rounded = lambda df: df if digits is None else df.withColumns({c: F.round(c, digits) for c in ends})
    points, boxes, fine = located_sites(sites), kept(granules, _granule_boxes), cell / WIDE
    # numbers of one double each, which are equal only if the doubles are; as doubles they would be shuffled once more for the join
    key = [*_KEY, *(f"{c}_no" for c in _LATTICE)]
    filed = _filed(boxes, _GRANULE_BOX, fine, WIDE).withColumns(_lattices(fine)).withColumns({f"{c}_no": F.xxhash64(c) for c in _LATTICE})
    listed = _listed(points, filed, "e", "n", fine)
    tried = _written(_tried(listed, filed, [*key, *_LATTICE]), "lattices")
    shared, all_pairs = tried.agg(F.sum("_p"), F.sum(F.col("_p") * F.col("_b"))).first()
    if (shared or 0) * SHARED > (all_pairs or 0):
        pairs = _fitting(range_join(points, boxes, "e", "n", _GRANULE_BOX, cell), half)
        return rounded(geo.with_patch_bounds(pairs, "x_idx", "y_idx", half))

    def bounded(df: DataFrame) -> DataFrame:
        given = dict(zip(("origin_x", "origin_y", "pixel_w", "pixel_h"), map(F.col, _LATTICE), strict=True))
        pixel = {c: F.floor(F.try_divide(F.col(at) - F.col(a), F.col(p))).cast("double") for c, at, a, p in (("_x", "e", "_ax", "_pw"), ("_y", "n", "_ay", "_ph"))}
        return rounded(geo.with_patch_bounds(df.withColumns(given | pixel), "_x", "_y", half).drop(*given, *pixel, *_LATTICE))

    probes = listed.join(tried.drop("_p", "_b"), _KEY)
    return _fitting(_pairs(probes, filed.drop(*_LATTICE), tried, "e", "n", _GRANULE_BOX, key, points.columns, bounded), half)


def mapped_sites(sites: DataFrame, granules: DataFrame, patch: int = 16, cell: float = 24_000.0) -> Meeting:
    """The pairs of ``map_sites`` as a meeting, for all that can be told without listing them."""
    half = patch // 2
    boxes = _granule_boxes(granules)
    for (lo, hi), origin, size, step in ((_PATCH_BOX[:2], "origin_x", "width", "pixel_w"), (_PATCH_BOX[2:], "origin_y", "height", "pixel_h")):
        # one pixel more than the patch needs, so that no rounding matters
        near, away = F.col(origin) + (half + 1) * F.col(step), F.col(origin) + (F.col(size) - half - 1) * F.col(step)
        boxes = boxes.withColumns({lo: F.when(F.col(step) > 0, near).otherwise(away), hi: F.when(F.col(step) > 0, away).otherwise(near)})
    at = _pixel()
    inside = F.col("e").between(F.col("bx0"), F.col("bx1")) & F.col("n").between(F.col("by0"), F.col("by1"))
    exact = inside & geo.fits_patch(at["x_idx"], at["y_idx"], F.col("width"), F.col("height"), half)
    return Meeting(located_sites(sites), boxes, "e", "n", _GRANULE_BOX, _PATCH_BOX, exact, cell)


def first_granules(mapped: Meeting) -> DataFrame:
    """One row per place, of all sites and granules there the first by ``granule_id, site_id``."""
    won = mapped.first_box(["site_id", "lat", "lon", "e", "n"], "granule_id", "gid").withColumns(_pixel())
    return dedup_first(won, [F.round("lat", 5), F.round("lon", 5)], ["granule_id", "site_id"])


def dedup_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """First row of each key (W1, W2): the smallest by ``order``, kept by one aggregate instead of a sort of the group."""
    names = [f"k{i}" for i in range(len(keys))]
    keyed = df.withColumns({n: F.col(k) if isinstance(k, str) else k for n, k in zip(names, keys, strict=True)})
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]))
    return keyed.groupBy(*names).agg(best.alias("row")).select("row.*")


def granule_site_counts(mapped: Meeting) -> DataFrame:
    """Sites of each granule (A3); order them where they are shown."""
    return mapped.counts("granule_id").withColumnRenamed("n_pairs", "n_sites")


def flightline_coverage(mapped: Meeting) -> DataFrame:
    """Distinct sites and granules of each flightline (A4)."""
    sites = mapped.alike("site_id", ["flightline"]).groupBy("flightline").agg(F.sum("n_alike").alias("n_sites"))
    granules = mapped.counts("flightline", "granule_id").groupBy(F.col("flightline").alias("_line")).agg(F.sort_array(F.collect_set("granule_id")).alias("granules"))
    return sites.join(granules, F.col("flightline").eqNullSafe(F.col("_line"))).drop("_line")


def coverage_totals(mapped: Meeting) -> DataFrame:
    """Distinct covered sites, distinct granules and pairs (A5)."""
    sites = mapped.covered(["site_id"], []).agg(F.countDistinct("site_id").alias("n_sites"))
    pairs = mapped.counts("granule_id").agg(F.count("granule_id").alias("n_granules"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))
    return sites.crossJoin(pairs)  # a row each


def coverage_gaps(sites: DataFrame, mapped: Meeting, boxes: DataFrame) -> DataFrame:
    """Unmapped sites and why (J7): ``no_granule`` outside all boxes, else ``edge_or_data``."""
    missing = sites.join(mapped.covered(["site_id"], []), "site_id", "left_anti")
    inside = in_boxes(sites, boxes, "lon", "lat", ("lon_min", "lon_max", "lat_min", "lat_max")).covered(["site_id"], [])
    flagged = missing.join(inside.withColumn("hit", F.lit(True)), "site_id", "left")
    return flagged.withColumn("reason", F.when(F.col("hit"), "edge_or_data").otherwise("no_granule")).drop("hit")


def flightline_sites(mapped: Meeting) -> DataFrame:
    """Distinct flightlines and sites, one site for ``n_alike`` of the same flightlines, written once, as the ranks and covers read them more than once."""
    return _written(mapped.alike("site_id", ["flightline"]), "lines")


def _alike(matches: DataFrame) -> Column:
    """Sites that a row of ``matches`` stands for."""
    return F.col("n_alike") if "n_alike" in matches.columns else F.lit(1).cast("long").alias("n_alike")


def rank_flightlines(matches: DataFrame, n: int) -> DataFrame:
    """Top ``n`` flightlines by sites, with the sites that no better-ranked one has."""
    lines = matches.select("flightline", "site_id", _alike(matches)).distinct()
    counts = lines.groupBy("flightline").agg(F.sum("n_alike").alias("n_sites"))
    top = counts.orderBy(F.desc("n_sites"), "flightline").limit(n)
    # n rows from here on
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_sites"), "flightline")))
    best = lines.join(ranked, "flightline").groupBy("site_id", "n_alike").agg(F.min("rank").alias("rank"))
    new = best.groupBy("rank").agg(F.sum("n_alike").alias("new_sites"))
    return ranked.join(new, "rank", "left").select("rank", "flightline", "n_sites", F.coalesce("new_sites", F.lit(0)).alias("new_sites"))


def greedy_cover(matches: DataFrame, n: int, ahead: int = 16) -> DataFrame:
    """Greedy cover: at each step the flightline with most sites not yet covered, the smaller one on ties.

    Sites of the same flightlines become one row, a set of flightlines and their
    number, written once; every job reads those, so plans don't grow with the steps.
    What a flightline would add can only shrink, so its last known gain bounds it: the driver keeps
    one number a flightline in a queue, and a step counts anew only the ``ahead``
    best of those whose number is old, until the best number is a new one.
    """
    spark = matches.sparkSession
    lines = matches.select("flightline", "site_id", _alike(matches)).where("flightline IS NOT NULL AND site_id IS NOT NULL")
    sets = lines.groupBy("site_id", "n_alike").agg(F.sort_array(F.collect_set("flightline")).alias("lines"))
    sets = _written(sets.groupBy("lines").agg(F.sum("n_alike").alias("k")), "cover")
    kind = lines.schema["flightline"].dataType.simpleString()
    chosen: list[tuple[int, object, int]] = []

    def gains(asked: list) -> dict:
        """Sites that each of some flightlines adds to the chosen ones."""
        these = lambda of: F.array(*[F.lit(a).cast(kind) for a in of])
        new = sets.where(~F.arrays_overlap("lines", these([c[1] for c in chosen])))
        each = new.select(F.explode(F.array_intersect("lines", these(asked))).alias("flightline"), "k")
        return dict.fromkeys(asked, 0) | {r.flightline: r.k for r in each.groupBy("flightline").agg(F.sum("k").alias("k")).collect()}

    first = sets.select(F.explode("lines").alias("flightline"), "k").groupBy("flightline").agg(F.sum("k").alias("k"))
    queue = [(-r.k, r.flightline, 1) for r in first.collect()]  # one row a flightline
    heapq.heapify(queue)
    for step in range(1, n + 1):
        while queue and queue[0][2] < step:
            old = [heapq.heappop(queue) for _ in range(min(ahead, len(queue)))]
            stale = [line for _, line, at in old if at < step]
            now = gains(stale)
            for k, line, at in old:
                heapq.heappush(queue, (-now[line], line, step) if at < step else (k, line, at))
        if not queue or not queue[0][0]:
            break
        k, line, _ = heapq.heappop(queue)
        chosen.append((step, line, -k))
    return spark.createDataFrame(chosen, f"rank int, flightline {kind}, new_sites long")


def richness_ramp(sites: DataFrame) -> DataFrame:
    """Display hue of a site's richness (P17); the maximum is one row, joined as such."""
    top = sites.agg(F.greatest(F.max("richness"), F.lit(1.0)).alias("top"))
    ratio = F.col("richness") / F.col("top")
    return sites.crossJoin(F.broadcast(top)).withColumns({"ratio": ratio, "hue": (1 - ratio) * 120}).drop("top")


def sites_extent(sites: DataFrame) -> DataFrame:
    """Box around all sites."""
    return sites.agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def extent_overlap(boxes: DataFrame, sites: DataFrame) -> DataFrame:
    """Boxes and the sites inside (G6); boxes without sites count 0, equal rows are counted together. A granule may have several boxes."""
    keys = ["granule_id", "lat_min", "lat_max", "lon_min", "lon_max"]
    hits = in_boxes(sites, boxes, "lon", "lat", ("lon_min", "lon_max", "lat_min", "lat_max")).counts(*keys)
    none = boxes.select(*keys, F.lit(0).cast("long").alias("n_pairs"))
    return hits.unionByName(none).groupBy(*keys).agg(F.sum("n_pairs").alias("n_sites"))
