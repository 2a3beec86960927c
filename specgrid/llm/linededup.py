"""Removal of repeated lines and passages by winnowing.

A text has two sorts of lines: those it has on the page, and, as passages seldom
keep their line breaks, the lines it has at every possible wrap, which are all
runs of ``LINE`` consecutive words. In every window of ``WINDOW`` neighbouring
wrapped lines the smallest hash is a fingerprint; two texts that share
``LINE + WINDOW - 1`` words in a row so share a fingerprint for certain. A line
on the page is its own fingerprint.

Fingerprints that occur more than once are joined, with their positions, to the
first place that has them. The match is extended word by word to both sides, at
most to where the next fingerprint must stand; matches of ``min_run`` words or
more are repeats, overlapping ones unite, and all places but the first lose
them. Where the first place explains only part of a fingerprint's windows, a
third text may share more with a second one: the runs that are left over meet
by their hashes. So exactly the runs of ``min_run`` words, and the lines on the
page of ``min_line`` words, that an earlier place has too are deleted. Earlier
means a smaller doc_id, or further left in the same text without overlap. A
place is only ever compared with the first one, so the work is linear in the
occurrences, not in their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch, id_filter, in_slices, maybe_in, mix64, released, ship, starts_of, window_hashes, words_of

#: Words of a wrapped line, and of the shortest passage: windows of 35 lines, 16 + 35 - 1 = 50 words are found for certain.
LINE, MIN_RUN = 16, 50
#: Words of the shortest line on the page that is deleted when it repeats.
MIN_LINE = 5
#: Stands for a null doc_id: such rows are the latest ones.
LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slide(x: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every window of ``size`` neighbours."""
    n, width, out = len(x) - size + 1, 1, x
    while width * 2 <= size:
        out = op(out[:-width], out[width:])
        width *= 2
    return op(out[:n], out[size - width : size - width + n])


def chosen(lines: np.ndarray, window: int) -> np.ndarray:
    """Mask of the line hashes that are the minimum of a window; none if there is no full window."""
    if len(lines) < window:
        return np.zeros(len(lines), dtype=bool)
    least = _slide(lines, window, np.minimum)
    pad = np.zeros(window - 1, dtype=lines.dtype)
    return _slide(np.concatenate([pad, least, pad]), window, np.maximum) == lines


def page_lines(words: np.ndarray, starts: np.ndarray, data: bytes, min_line: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, numbers of words and hashes of the lines of ``min_line`` words or more."""
    of = np.searchsorted(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), starts)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    many = np.diff(np.append(first, len(words)))
    if not len(first):
        return first, many, words[:0]
    place = (np.arange(len(words)) - np.repeat(first, many)).astype(np.uint64)
    sums = np.add.reduceat(mix64(words + place * _ODD), first)
    keep = many >= min_line
    return first[keep], many[keep], mix64(sums[keep] ^ np.uint64(0x5DEECE66D))


def prints_of(texts: list[bytes], line: int, min_run: int, min_line: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, fingerprints, their places in words, and the words of a line on the page (0 for a wrapped one), for several texts at once."""
    data = b"\n".join(texts)
    words, starts, _ = words_of(data)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at, many, hashes = page_lines(words, starts, data, min_line)
    lines = window_hashes(words, line)
    window = min_run - line + 1
    if len(lines) >= window:
        least = _slide(lines, window, np.minimum)
        # Windows that reach into the next text do not count.
        least[np.arange(len(least)) + min_run > bounds[1:][of[: len(least)]]] = 0
        pad = np.zeros(window - 1, dtype=lines.dtype)
        wrapped = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), window, np.maximum) == lines) & (lines != 0))
        at, many, hashes = np.concatenate([at, wrapped]), np.concatenate([many, np.zeros(len(wrapped), many.dtype)]), np.concatenate([hashes, lines[wrapped]])
    return of[at], hashes, at - bounds[:-1][of[at]], many


def own_repeats(words: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which runs an earlier part of the same text has too, without overlap; and the first words and lengths of their unions."""
    keys = window_hashes(words, min_run)
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    own = np.arange(len(keys)) - first[group] >= min_run if len(keys) else np.zeros(0, bool)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
    return own, turns[::2], turns[1::2] - turns[::2] + min_run - 1


def places_before(prints: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last place before each one that has the same fingerprint, -1 if there is none."""
    order = np.lexsort((at, prints))
    out = np.full(len(at), -1, dtype=np.int64)
    same = np.flatnonzero(prints[order[1:]] == prints[order[:-1]])
    out[order[same + 1]] = at[order[same]]
    return out


def contexts(words: np.ndarray, lines: np.ndarray, least: np.ndarray, own: np.ndarray, at: np.ndarray, before: np.ndarray, line: int, min_run: int) -> tuple[np.ndarray, ...]:
    """Of each fingerprint: how many words stand left and right of it, within reach; the least and most words that
    windows with this minimum have before it (least above most if there are only ``own`` ones); and hashes of the
    words on both sides, as many as a window allows."""
    reach = min_run - line
    # Of equal minima the leftmost stands for a window, so windows that begin at or before an equal place are not its own.
    start = at[:, None] - np.arange(reach + 1)
    inside = np.clip(start, 0, len(least) - 1)
    mine = (start == inside) & (start > before[:, None]) & (least[inside] == lines[at][:, None])
    if own.any():
        mine &= ~own[inside]
    some = mine.any(axis=1)
    low, high = np.where(some, mine.argmax(axis=1), 1), np.where(some, reach - mine[:, ::-1].argmax(axis=1), 0)
    short = np.concatenate([np.zeros(reach, np.uint32), (words >> np.uint64(32)).astype(np.uint32), np.zeros(reach, np.uint32)])
    around = np.concatenate([np.arange(reach), np.arange(reach + line, 2 * reach + line)])
    return np.minimum(at, reach), np.minimum(len(words) - line - at, reach), low, high, short[at[:, None] + around]


def extend(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words on the left and right side of fingerprints with contexts ``a`` and ``b``, within ``left`` and ``right``."""
    reach = a.shape[1] // 2
    same = a == b
    stop = np.ones((len(a), 1), dtype=bool)
    l = np.concatenate([~same[:, :reach][:, ::-1], stop], axis=1).argmax(axis=1)  # noqa: E741
    r = np.concatenate([~same[:, reach:], stop], axis=1).argmax(axis=1)
    return np.minimum(l, left), np.minimum(r, right)


def cut(data: bytes, starts: np.ndarray, many: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Encoded text without ``many[i]`` words from ``starts[i]`` on, the deleted spans in words, and the number of words.

    Negative numbers mean the whole text, spans that do not fit are left out. A
    deleted word takes the white space after it along; other parts stay as they are.
    """
    begins = starts_of(data)
    n = len(begins)
    many = np.where(many < 0, n, many)
    fit = (many > 0) & (starts + many <= n)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts[fit], 1)
    np.add.at(edge, (starts + many)[fit], -1)
    gone = np.cumsum(edge[:n]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    bounds, parts, at = np.append(begins, len(data)), [], 0
    for a, b in bounds[turns].reshape(-1, 2).tolist():
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts), turns, n


def _prints(line: int, min_run: int, min_line: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, u = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lo, hi in in_slices(texts):
                of, hashes, at, many = prints_of(texts[lo:hi], line, min_run, min_line)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(k[lo:hi][of]), pa.array(u[lo:hi][of]), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32))], ["print", "k", "u", "at", "n"]
                )

    return released(run)


_CONTEXT = "print long, k long, u long, at int, lead boolean, l int, r int, low int, high int, words binary"


def _contexts(line: int, min_run: int):
    """Contexts of the fingerprints that some window needs; and, without ``lead``, repeats of a text's own parts as ``at`` and ``l`` words."""
    names = ["print", "k", "u", "at", "lead", "l", "r", "low", "high", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points = batch.column("points")[i].values
                prints, every, leads = (points.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                words, _, _ = words_of(batch.column("text")[i].as_py().encode())
                lines = window_hashes(words, line)
                least = _slide(lines, min_run - line + 1, np.minimum)
                before = places_before(prints, every)
                if (before >= 0).any():
                    own, starts, many = own_repeats(words, min_run)
                else:  # no fingerprint occurs twice, so no run does
                    own, starts, many = np.zeros(len(least), bool), every[:0], every[:0]
                k, u = batch.column("k")[i].as_py(), batch.column("u")[i].as_py()
                const = lambda v, n: pa.array(np.full(n, v))
                if n := len(starts):
                    empty = pa.nulls(n, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [const(0, n), const(k, n), const(u, n), pa.array(starts.astype(np.int32)), pa.nulls(n, pa.bool_()), pa.array(many.astype(np.int32)), empty, empty, empty, pa.nulls(n, pa.binary())], names
                    )
                for lo in range(0, len(every), 20_000):
                    at = every[lo : lo + 20_000]
                    *sides, around = contexts(words, lines, least, own, at, before[lo : lo + 20_000], line, min_run)
                    part = slice(lo, lo + 20_000)
                    keep = np.flatnonzero((sides[2] <= sides[3]) | leads[part].astype(bool))
                    n, width = len(keep), around.shape[1]
                    ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(4 * width))
                    packed = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(around[keep]))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prints[part][keep]), const(k, n), const(u, n), pa.array(at[keep]), pa.array(leads[part][keep].astype(bool)), *(pa.array(x[keep].astype(np.int32)) for x in sides), packed], names
                    )

    return released(run)


def _matches(line: int, min_run: int):
    """Repeats that the first place of a fingerprint explains, without ``run``; and the left-over runs, with it."""
    reach = min_run - line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("print", "k", "u", "at", "l", "r", "low", "high", "k0", "u0", "at0", "l0", "r0")}
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint32).reshape(-1, 2 * reach) for x in ("words", "words0"))
            left, right = extend(a, b, np.minimum(c["l"], c["l0"]), np.minimum(c["r"], c["r0"]))
            own = (c["k"] == c["k0"]) & (c["u"] == c["u0"])
            clear = ~own | (c["at"] - c["at0"] >= min_run)
            good = np.flatnonzero(clear & (left + line + right >= min_run))
            rows = [(np.zeros(len(good), np.int64), c["k"][good], c["u"][good], (c["at"] - left)[good], (left + line + right)[good], np.ones(len(good), bool))]
            with np.errstate(over="ignore"):
                ragged = np.flatnonzero(~clear | (c["low"] < reach - right) | (c["high"] > left))
                sums = np.cumsum(mix64(a[ragged].astype(np.uint64) + np.arange(2 * reach, dtype=np.uint64) * _ODD), axis=1)
                sums = np.concatenate([np.zeros((len(ragged), 1), np.uint64), sums], axis=1)
                for o in range(reach + 1):
                    here = (c["low"][ragged] <= o) & (c["high"][ragged] >= o) & ~(clear[ragged] & (o >= reach - right[ragged]) & (o <= left[ragged]))
                    at = np.flatnonzero(here)
                    if len(at):
                        of = ragged[at]
                        key = mix64((sums[at, 2 * reach - o] - sums[at, reach - o]) * _ODD + c["print"][of].view(np.uint64) + np.uint64(o))
                        rows.append((key.view(np.int64), c["k"][of], c["u"][of], c["at"][of] - o, np.full(len(of), min_run), np.zeros(len(of), bool)))
            run_, k, u, start, n, plain = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(run_, mask=plain), pa.array(k), pa.array(u), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["run", "k", "u", "start", "n"]
            )

    return released(run)


def _firsts(places: DataFrame, key: str, at: str) -> DataFrame:
    """First places of the keys that have more than one."""
    place = F.struct("k", "u", at)
    both = places.groupBy(key).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    return both.select(key, F.col("first.k").alias("k0"), F.col("first.u").alias("u0"), F.col(f"first.{at}").alias(f"{at}0"))


def drop_repeats(docs: DataFrame, *, line: int = LINE, min_run: int = MIN_RUN, min_line: int = MIN_LINE) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` without repeated passages and repeated lines.

    ``text`` is replaced; all other columns stay, and ``n_deleted`` (words),
    ``spans`` (``array<struct<from, to>>``, word positions in the old text) and
    ``emptied`` (whether the text was nothing but repeats) are added. Words are
    compared exactly. A null text stays null, an empty one empty, a long one is
    handled whole. Rows are told apart by doc_id and text: rows equal in both
    are one document and come back alike, rows that share only the doc_id are
    ordered by a hash of the text; a null doc_id counts as the largest. A column
    named like an added one is replaced by it. Texts travel only where a bounded
    bitmap cannot rule a join out.
    """
    if not 0 < line < min_run:
        raise ValueError("a line must be shorter than the shortest run")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repeats")
    k, u = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.col("text").cast("string"))
    texts = docs.select(k.alias("k"), u.alias("u"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("r", F.xxhash64("k", "u"))

    # Later copies of a whole text repeat it from end to end; they need no fingerprints.
    digests = scratch.keep(texts.select("k", "u", F.xxhash64(F.lit(1), "text").alias("v")), "digests")
    firsts = digests.groupBy("u", "v").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last")
    copies = digests.join(scratch.keep(firsts, "firsts"), ["u", "v"]).where("k > first").select("k", "u", F.xxhash64("k", "u").alias("r")).distinct()
    copies = scratch.keep(copies, "copies")
    flagged = maybe_in(texts, "r", id_filter(copies, "r", scratch))
    # Of the rows that the filter lets through, those that are no copies after all are told exactly.
    single = flagged.where("NOT maybe").unionByName(flagged.where("maybe").join(copies.select("k", "u"), ["k", "u"], "left_anti")).select("k", "u", "text", "r")

    marks = scratch.keep(single.select("k", "u", "text").mapInArrow(_prints(line, min_run, min_line), "print long, k long, u long, at int, n int"), "prints")
    shared = scratch.keep(marks.groupBy("print").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("print"), "shared")
    hits = scratch.keep(marks.join(shared, "print").distinct(), "hits")
    scratch.drop(marks)
    leads = scratch.keep(_firsts(hits, "print", "at"), "leads")
    places = hits.join(leads, "print").withColumn("lead", F.expr("k = k0 AND u = u0 AND at = at0"))
    lines = places.where("n > 0 AND NOT lead").select("k", "u", F.col("at").alias("start"), "n")
    points = places.where("n = 0").groupBy("k", "u").agg(F.collect_list(F.struct("print", "at", "lead")).alias("points"))
    points = scratch.keep(points.withColumn("r", F.xxhash64("k", "u")), "points")

    touched = maybe_in(single, "r", id_filter(points, "r", scratch)).where("maybe").select("k", "u", "text")
    if not digests.groupBy("k", "u").count().where("count > 1").isEmpty():
        touched = touched.dropDuplicates(["k", "u"])
    around = touched.join(points.drop("r"), ["k", "u"]).select("k", "u", "text", "points").mapInArrow(_contexts(line, min_run), _CONTEXT)
    around = scratch.keep(around, "contexts")
    lead = around.where("lead").select("print", *[F.col(c).alias(f"{c}0") for c in ("k", "u", "at", "l", "r", "words")])
    inner = around.where("lead IS NULL").select("k", "u", F.col("at").alias("start"), F.col("l").alias("n"))
    matched = around.where("NOT lead").drop("lead").join(lead, "print").mapInArrow(_matches(line, min_run), "run long, k long, u long, start int, n int")
    matched = scratch.keep(matched, "matched")
    left = matched.where("run IS NOT NULL").drop("n")
    left = left.join(scratch.keep(_firsts(left, "run", "start"), "runs"), "run").where(f"k <> k0 OR u <> u0 OR start - start0 >= {min_run}")

    whole = copies.select("k", "u", F.lit(0).alias("start"), F.lit(-1).alias("n"))  # -1: from end to end
    cuts = matched.where("run IS NULL").select("k", "u", "start", "n").unionByName(left.select("k", "u", "start", F.lit(min_run).alias("n"))).unionByName(inner).unionByName(lines).unionByName(whole)
    cuts = cuts.groupBy("k", "u").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("many"))
    cuts = scratch.keep(cuts.withColumn("r", F.xxhash64("k", "u")), "cuts")

    added = ("n_deleted", "spans", "emptied")
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*[F.col(c).cast("string").alias(f"c{i}") if c == "text" else F.col(c).alias(f"c{i}") for i, c in enumerate(names)], k.alias("k"), u.alias("u"))
    at = names.index("text")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            texts, turns, words = [], [], []
            for text, starts, many in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column("starts"), batch.column("many"), strict=True):
                gone, n = np.empty(0, np.int64), 0
                if text is not None and starts.is_valid:
                    text, gone, n = cut(text, *(x.values.to_numpy(zero_copy_only=False) for x in (starts, many)))
                texts.append(text)
                turns.append(gone)
                words.append(n)
            ends = np.concatenate([[0], np.cumsum([len(x) // 2 for x in turns])])
            flat = np.concatenate(turns) if turns else np.empty(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(flat[1::2] - flat[::2])])
            deleted = sums[ends[1:]] - sums[ends[:-1]]
            pairs = pa.StructArray.from_arrays([pa.array(flat[::2].astype(np.int32)), pa.array(flat[1::2].astype(np.int32))], ["from", "to"])
            spans = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs).cast(span)
            emptied = (deleted > 0) & (deleted == np.array(words, dtype=np.int64))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(deleted.astype(np.int64)), spans, pa.array(emptied)], [*[f"c{i}" for i in range(len(names))], *added])

    flagged = maybe_in(rows.withColumn("r", F.xxhash64("k", "u")), "r", id_filter(cuts, "r", scratch))
    changed = flagged.where("maybe").drop("maybe", "r").join(cuts.drop("r"), ["k", "u"], "left").select(*[f"c{i}" for i in range(len(names))], "starts", "many")
    plain = flagged.where("NOT maybe").drop("maybe", "k", "u", "r")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    changed = changed.mapInArrow(released(shorten), f"{schema}, n_deleted long, spans array<struct<from:int,to:int>>, emptied boolean")
    plain = plain.withColumns({"n_deleted": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<from:int,to:int>>"), "emptied": F.lit(False)})
    return changed.unionByName(plain).toDF(*names, *added)
