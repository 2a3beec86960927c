"""Near-duplicate documents by circulant MinHash with exact verification.

A document is the set of its distinct 5-word shingles. One permutation scatters
the shingles over a universe of ``2**UNIVERSE_BITS`` places, a second one ranks
the places; signature coordinate ``k`` is the least rank of the document under
the second permutation shifted circularly by ``k`` places. As the shifted ranks
of one place lie side by side in memory, all coordinates of a shingle are one
contiguous read.

Coordinates are grouped into bands. Documents that share a band are candidates;
exact Jaccard on the full shingle sets confirms each link. Equal sets are merged
before anything else. A bucket is never expanded into all its pairs: in each
round a few anchors of it meet the members of other components, anchors then
leave the bucket, and it closes when its members form one component. Anchors
come in the same order in all buckets, those that share buckets with most others
first, so the first round joins most copies and makes few different pairs. From
the second round on pairs must also pass a sketch of the texts that remain.
Members and anchors of a large bucket are dealt over parts, and each part of the
members meets each part of the anchors in a group of its own, so a group is small
however large its bucket. No bucket is capped, so no link between components is
lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch, grouped, id_filter, in_slices, maybe_in, mix64, released, ship, window_hashes, words_of
from specgrid.llm.components import connected_components

SHINGLE = 5
UNIVERSE_BITS = 21
BANDS, ROWS = 40, 5
#: Coordinates of the sketches, one bit of each; only texts that share a band get one.
SKETCH = 4096
#: A pair that shares a band is looked at further unless its share of equal sketch bits lies this many standard
#: deviations below that of a pair at the threshold (3 in a million of those are lost).
DEVIATIONS = 4.5
#: What remains of a bucket after a round meets more anchors in the next; up to SMALL members all meet at once.
GROWTH, SMALL = 32, 64
#: Members of a bucket in one group, and anchors that they meet there.
PART = 512
#: Rows of a set, a sketch or the bands weigh as many rows of a few numbers where tasks are counted.
HEAVY = 8

_CELL = ["bucket", "part", "head"]
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
SETS = "id long, set_a long, shingles array<long>, sketch array<long>"


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle, no words none."""
    for lo, hi in in_slices(texts):
        words, starts, _ = words_of(b"\n".join(texts[lo:hi]).lower())
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts[lo:hi])]))
        windows = window_hashes(words, size)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(windows[a : b - size + 1])
            else:
                yield window_hashes(words[a:b], b - a) if a < b else words[:0]


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The shingle set of one text."""
    return next(shingle_sets([(text or "").encode()], size))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@functools.lru_cache(maxsize=2)
def _ranks(bits: int, coordinates: int, seed: int) -> np.ndarray:
    """Row ``x`` holds the ranks of place ``x`` under all circular shifts (a view, not a copy)."""
    ranks = np.random.default_rng(seed).permutation(1 << bits).astype(np.uint32)
    around = np.concatenate([ranks, ranks[: coordinates - 1]])
    return np.lib.stride_tricks.sliding_window_view(around, coordinates)


def signature(shingles: np.ndarray, coordinates: int, bits: int = UNIVERSE_BITS, seed: int = 11) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty shingle set."""
    ranks = _ranks(bits, coordinates, seed)
    # The first permutation: a bijection on 64 bits whose top bits name the place.
    places = mix64(shingles ^ np.uint64(0xA0761D6478BD642F + seed)) >> np.uint64(64 - bits)
    out = np.full(coordinates, np.iinfo(np.uint32).max, dtype=np.uint32)
    step = max(1, 400_000 // coordinates)
    for at in range(0, len(places), step):
        np.minimum(out, ranks[places[at : at + step]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, different between bands."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key.view(np.int64)


def sketch_of(sig: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, 64 to a word."""
    bits = (mix64(sig.astype(np.uint64) + np.uint64(1)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_unequal(coordinates: int, percent: int) -> int:
    """Unequal sketch bits up to which a pair may still reach the threshold."""
    p = percent / 100 + (1 - percent / 100) / 2
    return int(np.ceil(coordinates * (1 - p) + DEVIATIONS * np.sqrt(coordinates * p * (1 - p))))


def _dealt(marked: DataFrame) -> DataFrame:
    """Each row once for each group that it belongs to: as a member beside all parts of the anchors, as an anchor in all parts of the members."""
    pieces = lambda n: F.ceil(n / PART).cast("int")
    parts, heads = pieces(F.col("n")), pieces(F.least("n", "spread"))
    part, head = F.pmod(F.xxhash64("id", "set_a"), parts).cast("int"), F.pmod(F.xxhash64("set_a", "id"), heads).cast("int")
    cell = lambda p, h, member, anchor: F.struct(p.alias("part"), h.alias("head"), member.alias("member"), anchor.alias("anchor"))
    everywhere = lambda n: F.sequence(F.lit(0), n - 1)
    as_member = F.transform(everywhere(heads), lambda h: cell(part, h, F.lit(True), F.col("used") & (h == head)))
    as_anchor = F.transform(F.filter(everywhere(parts), lambda p: p != part), lambda p: cell(p, head, F.lit(False), F.col("used")))
    cells = F.when(F.col("used"), F.concat(as_member, as_anchor)).otherwise(as_member)
    return marked.withColumn("cell", F.explode(cells)).select("*", "cell.*").drop("cell", "n", "spread")


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _met(most: int):
    """Pairs of a member and an anchor of other components whose sketches differ in ``most`` bits or fewer, in the first bucket they share.

    An anchor meets another anchor only if that has the larger id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, _CELL):
            ids, c, band, used, member, anchor = (group[x].to_numpy() for x in ("id", "c", "band", "used", "member", "anchor"))
            sketch, bands = _matrix(group["sketch"], len(ids)).view(np.uint64), _matrix(group["bands"], len(ids))
            members = np.flatnonzero(member)
            ends = []
            for k in np.flatnonzero(anchor).tolist():
                hit = members[(ids[members] != ids[k]) & (c[members] != c[k]) & (~used[members] | (ids[members] > ids[k]))]
                hit = hit[np.bitwise_count(sketch[hit] ^ sketch[k]).sum(axis=1) <= most]
                hit = hit[(bands[hit] == bands[k]).argmax(axis=1) == band[hit]]
                ends.append(np.column_stack([np.minimum(ids[hit], ids[k]), np.maximum(ids[hit], ids[k])]))
            if ends:
                both = np.concatenate(ends)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return released(run)


def _digest(shingles: np.ndarray) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64).tolist()


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, keys, ends = [], [], [], [], [0]
            for s in shingle_sets(_texts(batch.column(1)), size):
                lo, hi = _digest(s) if len(s) else (0, 0)
                if len(s):
                    keys.append(band_keys(signature(s, bands * rows), bands, rows))
                n.append(len(s))
                a.append(lo)
                b.append(hi)
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return released(run)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                parts, ends, digests, sketches = [], [0], [], []
                for s in shingle_sets(_texts(part.column(1)), size):
                    parts.append(s.view(np.int64))
                    ends.append(ends[-1] + len(s))
                    digests.append(_digest(s)[0] if len(s) else 0)
                    sketches.append(sketch_of(signature(s, SKETCH)) if len(s) else np.zeros(SKETCH // 64, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * (SKETCH // 64), pa.int32()), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.int64()), lists, each], ["id", "set_a", "shingles", "sketch"])

    return released(run)


def near_duplicates(docs: DataFrame, *, percent: int = 75, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Texts are compared in lower case (A-Z only), words are runs without white
    space. Two documents are linked when ``100 * shared >= percent * union`` of
    their shingle sets; ``component_id`` is the smallest doc_id reachable. A
    null or empty text has no shingles and is linked with nothing; a long one is
    used whole. Rows that repeat a doc_id are one node of the graph and come back
    once each; a null doc_id gets a null component and is not kept. Extra columns
    are ignored. With the default bands a pair at exactly 0.75 is missed as a
    candidate with probability 2e-5, one at 0.8 with 1e-7.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(texts.mapInArrow(_signatures(size, bands, rows), SIGNATURE), "signed")
    most = signed.count()

    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal bands.
    sets = scratch.keep(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "sets", HEAVY * most)
    firsts = sets.select(F.col("rep").alias("id"), "set_a", "bands")
    placed = firsts.select("id", "set_a", F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n")
    # A bucket of two or more takes two of the rows.
    shared = scratch.keep(shared, "shared", bands * most // 2)
    members = scratch.keep(placed.join(shared, "bucket"), "members", bands * most)
    scratch.forget()

    # One order of anchors for all buckets: who shares buckets with most others comes first, as a text that
    # others were made from is nearer to them than they are to each other.
    wanted = scratch.keep(members.groupBy("id").agg(F.sum("n").alias("fame")), "wanted", most)
    named = maybe_in(texts.select(F.col("doc_id").alias("id"), "text"), "id", id_filter(wanted, "id", scratch)).where("maybe").select("id", "text")
    # A doc_id that stands on several rows gives several sets; any of them may confirm a link.
    full = scratch.keep(named.mapInArrow(_sets(size), SETS), "full")

    # First round: the foremost of each bucket meets all the others.
    live = members.join(wanted, "id").select("bucket", "id", "fame")
    foremost = live.groupBy("bucket").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("id_a"))
    foremost = scratch.keep(foremost, "foremost", bands * most // 2)
    pairs = members.join(foremost, "bucket").where("id <> id_a").select(F.least("id", "id_a").alias("a"), F.greatest("id", "id_a").alias("b")).distinct()
    names = connected_components(_confirmed(scratch.keep(pairs, "pairs", members.count()), full, percent, scratch), scratch)
    scratch.forget()

    # What a pair must pass before its sets are compared. Members of buckets stay small rows; this joins them for one step only.
    each = firsts.join(full.select("id", "set_a", "sketch").dropDuplicates(["id", "set_a"]), ["id", "set_a"])
    each = scratch.keep(each.select("id", "set_a", "sketch", "bands"), "each", HEAVY * most)
    rest = members.join(foremost, "bucket").where("id <> id_a").join(wanted, "id").select("bucket", "band", "id", "set_a", "fame", F.lit(1).alias("spread"))
    live = scratch.keep(_of_many(rest, names), "live", bands * most)
    while n := live.count():
        part = F.when(F.col("n") <= SMALL, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.col("spread"))).alias("part")
        order = F.struct("fame", -F.col("id"), "set_a")
        anchors = live.groupBy("bucket", part).agg(F.max_by(F.struct("id", "set_a"), order).alias("x")).select("bucket", "x.*", F.lit(True).alias("used"))
        marked = live.join(scratch.keep(anchors, "anchors", n), ["bucket", "id", "set_a"], "left")
        marked = scratch.keep(marked.withColumn("used", F.coalesce("used", F.lit(False))), "marked")
        left = _dealt(marked.drop("fame").join(each, ["id", "set_a"])).repartition(*_CELL)
        left = left.coalesce(scratch.tasks(HEAVY * n)).sortWithinPartitions(*_CELL)
        pairs = scratch.keep(left.mapInArrow(_met(most_unequal(SKETCH, percent)), "a long, b long"), "pairs")
        names = _joined(names, _confirmed(pairs, full, percent, scratch), most, scratch)
        # Anchors have met all of their bucket; the rest goes on where it has two components.
        stale, live = live, scratch.keep(_of_many(marked.where("NOT used").drop("used"), names), "live", n)
        scratch.drop(stale, marked)
        scratch.forget()
    scratch.drop(live, each, full, members, foremost, wanted)

    filled_key = F.col("n_shingles") > 0
    out = signed.select("doc_id", "n_shingles", F.when(filled_key, F.col("set_a")).alias("set_a"), F.when(filled_key, F.col("set_b")).alias("set_b"))
    out = out.join(sets.drop("bands"), ["set_a", "set_b"], "left").join(names, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def _of_many(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with their components ``c``, from the buckets that hold more than one of these; the next round has more anchors."""
    now = rows.drop("c", "n").join(names, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id"))
    mixed = now.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n")
    return now.join(mixed, "bucket").select("bucket", "band", "id", "set_a", "fame", "c", "n", (F.col("spread") * GROWTH).alias("spread"))


def _joined(names: DataFrame, links: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Components ``(node, component)`` after further links, worked out on the components so far."""
    if links.isEmpty():
        return names
    end = lambda x: names.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    upper = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    upper = scratch.keep(upper.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "upper")
    over = connected_components(upper, scratch).select(F.col("node").alias("component"), F.col("component").alias("top"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(names, "node", "left_anti")
    every = names.unionByName(ends.withColumn("component", F.col("node")))
    out = scratch.keep(every.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "names", most)
    scratch.drop(upper, over, names)
    return out


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets overlap enough, as a written table that may repeat some; that of the pairs goes."""
    n = pairs.count()
    if not n:
        return pairs
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    marks = id_filter(ids, "id", scratch)
    full = maybe_in(full, "id", marks).where("maybe")
    left = full.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = full.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    na, nb = F.size("sa"), F.size("sb")
    both = both.where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    shared = F.size(F.array_intersect("sa", "sb"))
    found = scratch.keep(both.where(100 * shared >= percent * (na + nb - shared)).select("a", "b"), "links", 2 * HEAVY * n)
    scratch.drop(marks, pairs)
    return found
