"""Best-fit-decreasing packing of tokenised documents into sequences of fixed size.

Best fit decreasing looks at lengths only, and there are no more than ``size`` of
them, so the sequential part runs over the histogram of lengths instead of the
pieces. Open sequences are held by remaining capacity, a segment tree over the
capacities finds the tightest one that still fits in logarithmic time, and pieces
of one length are placed as a run: ``capacity // length`` of them go into each
sequence of the tightest capacity, which is what placing them one by one does, as
a sequence just filled further is the tightest for the next piece. The result is
that of best fit decreasing over all pieces together; the plan's size depends on
the number of lengths, not on the table.

A run names a range of ranks among the pieces of its length. Ranks are counted by
the tokenising tasks (place inside the task) and shifted by what the tasks before
have of that length; a binary search over the runs gives each piece its place. No
group of pieces meets in a task, however many share a length.

Ids are those of the ``tokenizers`` library. Where the tokenizer cuts words the
plain way (see ``_PLAIN``), each distinct word of a slice of texts is encoded once
and kept in a bounded memo under a 64-bit hash of its bytes; all other texts go
through the library as they are, cut at blanks.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from specgrid.llm.common import Scratch, in_slices, mix64, released, ship

SIZE = 2048
#: Words that a worker remembers.
MEMO = 1 << 20
_ODD = 0x9E3779B97F4A7C15
#: Longest text that is hashed, and powers there are.
_SLICE = 1 << 18
# The normaliser and the word pattern of a tokenizer whose words can be cut here.
_PLAIN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
)
#: Classes of Latin-1 bytes: blank, letter, digit, other; -1 leaves the text to the library.
_CLASS = np.full(256, 3, dtype=np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[i for i in range(256) if chr(i).isalpha()]] = 1
_CLASS[[i for i in range(256) if chr(i).isnumeric()]] = 2
_CLASS[[*range(9), *range(14, 32), *range(0x7F, 0xA1), 0xAD]] = -1
_SAFE = bytes(np.flatnonzero(_CLASS >= 0).astype(np.uint8))
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else i for i in range(256)], dtype=np.uint8)
with np.errstate(over="ignore"):
    _LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(_SLICE + 2, _ODD, dtype=np.uint64), np.full(_SLICE + 2, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def cut_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased Latin-1 bytes start and end: runs of letters, single digits, runs of other marks, English endings after an apostrophe."""
    n = len(raw)
    kind = np.zeros(n + 2, dtype=np.int8)
    kind[1:-1] = _CLASS[raw]
    edge = kind[1:] != kind[:-1]
    digit = kind[1:-1] == 2
    edge[:-1] |= digit
    edge[1:] |= digit
    at = np.flatnonzero((raw == 39) & edge[:-1])
    if len(at):
        pad = np.concatenate([raw, np.zeros(2, dtype=np.uint8)])
        a, b = pad[at + 1], pad[at + 2]
        one = np.isin(a, np.frombuffer(b"stmd", dtype=np.uint8))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for hit, width in ((at[one], 2), (at[two & ~one], 3)):
            edge[hit + 1] = False
            edge[hit + width] = True
    turns = np.flatnonzero(edge)
    starts = turns[kind[turns + 1] != 0]
    ends = turns[np.searchsorted(turns, starts, side="right")] if len(starts) else starts
    return starts, ends


class Words:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        cut = told["pre_tokenizer"] or {}
        steps = cut.get("pretokenizers") or [{}]
        self.plain = (
            told["normalizer"] == _PLAIN[0]
            and told["post_processor"] is None
            and len(steps) == 2
            and (steps[0].get("type"), steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ("Split", _PLAIN[1], "Removed", True)
            and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        )
        self.special = [t["content"] for t in told["added_tokens"]]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytewise = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(256)}
        self.forget()

    def forget(self) -> None:
        """Empties the memo: hashes in order, the word's number for each, and by number its ids in one array."""
        self.known, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.first, self.count, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        self.chunks: dict[str, np.ndarray] = {}

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def by_chunks(self, text: str) -> np.ndarray:
        """Any text of a plain tokenizer, cut at blanks, over which nothing in it reaches."""
        out = []
        for chunk in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if not chunk:
                continue
            ids = self.chunks.get(chunk)
            if ids is None:
                ids = self.by_library(chunk)
                if len(chunk) <= 64:
                    if len(self.chunks) >= MEMO // 4:
                        self.chunks.clear()
                    self.chunks[chunk] = ids
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        tokenize, bytewise = self.tokenizer.model.tokenize, self.bytewise
        told = [[t.id for t in tokenize(w.decode("latin-1").translate(bytewise))] for w in words]
        count = np.array([len(t) for t in told], dtype=np.int64)
        ids = np.fromiter((i for t in told for i in t), dtype=np.uint32, count=int(count.sum()))
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.number = np.insert(self.number, at, len(self.first) + np.arange(len(keys)))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])

    def by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of safe Latin-1 texts."""
        up, down = _powers()
        keys, starts, ends, data, stops, base = [], [], [], [], [], 0
        for lo, hi in in_slices(texts, _SLICE // 2):
            raw = _LOWER[np.frombuffer(b" ".join(texts[lo:hi]), dtype=np.uint8)]
            a, b = cut_words(raw)
            with np.errstate(over="ignore"):
                sums = np.zeros(len(raw) + 1, dtype=np.uint64)
                np.cumsum(_LETTER[raw] * up[: len(raw)], out=sums[1:])
                keys.append(mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
            starts.append(a + base)
            ends.append(b + base)
            stops.append(base + np.cumsum([len(t) + 1 for t in texts[lo:hi]]) - 1)
            data.append(raw.tobytes())
            base += len(raw)
        if not keys:
            return []
        starts, ends, whole = np.concatenate(starts), np.concatenate(ends), b"".join(data)
        distinct, place, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        if len(self.known) >= MEMO:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), dtype=bool)
        fresh[at < len(self.known)] = self.known[at[at < len(self.known)]] != distinct[at < len(self.known)]
        if fresh.any():
            where = place[fresh]
            self._learn(distinct[fresh], [whole[i:j] for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        rows = self.number[np.searchsorted(self.known, distinct)][back]
        count = self.count[rows]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[rows] - upto[:-1], count) + np.arange(upto[-1])]
        return np.split(ids, upto[np.searchsorted(starts, np.concatenate(stops))][:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        held, at = [], []
        for i, text in enumerate(texts):
            if self.plain and not any(s in text for s in self.special):
                try:
                    data = text.encode("latin-1")
                except UnicodeEncodeError:
                    data = None
                if data is not None and len(data) <= _SLICE and not data.translate(None, _SAFE):
                    held.append(data)
                    at.append(i)
                    continue
                out[i] = self.by_chunks(text)
            else:
                out[i] = self.by_library(text)
        for i, ids in zip(at, self.by_words(held), strict=True):
            out[i] = ids
        return out


@functools.lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def _pieces(path: str, size: int, end: int, keep_ids: bool):
    """Rows of pieces with the task's number and their place among its pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            step = max(1, (1 << 22) * batch.num_rows // max(1, texts.nbytes))
            for at in range(0, batch.num_rows, step):
                words = _words(path).encode([t or "" for t in texts[at : at + step].to_pylist()])
                doc, piece, start, length, crc, place, ids = [], [], [], [], [], [], []
                for i, own in enumerate(words, at):
                    own = np.append(own, np.uint32(end)).astype("<u4")
                    data = own.tobytes()
                    for k, a in enumerate(range(0, len(own), size)):
                        n = min(size, len(own) - a)
                        doc.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(data[4 * a : 4 * (a + n)]))
                        place.append(int(seen[n]))
                        seen[n] += 1
                        if keep_ids:
                            ids.append(own[a : a + n].astype(np.int32))
                columns = [doc_ids.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                columns += [pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, dtype=np.int32)), pa.array(place, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names + (["ids"] if keep_ids else []))

    return released(run)


class Capacities:
    """Segment tree over remaining capacities: how many open sequences have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.total[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of ``least`` or more that a sequence has."""
        at = self.leaves + least
        while not self.total[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.total[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], size: int) -> np.ndarray:
    """Runs ``(length, first rank, pieces in a sequence, first sequence, offset)`` of best fit decreasing, sorted by length and rank."""
    tree = Capacities(size)
    open_: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = size, fresh, -(-left // (size // length))
                fresh += n
            else:
                first, n = open_[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, each, first, size - capacity))
                put(capacity - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left and left < each:  # the rest, in one sequence
                runs.append((length, rank, left, first, size - capacity))
                put(capacity - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(capacity, first, n)
    runs.sort()
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def _place(runs: np.ndarray):
    """Sequence and offset of each piece, from its length and its rank among the pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.searchsorted(runs[:, 0], np.arange(runs[-1, 0] + 2)) if len(runs) else np.zeros(2, dtype=np.int64)
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            lengths, begins = np.unique(length[order], return_index=True)
            for n, rows in zip(lengths.tolist(), np.split(order, begins[1:]), strict=True):
                at[rows] = start[n] + np.searchsorted(runs[start[n] : start[n + 1], 1], rank[rows], side="right") - 1
            k, each = rank - runs[at, 1], runs[at, 2]
            placed = {"sequence_id": runs[at, 3] + k // each, "offset": runs[at, 4] + k % each * length}
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, placed.values())], [*keep, *placed])

    return run


def pack(docs: DataFrame, tokenizer: str, *, size: int = SIZE, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of ``docs(doc_id, text)``.

    A document is the ids of its whole text by the tokenizer file ``tokenizer``
    (no special tokens added) and then ``end``; a null text is empty, so its piece
    is ``end`` alone. Documents of more than ``size`` ids are cut after every
    ``size``, the last piece may be shorter, others stay whole. Pieces of a sequence
    lie without gaps from offset 0. ``ids_crc32`` is that of the ids as little-endian
    32-bit numbers; ``keep_ids`` adds the ids themselves. Which of several pieces
    of one length gets which place follows their place in the table. Rows that
    repeat a doc_id, or have none, are documents each. Extra columns are ignored,
    an empty table gives an empty result. A single text is held whole by its task.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long" + (", ids array<int>" if keep_ids else "")
    pieces = scratch.keep(rows.mapInArrow(_pieces(tokenizer, size, end, keep_ids), schema), "pieces")
    by_task = scratch.keep(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    past = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("place") + F.col("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = ranked.select(*kept, "rank", *(["ids"] if keep_ids else []))
    placed = ", sequence_id long, offset long"
    return out.mapInArrow(_place(best_fit(counts, size)), "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + placed)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of each sequence, from pieces packed with their ids; a group holds at most one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
