"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled to three machines: a normaliser (blank to the piece
mark, dummy prefix), a piece transducer (a trie from texts to piece ids) and a
byte fallback (a character without a piece goes to the ids of its bytes). An
input composed with them is a lattice of pieces; its shortest path in the
tropical semiring is the encoding.

For unigram models an arc weighs minus the piece's log probability. A BPE
encoding is not the path of the best sum of scores, so for BPE models the
lattice is also composed with an acceptor of neighbouring pieces: an arc weighs
0 if the merges of the two pieces' joined text give back these two pieces, and
infinity if not. A sequence of pieces whose neighbours all agree in this way is
the BPE encoding, and there is one such sequence, so the path of weight 0 is the
result of the merges. Weights of pairs are worked out once and kept.

Lattices are cut where no piece can cross, at marks that start a word and at
line ends, which is exact; paths of such segments are memoised.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import released, ship

MARK = "▁"
#: Entries of each of the two parts of a task's memos: segments, and as many pairs.
MEMO = 120_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: number and raw value."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class PieceMachine:
    """A compiled model; ``encode`` and ``decode`` work on single texts."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        norm: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                self.pieces.append((f.get(1, b"").decode(), score, f.get(3, _NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        self.prefix, self.squeeze, self.mark_blanks = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        if norm.get(2) or trainer.get(24) or any(k == _USER for _, _, k in self.pieces):
            raise ValueError("models with a character map, suffix marks or user symbols are not supported")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (_NORMAL, _UNUSED)}
        self.scores = {p: s for p, s, k in self.pieces if k in (_NORMAL, _UNUSED)}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == _UNKNOWN), 0)
        bytes_ = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == _BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.byte_of = {i: b for b, i in bytes_.items()}
        self.out = [
            bytes([self.byte_of[i]]) if k == _BYTE else b"" if k == _CONTROL else b" \xe2\x81\x87 " if k == _UNKNOWN else p.replace(MARK, " ").encode()
            for i, (p, _, k) in enumerate(self.pieces)
        ]
        self.trie: dict = {}
        for piece in self.ids:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self._inherit()
        #: The longest piece that is a proper prefix of a piece.
        self.shorter = {p: next((p[:i] for i in range(len(p) - 1, 0, -1) if p[:i] in self.ids), "") for p in self.ids}
        self.floor = min((s for _, s, k in self.pieces if k == _NORMAL), default=0.0) - 10.0
        self.cut = self._cuts()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.old_pairs: dict[tuple[str, str], bool] = {}
        self.traces: dict[str, tuple[bool, list[float], list[str], list[str]]] = {}
        self.memo: dict[str, bytes] = {}
        self.old_memo: dict[str, bytes] = {}
        self.packed = {p: struct.pack("=i", i) for p, i in self.ids.items()}

    def _inherit(self) -> None:
        """Every node of the trie gets the longest piece on the way to it, so that a walk looks at a node once."""
        todo = [self.trie]
        while todo:
            node = todo.pop()
            piece = node.get("")
            for c, child in node.items():
                if c:
                    if piece:
                        child.setdefault("", piece)
                    todo.append(child)

    def _cuts(self) -> re.Pattern:
        """Segments that no piece can cross the ends of."""
        long = [p for p in self.ids if len(p) > 1]
        alone = "".join(c for c in "\n\t" if not any(c in p for p in long))
        stop = f"[{re.escape(alone)}]|" if alone else ""
        if any(MARK in p.lstrip(MARK) for p in long):
            return re.compile(f"{stop}[^{alone}]+" if alone else "(?s).+")
        if self.byte_ids and any(p.strip(MARK) for p in long):  # else unknown characters beside each other are one id
            return self._kinds(long)
        return re.compile(f"{stop}{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")

    @staticmethod
    def _kinds(long: list[str]) -> re.Pattern:
        """Segments of the largest kind of characters (letters) or of the others in pieces, with the marks before them.

        Two characters are of one kind if a chain of pieces links them, so no piece
        crosses kinds; a character that only stands alone is a segment.
        """
        kind: dict[str, str] = {}

        def root(c: str) -> str:
            while kind.setdefault(c, c) != c:
                c = kind[c]
            return c

        for a, b in {pair for p in long for pair in zip(p, p[1:]) if pair[0] != MARK}:
            kind[root(a)] = root(b)
        for c in {p[-1] for p in long} - {MARK}:
            root(c)
        groups: dict[str, list[str]] = {}
        for c in sorted(kind):
            groups.setdefault(root(c), []).append(c)
        first, *rest = sorted(groups.values(), key=len, reverse=True)
        runs = [f"{MARK}*[{re.escape(''.join(g))}]+" for g in (first, [c for g in rest for c in g]) if g]
        return re.compile("(?s)" + "|".join([*runs, f"{MARK}+", "."]))

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.mark_blanks else text

    def merge(self, text: str, seen: Callable[[float, list[str]], None] | None = None) -> list[str]:
        """Pieces of a short text by the merges themselves: best score first, leftmost on ties; ``seen`` is told each merge's score and the parts after it."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            if seen:
                seen(best, parts)
        return parts

    def trace(self, piece: str) -> tuple[bool, list[float], list[str], list[str]]:
        """Whether a piece's own merges give it, their scores, and its first and last part before each and after all of them."""
        scores, first, last = [], [piece[:1]], [piece[-1:]]

        def seen(score: float, parts: list[str]) -> None:
            scores.append(score)
            first.append(parts[0])
            last.append(parts[-1])

        known = self.traces[piece] = len(self.merge(piece, seen)) == 1, scores, first, last
        return known

    def apart(self, left: str, right: str) -> bool:
        """``merge(left + right) == [left, right]``, from the two pieces' own merges.

        Until a merge crosses their border, each side goes through its own merges in
        their order, and the next is the better one of both sides'. So the two stay
        apart if at no time their parts at the border make a piece that comes first.
        """
        fits, ours, _, ends = self.traces.get(left) or self.trace(left)
        fit, theirs, starts, _ = self.traces.get(right) or self.trace(right)
        if not (fits and fit):
            return False
        i = j = 0
        n, m, score = len(ours), len(theirs), self.scores.get
        while True:
            cross = score(ends[i] + starts[j])
            if i < n and (j == m or ours[i] >= theirs[j]):
                if cross is not None and cross > ours[i]:
                    return False
                i += 1
            elif j < m:
                if cross is not None and cross >= theirs[j]:
                    return False
                j += 1
            else:
                return cross is None

    def agrees(self, left: str, right: str) -> bool:
        """Whether the neighbour acceptor has the arc ``left right`` with weight 0."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.old_pairs.get((left, right))
            if known is None:
                known = self.apart(left, right) if left else (self.traces.get(right) or self.trace(right))[0]
            if len(self.pairs) >= MEMO:
                self.old_pairs, self.pairs = self.pairs, {}
            self.pairs[left, right] = known
        return known

    def arcs(self, text: str, at: int) -> Iterator[str]:
        """Pieces, and the bare character for the byte fallback, that start at ``at``."""
        node, end, one = self.trie, at, False
        while end < len(text):
            node = node.get(text[end])
            if node is None:
                break
            end += 1
            piece = node.get("", "")
            if len(piece) == end - at:
                one = one or end == at + 1
                yield piece
        if not one:
            yield text[at]

    def path(self, text: str) -> list[str]:
        """Shortest path through the lattice of one segment."""
        return self._zero_path(text) if self.bpe else self._best_path(text)

    def _longest(self, text: str, at: int) -> str:
        """Longest piece that starts at ``at``, else the bare character."""
        node = self.trie
        for c in text[at:]:
            after = node.get(c)
            if after is None:
                break
            node = after
        return node.get("") or text[at]

    def _zero_path(self, text: str) -> list[str]:
        """The one path of weight 0, by depth-first search, longest arcs first.

        A prefix has one path of weight 0 at most, so a position from which the
        end was not reached once need not be entered again.
        """
        n, shorter = len(text), self.shorter
        alive = [True] * (n + 1)
        out: list[str] = []
        at, last, piece = 0, "", self._longest(text, 0)
        while True:
            end = at + len(piece)
            if alive[end]:
                good = self.pairs.get((last, piece))
                if good or good is None and self.agrees(last, piece):
                    out.append(piece)
                    if end == n:
                        return out
                    at, last, piece = end, piece, self._longest(text, end)
                    continue
            piece = shorter.get(piece) or (text[at] if len(piece) > 1 else "")
            while not piece:
                alive[at] = False
                back = out.pop()
                at -= len(back)
                last = out[-1] if out else ""
                piece = shorter.get(back) or (text[at] if len(back) > 1 else "")

    def _best_path(self, text: str) -> list[str]:
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        back: list[str] = [""] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            for piece in self.arcs(text, at):
                end = at + len(piece)
                cost = best[at] - self.scores.get(piece, self.floor)
                if best[end] is None or cost < best[end]:
                    best[end], back[end] = cost, piece
        out, end = [], n
        while end:
            out.append(back[end])
            end -= len(back[end])
        return out[::-1]

    def segment(self, text: str) -> bytes:
        """Ids of one segment as packed 32-bit integers."""
        path = self.path(text)
        packed = list(map(self.packed.get, path))
        if None not in packed:
            return b"".join(packed)
        ids: list[int] = []
        for piece in path:
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in piece.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, dtype=np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for a null or empty one."""
        segments = self.cut.findall(self.normalise(text or ""))
        parts = list(map(self.memo.get, segments))
        for i, got in enumerate(parts):
            if got is None:
                parts[i] = self._remembered(segments[i])
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def _remembered(self, text: str) -> bytes:
        """``segment(text)`` through the memo. Its full part becomes the old one, from which what is met again is taken over."""
        got = self.memo.get(text)
        if got is None:
            got = self.old_memo.get(text)
            if got is None:
                got = self.segment(text)
            if len(text) <= 64:
                if len(self.memo) >= MEMO:
                    self.old_memo, self.memo = self.memo, {}
                self.memo[text] = got
        return got

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        out = self.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def machine(model: bytes) -> PieceMachine:
    return PieceMachine(model)


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver (its size does not depend on the data)."""
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_ok`` for every row of ``docs(doc_id, text)``.

    ``decoded_ok`` tells whether decoding the ids gives the normalised text back
    (a piece mark that the text holds itself reads as a blank, as in the library).
    A null or empty text has no ids. Rows are handled one by one: repeated rows
    come back each, nothing is shuffled, extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(shared.value)
        for batch in batches:
            parts, ends, ok = [], [0], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = m.encode(text)
                plain = " ".join(x for x in text.split(" ") if x) if m.squeeze else text
                ok.append(m.decode(ids) == plain.replace(MARK, " "))
                parts.append(ids)
                ends.append(ends[-1] + len(ids))
            flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
            n = np.diff(np.array(ends, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists, pa.array(ok)], ["doc_id", "n_tokens", "ids", "decoded_ok"])
        del m
        machine.cache_clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_tokens long, ids array<int>, decoded_ok boolean")


def decode_pieces(rows: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, text`` for every row of ``rows(doc_id, ids)``; null ids give an empty text."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(shared.value)
        for batch in batches:
            texts = [m.decode(np.array(x.as_py() or [], dtype=np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
