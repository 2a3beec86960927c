"""Spelling variants by search schemes over a bidirectional FM-index.

A word that differs from another by one inserted, deleted or replaced character
shares one of its halves with it. So each word is searched twice: its first half
exactly and rightwards over the second with one error, and its second half
exactly and leftwards over the first. Delimiters stand between the words of the
index, every search starts at one and ends at one, and the suffix-rank interval
of a delimited whole word has one rank: the word's place in the sorted list. The
index holds both reading directions, one for each way a search goes.

The vocabulary grows with the corpus, so the index is built in shards: a word is
filed under the halves by which words of its own, the next smaller and the next
larger length may look for it, and halves are hashed to shards. A half that very
many words share is not kept together: the part in which the error may lie is
halved again, and words are filed under what must then be equal to both sides of
it, until groups are small or the part has one place. A pair is told where that
part holds the first place at which the two words differ, hence once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch, grouped, released, ship

#: Runs that are words: letters of ASCII and all of U+00C0 to U+00FF.
RUN = "[a-zÀ-ÿ]"
LEAST, OFTEN, RATIO, TYPOS = 7, 2, 10, 31
#: Filed words of a shard, about, and of one half before it is cut further.
SHARD, HOT = 1 << 15, 1 << 14
#: Different words that a task counts before it hands them on.
_COUNTED = 400_000
_BLOCK = 16
#: Searches that go on together.
_TOGETHER = 8192


def typo(word: str, h: int, every: int) -> str:
    """``word`` without the character that ``h`` names, if ``every`` divides ``h``."""
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def _count(least: int, every: int | None):
    find = re.compile(f"{RUN}{{{least},}}").findall

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                if (data := text.as_buffer()) is None:
                    continue
                own = Counter(find(data.to_pybytes().lower().decode()))
                if doc_id is None or not every:
                    counts.update(own)
                else:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % every:
                            counts[word] += n
                        elif len(short := typo(word, h, every)) >= least:
                            counts[short] += n
                if len(counts) > _COUNTED:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return released(run)


def vocabulary(docs: DataFrame, *, least: int = LEAST, often: int = OFTEN, every: int | None = TYPOS) -> DataFrame:
    """``word, n`` of the words of ``docs(doc_id, text)`` that have ``least`` characters and occur ``often`` times.

    Only A to Z are lower-cased. With ``every``, a run loses a character where
    ``every`` divides the crc32 of ``<doc_id>:<run>``; a null doc_id loses none.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(_count(least, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


class SuffixRanks:
    """FM-index of distinct words between delimiters, searched from the words' last characters to their first.

    ``words`` are encoded with one byte a character and sorted; a delimiter's
    suffix then ranks as the word after it, and the closing one comes first.
    """

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8)
        letters = np.unique(text)
        self.code = np.full(256, len(letters), dtype=np.int16)  # absent letters share a code that never occurs
        self.code[letters] = np.arange(len(letters))
        self.width = len(letters) + 1
        body = self.code[text].astype(np.uint8)
        order = self._order(text, len(words))
        bwt = body[order - 1]
        n = len(bwt)
        self.words = len(words)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(body, minlength=self.width))])[: self.width]
        blocks = n // _BLOCK + 1
        seen = np.bincount(np.arange(n) // _BLOCK * self.width + bwt, minlength=blocks * self.width).reshape(blocks, self.width)
        self.upto = np.zeros((blocks + 1, self.width), dtype=np.int32)
        np.cumsum(seen, axis=0, out=self.upto[1:])
        self.bwt = np.full((blocks + 1) * _BLOCK, 255, dtype=np.uint8)
        self.bwt[:n] = bwt
        self.bwt = self.bwt.reshape(-1, _BLOCK)

    @staticmethod
    def _order(text: np.ndarray, words: int) -> np.ndarray:
        """Suffix array by doubling; delimiters differ from the start, so comparisons end at them."""
        rank = text.astype(np.int64) + words
        at = np.flatnonzero(text == 0)
        rank[at[:-1]], rank[at[-1]] = np.arange(1, len(at)), 0
        reach = 1
        while True:
            key = rank * (len(text) + 256)
            key[:-reach] += rank[reach:]
            order = np.argsort(key)
            key = key[order]
            fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if fresh[-1] == len(text) - 1:
                return order
            rank[order] = fresh
            reach *= 2

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First suffix rank from ``at`` on after putting ``code`` in front."""
        block, rest = at // _BLOCK, at % _BLOCK
        inside = ((self.bwt[block] == code[:, None]) & (np.arange(_BLOCK) < rest[:, None])).sum(axis=1)
        return self.before[code] + self.upto[block, code] + inside

    def ranks(self, at: np.ndarray) -> np.ndarray:
        """The same for all characters at once."""
        block, rest = at // _BLOCK, at % _BLOCK
        out = self.upto[block] + self.before
        near = self.bwt[block]
        for j in range(_BLOCK - 1):
            rows = np.flatnonzero(rest > j)
            out[rows, near[rows, j]] += 1
        return out


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(length) - length, length


def search(index: SuffixRanks, words: list[bytes], exact: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(word, place in the index)`` at one error, whose first difference lies from ``exact`` to before ``last``.

    The index holds reversed words, so that putting a character in front there
    reads a word on. Where ``last`` is a word's length, the error may also be a
    character after its end. Each pair comes once: an inserted character differs
    from the one it stands before, a deleted one from the next.
    """
    found_q, found_t = [], []
    for start in range(0, len(words), _TOGETHER):
        q, t = _search(index, words[start : start + _TOGETHER], exact[start : start + _TOGETHER], last[start : start + _TOGETHER])
        found_q.append(q + start)
        found_t.append(t)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_q), np.concatenate(found_t)) if found_q else (none, none)


def _search(index: SuffixRanks, words: list[bytes], exact: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, first, length = _flat(words)
    codes = np.concatenate([index.code[raw], np.zeros(1, dtype=np.int16)]).astype(np.int64)
    absent = index.width - 1
    at_pos = lambda q, pos: np.where(pos < length[q], codes[np.minimum(first[q] + pos, len(codes) - 1)], -1)  # noqa: E731  -1 past the end

    # Halves that several words share are matched once.
    halves: dict[bytes, int] = {}
    half = np.array([halves.setdefault(w[:e], len(halves)) for w, e in zip(words, exact.tolist(), strict=True)], dtype=np.int64)
    h_raw, h_first, h_length = _flat(list(halves))
    h_codes = index.code[h_raw].astype(np.int64)
    lo, hi = np.zeros(len(halves), dtype=np.int64), np.full(len(halves), index.words + 1, dtype=np.int64)
    live = np.flatnonzero(h_length > 0)
    pos = 0
    while len(live):
        c = h_codes[h_first[live] + pos]
        lo[live], hi[live] = index.rank(c, lo[live]), index.rank(c, hi[live])
        pos += 1
        live = live[(lo[live] < hi[live]) & (h_length[live] > pos)]

    q = np.arange(len(words))
    pos, lo, hi = exact.astype(np.int64), lo[half], hi[half]
    alive = lo < hi
    q, pos, lo, hi = q[alive], pos[alive], lo[alive], hi[alive]
    none = np.zeros(0, dtype=np.int64)
    err = (none, none, none, none)  # words after their error: query, place in it, interval
    done_q, done_t = [], []
    while len(q) or len(err[0]):
        more = []
        if len(q):
            c = at_pos(q, pos)
            inside = pos < last[q]
            low, high = index.ranks(lo), index.ranks(hi)
            row, x = np.nonzero(high > low)
            fits = (x > 0) & (x != c[row]) & (x != absent)
            row, x = row[fits], x[fits]
            a, b = low[row, x].astype(np.int64), high[row, x].astype(np.int64)
            sub = inside[row]
            more.append((q[row][sub], pos[row][sub] + 1, a[sub], b[sub]))  # replaced
            more.append((q[row], pos[row], a, b))  # inserted
            gone = inside & (c != at_pos(q, pos + 1))
            more.append((q[gone], pos[gone] + 1, lo[gone], hi[gone]))  # deleted
            on = np.flatnonzero(inside & (c != absent))
            a, b = low[on, c[on]].astype(np.int64), high[on, c[on]].astype(np.int64)
            stay = (a < b) & ((pos[on] + 1 < last[q[on]]) | (last[q[on]] == length[q[on]]))
            q, pos, lo, hi = q[on][stay], pos[on][stay] + 1, a[stay], b[stay]
        eq, ep, ea, eb = (np.concatenate(z) for z in zip(err, *more, strict=True))
        c = at_pos(eq, ep)
        end = c < 0
        c[end] = 0
        fits = c != absent
        eq, ep, ea, eb, c, end = (z[fits] for z in (eq, ep, ea, eb, c, end))
        ea, eb = index.rank(c, ea), index.rank(c, eb)
        fits = ea < eb
        over = fits & end
        done_q.append(eq[over])
        done_t.append(ea[over] - 1)
        go = fits & ~end
        err = (eq[go], ep[go] + 1, ea[go], eb[go])
    return np.concatenate([none, *done_q]), np.concatenate([none, *done_t])


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def near_in(texts: list[bytes], asked: list[bytes], gap_from: np.ndarray, gap_to: np.ndarray, leftwards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(number in asked, number in texts)`` of words that differ by one character, first in the asked word's gap; ``texts`` are sorted."""
    out_q, out_t = [], []
    forth = np.flatnonzero(~leftwards)
    if len(forth):
        order = sorted(range(len(texts)), key=lambda i: texts[i][::-1])
        # Rightwards: the words as they are, over the index of the reversed ones.
        q, t = search(SuffixRanks([texts[i][::-1] for i in order]), [asked[i] for i in forth.tolist()], gap_from[forth], gap_to[forth])
        out_q.append(forth[q])
        out_t.append(np.array(order, dtype=np.int64)[t])
    back = np.flatnonzero(leftwards)
    if len(back):
        words = [asked[i][::-1] for i in back.tolist()]
        size = np.array([len(w) for w in words], dtype=np.int64)
        q, t = search(SuffixRanks(texts), words, size - gap_to[back], size)
        keep = np.array([gap_from[back[i]] <= _shared(asked[back[i]], texts[j]) < gap_to[back[i]] for i, j in zip(q.tolist(), t.tolist(), strict=True)], dtype=bool)
        out_q.append(back[q][keep])
        out_t.append(t[keep])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_t])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each search of a shard: how many words it finds, and the most frequent of them."""
    for group in grouped(batches, ["shard"]):
        told = [w.encode("latin-1") for w in group.column("word").to_pylist()]
        n = group.column("n").to_numpy()
        texts = sorted(set(told))
        number = {w: i for i, w in enumerate(texts)}
        own = np.fromiter((number[w] for w in told), dtype=np.int64, count=len(told))
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[own] = n
        at = np.flatnonzero(group.column("asks").to_numpy(zero_copy_only=False))
        asked = [told[i] for i in at.tolist()]
        a, b = (group.column(c).to_numpy()[at].astype(np.int64) for c in ("a", "b"))
        q, t = near_in(texts, asked, a, b, group.column("leftwards").to_numpy(zero_copy_only=False)[at])
        order = np.lexsort((t, -counts[t], q))
        q, t = q[order], t[order]
        lead = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
        found = np.bincount(q, minlength=len(asked))
        best, best_n = np.full(len(asked), None, dtype=object), np.zeros(len(asked), dtype=np.int64)
        best[q[lead]], best_n[q[lead]] = [texts[i].decode("latin-1") for i in t[lead].tolist()], counts[t[lead]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in asked], pa.string()), pa.array(n[at], pa.int64()), pa.array(found, pa.int64()), pa.array(best.tolist(), pa.string()), pa.array(best_n)], ["word", "n", "n_near", "best", "best_n"]
        )


def _halved(filed: DataFrame) -> DataFrame:
    """Each row twice, for the later and the earlier part of the gap in which the error may lie, with the key of what must be equal outside."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(mid.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), mid.alias("b")))
    out = filed.withColumn("gap", F.explode(halves)).withColumns({"a": F.col("gap.a"), "b": F.col("gap.b")}).drop("gap")
    tail = F.col("of") - F.col("b")  # characters after the gap
    same = F.struct(F.col("of"), F.col("a"), F.col("b"), F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.char_length("word") - tail + 1, tail))
    return out.withColumn("key", F.xxhash64(same))


def near_words(vocab: DataFrame, scratch: Scratch, *, shard: int = SHARD, hot: int = HOT, least: int = LEAST) -> DataFrame:
    """``word, n, n_near, best, best_n``: near words of each word of a written table ``(word, n)``, and the most frequent of them, the first in code-point order on ties.

    ``of`` is the length of the words that look for a row; ``a`` to ``b`` are the
    places of such a word in which the first difference lies.
    """
    size = F.char_length("word")
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda n: n >= least)
    whole = vocab.select("word", "n", F.explode(lengths).alias("of")).withColumn("asks", F.col("of") == size)
    filed = _halved(whole.withColumns({"a": F.lit(0), "b": F.col("of")}))
    filed = filed.withColumn("leftwards", F.col("b") < F.col("of"))
    small: list[DataFrame] = []
    while True:
        wide = F.col("b") - F.col("a") > 1
        full = filed.where(wide).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot).select("key")
        full = scratch.keep(full, "full")
        if full.isEmpty():
            small.append(filed)
            break
        marked = filed.join(full.withColumn("cut", F.lit(True)), "key", "left")
        marked = marked.withColumn("cut", F.coalesce("cut", F.lit(False)) & wide)
        marked = scratch.keep(marked, "filed")
        small.append(marked.where("NOT cut").drop("cut"))
        filed = _halved(marked.where("cut").drop("cut", "key"))
    columns = ["word", "n", "asks", "a", "b", "leftwards", "key"]
    rows = small[0].select(*columns)
    for more in small[1:]:
        rows = rows.unionByName(more.select(*columns))
    shards = max(1, -(-6 * vocab.count() // shard))
    dealt = rows.withColumn("shard", F.pmod("key", F.lit(shards))).drop("key").repartition("shard").sortWithinPartitions("shard")
    parts = dealt.mapInArrow(released(_near), "word string, n long, n_near long, best string, best_n long")
    best = F.min_by(F.struct("best", "best_n"), F.struct((-F.col("best_n")).alias("m"), F.col("best"))).alias("b")
    return parts.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", F.col("b.best").alias("best"), F.col("b.best_n").alias("best_n"))


def last_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` from a written table ``(word, form)``: the form at the end of each chain, by doubling the steps of all chains.

    A form occurs ``ratio`` times as often as its word, so chains are short and never closed.
    """
    ahead = forms.select("word", F.col("form").alias("root"))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.keep(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ahead


def spelling_forms(
    docs: DataFrame, *, least: int = LEAST, often: int = OFTEN, ratio: int = RATIO, every: int | None = TYPOS, shard: int = SHARD, hot: int = HOT
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the vocabulary of ``docs(doc_id, text)``.

    Words are counted over whole texts (see ``vocabulary``); two are near if they
    differ by one inserted, deleted or replaced character. A word's form is its
    near word of largest ``n``, the first in code-point order on ties, if that has
    at least ``ratio`` times the word's ``n``, else null; the root is where the
    forms of forms end, the word itself without a form. Null and empty texts have
    no words; repeated rows count each; words may be of any length; extra columns
    are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "spelling")
    vocab = scratch.keep(vocabulary(docs, least=least, often=often, every=every), "vocab")
    near = near_words(vocab, scratch, shard=shard, hot=hot, least=least)
    fits = (F.col("n_near") > 0) & (F.col("best_n") >= ratio * F.col("n"))
    told = near.select("word", "n", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    told = scratch.keep(told, "told")
    roots = last_forms(told.where("form IS NOT NULL").select("word", "form"), scratch)
    out = told.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
