"""Centroids, packing and spelling variants against brute force."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specgrid.llm import centroids, common, packing, queries, spelling

WORD_BPE = f"{queries.TOKENIZERS}/word_bpe_49k.json"

# ---------------------------------------------------------------- centroids


def brute_centroids(table, k, rounds, dim):
    kept = [(i, [centroids.on_grid(float(x), 64) for x in v], v) for i, v in table if v is not None and len(v) == dim and None not in v and all(map(math.isfinite, v))]
    first = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[2]))
    c = [g for _, g, _ in first[:k]]
    near = lambda g: min((sum((a - b) ** 2 for a, b in zip(g, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(g)[1] for _, g, _ in kept]
        c = [[sum(col) // len(m) for col in zip(*m)] if (m := [g for (_, g, _), o in zip(kept, own) if o == j]) else x for j, x in enumerate(c)]
    told = [(i, *near(g)[::-1]) for i, g, _ in kept]
    by = Counter()
    for _, j, d in told:
        by[j] += d
    lim = lambda v: v if v < 1 << 63 else None
    # an unknown distance makes the sums unknown
    lost = {j for _, j, d in told if lim(d) is None}
    total = None if lost else lim(sum(by.values()))
    return sorted(((i, j, lim(d), None if j in lost else lim(by[j]), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in told), key=repr)


def run_centroids(df, **kw):
    return sorted(map(tuple, centroids.cluster_vectors(df, **kw)[0].collect()), key=repr)


def test_centroids(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(6, 8))
    table = [(i, [float(x) for x in (heads[i % 6] + rng.normal(size=8) * 0.1).astype(np.float32)]) for i in range(300)]
    table += [(400 + i, [0.5] * 8) for i in range(40)]  # one common vector
    table += [(7, table[7][1]), (7, [1.0] * 8), (None, [2.0] * 8), (None, None), (900, [1.0] * 7), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] + [0.0] * 7), (903, [float("inf")] * 8), (904, [])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(table, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1))
        assert run_centroids(df, k=5, dim=8) == brute_centroids(table, 5, 3, 8)
    assert run_centroids(df.where("vec_id < 3"), k=5, dim=8) == brute_centroids([r for r in table if r[0] is not None and r[0] < 3], 5, 3, 8)
    assert run_centroids(df.where("false"), dim=8) == []


def test_centroids_of_any_size(spark):
    table = [(i, [float(i % 5), float(i % 3)]) for i in range(40)] + [(50, [1e300, -1e307]), (51, [3e8, 0.0]), (52, [-3e8, 1.0]), (53, [3e8, 0.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    for k in (2, 30, 44):
        assert run_centroids(df, k=k, dim=2) == brute_centroids(table, k, 3, 2)


def test_pivots_spare_distances():
    rng = np.random.default_rng(1)
    heads = rng.integers(-1000, 1000, (16, 64))
    x = heads[rng.integers(0, 16, 500)] + rng.integers(-5, 5, (500, 64))
    pivots = centroids.spread_out([h.tolist() for h in heads], 8)
    near = centroids.Nearest([h.tolist() for h in heads], pivots)
    held = np.sqrt(np.stack([((x - np.array(p)) ** 2).sum(axis=1) for p in pivots], axis=1).astype(float))
    cluster, distance = near.of_small(x, held)
    full = ((x[:, None] - heads[None]) ** 2).sum(axis=2)
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert near.tried < 16 * 500 / 4
    assert sum(d << (40 * i) for i, d in enumerate(centroids.digits(-(10**50)))) == -(10**50)


# ---------------------------------------------------------------- packing


def brute_best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(i) if i < len(free) else size) - n)
    return free


def test_best_fit_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(150):
        size = rng.choice([8, 37, 2048])
        counts = Counter(min(size, 1 + int(rng.expovariate(rng.choice([2, 5, 30]) / size))) for _ in range(rng.randrange(1, 1500)))
        runs = packing.best_fit(counts, size).tolist()
        bins = {}
        for i, (n, first, each, seq, offset) in enumerate(runs):
            stop = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else counts[n]
            for k in range(stop - first):
                bins.setdefault(seq + k // each, []).append((offset + k % each * n, n))
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= size
        assert sorted(size - sum(n for _, n in own) for own in bins.values()) == brute_best_fit(counts.elements(), size)


def test_capacities():
    tree, have, rng = packing.Capacities(100), Counter(), random.Random(1)
    for _ in range(500):
        c = rng.randrange(101)
        n = -have[c] if have[c] and rng.random() < 0.5 else 1
        tree.add(c, n)
        have[c] += n
        least = rng.randrange(1, 101)
        assert tree.tightest(least) == min((x for x in have if have[x] and x >= least), default=None)


def test_ids_are_the_librarys():
    words = packing.Words(WORD_BPE)
    assert words.plain
    rng = random.Random(3)
    plain = ["'", "'", "s", "t", "re", "ve", "m", "ll", "d", " ", "\n", "a", "B", "é", "É", "3", "²", "½", "º", "!", '"', "-", "ß", "×", "µ"]
    odd = [*plain, "’", "Σ", "σ", "İ", "\xa0", "\x1c", "\x85", "<|endoftext|>", "́", "中", "\xad", "\t", "\x0b", "\0"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for pool in (plain, odd) for _ in range(1500)] + ["x" * 400_000, "a b " * 200_000, ""]
    lib = Tokenizer.from_file(WORD_BPE)
    for text, ids in zip(texts, words.encode(texts)):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    other = packing.Words(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    assert not other.plain and other.encode(["Hello there"])[0].tolist() == other.tokenizer.encode("Hello there", add_special_tokens=False).ids


def test_pack(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["alpha", "be", "gamma", "x1", "é!"]) for _ in range(rng.choice([1, 3, 8, 20, 90])))) for i in range(400)]
    docs += [(500, None), (501, ""), (None, "a b"), (None, None), (7, docs[7][1]), (502, "long " * 3000)] + [(600 + i, "same words here") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumn("length", F.lit("x")).withColumn("task", F.lit(0))
    got = packing.pack(df, WORD_BPE, size=32, keep_ids=True).collect()
    lib = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, text in docs:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 32)):
            part = ids[a : a + 32]
            want[i, k, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 32
    assert len(bins) == len(brute_best_fit([r.length for r in got], 32))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(df, WORD_BPE, size=32, keep_ids=True)).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in got) and len(whole) == len(bins)
    assert packing.pack(df.where("false"), WORD_BPE).count() == 0


# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(docs, every=31):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = (form, n[w], len(near), n[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted(((w, f, root(w), k, m, fn) for w, (f, k, m, fn) in out.items()), key=repr)


def spelled(rng, letters, heads):
    out = []
    for _ in range(heads):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        for reps in (rng.choice([2, 30, 400]), 20, 2, 2, 2):
            out += [w] * reps
            i, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, c + w])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("letters", "hot"), [("abcdefghijklmnopqrstuvwxyzéüßÿ×÷À", 1 << 14), ("ab", 1 << 14), ("ab", 3), ("abé", 1)])
def test_spelling(spark, letters, hot):
    rng = random.Random(len(letters) + hot)
    words = spelled(rng, letters, 60)
    docs = [(i, rng.choice([" ", ", ", "\n", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    docs += [(9000, None), (9001, ""), (None, " ".join(words[:40])), (None, " ".join(words[:40])), docs[3], docs[3], (9002, "Ăabcdefgh " * 3 + "x" * 300 + " " + "x" * 300 + " " + "x" * 301 + " " + "x" * 301)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("y"))
    got = sorted(map(tuple, spelling.spelling_forms(df, shard=64, hot=hot).collect()), key=repr)
    assert got == brute_spelling(docs)


def test_spelling_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert spelling.spelling_forms(df).count() == 0 and spelling.spelling_forms(df.where("false")).count() == 0
    forms = spark.createDataFrame([(str(i), str(i + 1)) for i in range(13)], "word string, form string")
    assert {r.root for r in spelling.last_forms(forms, common.Scratch(spark, "t")).collect()} == {"13"}


def test_hot_half_is_cut(spark):
    """A first half that all words share is filed finer until no group but the closest is large."""
    words = [("aaaa" + a + b + c + d, 2) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "abcd"]
    vocab = common.Scratch(spark, "t").keep(spark.createDataFrame(words, "word string, n long"))
    got = {r.word: (r.n_near, r.best) for r in spelling.near_words(vocab, common.Scratch(spark, "t"), shard=256, hot=40).collect()}
    every = [w for w, _ in words]
    for w in random.Random(1).sample(every, 25):
        near = [v for v in every if one_edit(w, v)]
        assert got[w] == (len(near), min(near))
