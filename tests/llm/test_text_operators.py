"""HTML, mixing, toxicity, line dedup, pieces, chat and URLs against brute force or exact round trips."""

import hashlib
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgrid.llm import chat, html, linededup, mixing, pieces, queries, toxicity, urls

PIECES = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
WORDS = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><script>x</script>", ""),
        ("<article><p>a  &lt; b &amp;amp;\n c<br>d</p><p>e</p></article>", "a < b &amp; c d\ne"),
        ("<nav>m<ul><li>x</nav><article><h1>T</h1><div class='ad'>buy</div><p>one</p><form>f</form><p>two</p></article><footer>f</footer>", "T\none\ntwo"),
        ("<nav>never closed <article><p>in<footer>f</footer><p>out</article>", "in\nout"),
        ("<article><p>t</p><section id='comments'><p>me too</p></section></article><!-- <p>no</p> -->", "t"),
        ("<article><p>1 < 2</p><p title='a > b'>q</p></article>", "1 < 2\nq"),
        ("<article><p>Main text<aside><p>Buy now advert text.</p></aside>", "Main text"),
        ("<main><p>Intro<nav><p>Home | About</p></nav>", "Intro"),
        ("<article><ul><li>one<ul class='menu'><li>entry<li>more</ul><li>two</ul></article>", "one\ntwo"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><p>x<p>y</article>", "a\nb\nc\nx\ny"),
        ("<article><h2 class='alert-level'>Storm alert levels</h2><p>text</article>", "Storm alert levels\ntext"),
        ("<p title='" + "x" * 50_000 + " > leak words'>Real text</p>", "Real text"),
        ("<div class='legal-notice-article'><p>article</p></div><div class='ad-article'>buy</div>", "article"),
        ("<article><p>a <svg><path></p><p>out</p></article>", "a\nout"),
        ("<p>x</p><svg><path d=1><p>after</p>", "x\nafter"),
        ("<article><p>a <button>Share</button><span class=ad>buy</span>b</p><select><option>n</select><p>c<svg><text>t</text></svg></p></article>", "a b\nc"),
        ("<div><object>fallback</div><p>real</p><template><p>no</p></template>", "real"),
        ("<p>before</p><script>never closed <p>no</p>", "before"),
        ("<article><p>" + "<svg>" * 5_000 + "</p><p>z</p></article>", "z"),
        ("<p>" + "word " * 200_000 + "</p>", ("word " * 200_000).strip()),
        ("<div><a href=x>Home</a></div><p>Real text</p><div class=ad>buy</div>", "Real text"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_unmarked_page_by_distribution():
    body = "<div><a href=x>Home</a> <a href=y>News</a></div>" * 5 + f"<h1>Title</h1><div>{'long text ' * 30}</div><div>short</div>" + "<div></div>" * 3
    got = html.main_text(f"<html><body>{body}<div class='cookie-notice'>{'accept ' * 40}</div></body></html>")
    assert got.startswith("Title\nlong text") and got.endswith("short") and "Home" not in got and "accept" not in got


LONG = "long article text " * 20


@pytest.mark.parametrize(
    "aside",
    [
        "<aside><article>teaser</article></aside>",
        "<footer><main>teaser</main></footer>",
        "<section class='comments'><article><p>" + "teaser me too " * 20 + "</p></article></section>",
        "<article class='comment'>" + "teaser me too " * 20 + "</article>",
        "<ul>" + "<li><a href=x>Read on</a></li>" * 5 + "</ul><article>teaser</article>",
    ],
)
def test_articles_beside_an_unmarked_body(aside):
    assert html.main_text(f"<body><div>{LONG}</div>{aside}</body>") == LONG.strip()
    assert html.main_text(f"<body>{aside}<div>{LONG}</div></body>").endswith(LONG.strip())


def test_article_mark_adds_weight():
    links = "<div><a href=x>Home</a></div>" * 3
    both = html.main_text(f"<article><p>short</p><p>{LONG}</p></article>{links}<div>{LONG.upper()}</div>{links}<div>tiny</div>")
    assert both == f"short\n{LONG.strip()}\n{LONG.upper().strip()}"
    assert html.main_text("<main class='has-sidebar'><p>x</p></main>") == "x"
    assert html.main_text("<article hidden><p>x</p></article><main><p>y</p></main>") == "y"
    assert html.main_text("<nav>open <aside><article>teaser</article></aside><article>in</article>") == "in"


def by_definition(lines, window=3, surge=86):
    """A line stays if a surge stands at it or before it with no empty window between; read off line by line."""
    open_text = sum(len(t) for t, w, _, _ in lines if w >= 0)
    share = sum(len(t) for t, w, m, _ in lines if w >= 0 and m) / max(1, open_text)
    extra = lambda k: share * surge if lines[k][2] and lines[k][1] >= 0 else 0
    mass = lambda k: sum(max(0, w) for _, w, _, _ in lines[k : k + window]) + extra(k)
    surges = [k for k in range(len(lines)) if mass(k) >= surge and (lines[k][1] > 0 or extra(k) > 0)]
    kept = {j for j in range(len(lines)) if lines[j][1] >= 0 and any(i <= j and all(mass(k) > 0 for k in range(i, j + 1)) for i in surges)}
    firsts = {i for i in surges if not any(h < i and all(mass(k) > 0 for k in range(h, i + 1)) for h in surges)}
    kept |= {i - 1 for i in firsts if i and lines[i - 1][3] in ("h1", "h2") and lines[i - 1][1] > 0}
    kept = kept if surges else {j for j in range(len(lines)) if lines[j][1] > 0}
    return "\n".join(lines[j][0] for j in sorted(kept))


def test_distribution_by_definition(spark, data):
    rng = random.Random(11)
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect() if r.html]
    for _ in range(300):
        kinds = ["<p>%s</p>", "<div><a href=x>%s</a></div>", "<div class=ad>%s</div>", "<article><p>%s</p></article>", "<h2>%s</h2>", "<div>%s</div>"]
        pages.append("".join(rng.choice(kinds) % ("words " * rng.choice([1, 1, 2, 5, 20])) for _ in range(rng.randint(1, 25))))
    changed = 0
    for page in pages:
        lines = html.to_lines(page)
        assert html.main_text(page) == by_definition(lines)
        changed += html.main_text(page) != "\n".join(t for t, w, _, _ in lines if w >= 0)
    assert changed > 50


class Outline(HTMLParser):
    """A plain reading of a page that has one article: its text by blocks, without the parts that are never text."""

    NEVER = frozenset("nav header footer aside form script style".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.article, self.never, self.blocks = 0, [], [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.article += tag == "article"
        classes = set((dict(attrs).get("class") or "").split()) | {dict(attrs).get("id")}
        if self.never or tag in self.NEVER or classes & {"ad", "comments", "cookie", "notice", "sidebar"}:
            if tag not in ("br", "img", "input", "meta", "link", "hr", "p", "li"):
                self.never.append(tag)
        if tag in html._BLOCK:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.article -= tag == "article"
        if tag in self.never:
            while self.never.pop() != tag:
                pass
        if tag in html._BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if self.article > 0 and not self.never:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_pages_by_another_reading(spark, data):
    pages = [r for r in spark.read.parquet(f"{data}/pages.parquet").collect() if r.html and len(re.findall("(?i)<article", r.html)) == 1]
    assert len(pages) > 40
    assert [r.page_id for r in pages if html.main_text(r.html) != Outline(r.html).text()] == []


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract_pages(pages.withColumn("text", F.lit("x"))).collect()}
    assert len(got) == pages.count()
    assert all(n == len(t) > 0 and "<" not in t for t, n in got.values())
    assert html.extract_pages(pages.where("false")).count() == 0


# ---------------------------------------------------------------- mixing


def water_fill(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.choice([1, 5, 30, 200])) if i % 50 else None, rng.choice(["a", "b", "b", "b", "b", "Z", "é", None])) for i in range(1500)]
    df = spark.createDataFrame([*docs, docs[7], docs[7]], "doc_id long, text string, source string").withColumn("p", F.lit(1)).withColumn("target", F.lit(0))
    got = mixing.mix(df, fan_in=60).collect()
    assert len(got) == 1502
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = water_fill(sizes)
    for s, total in sizes.items():
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == total and r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.005 * want[s]
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = mixing.mix(df.repartition(11), fan_in=60)
    assert sorted((r.doc_id, r.taken) for r in got) == rows(again, "doc_id", "taken") or sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again.collect())
    assert mixing.mix(df.where("false")).count() == 0
    assert {r.taken for r in mixing.mix(df.withColumn("text", F.lit(""))).collect()} == {0}


def test_mix_with_equal_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_CHUNK", 64)
    rng = random.Random(5)
    docs = [(i, prose(rng, 900 if i % 100 == 0 else rng.choice([2, 9, 30])), "ab"[i % 2]) for i in range(2000)]
    docs += [(None, "one of many equal rows", "a")] * 700 + [(None, None, "b")] * 300 + [(7, prose(rng, 4), "b"), (7, prose(rng, 5), "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df, fan_in=40).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((d[0] or -1, len((d[1] or "").split())) for d in docs)
    want = water_fill({s: sum(len((d[1] or "").split()) for d in docs if d[2] == s) for s in "ab"})
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 0.002 * want[s]
    rate = {r.source: r.target / r.source_size for r in got}
    assert all(int(rate[r.source]) <= r.copies <= int(rate[r.source]) + 1 <= 2 or r.copies == 0 for r in got)
    same = [r.copies for r in got if r.doc_id is None and r.source == "a"]
    assert abs(sum(same) / len(same) - rate["a"]) < 0.05
    told = lambda found: sorted(repr((r.doc_id, r["size"], r.taken)) for r in found)
    assert told(mixing.mix(df.repartition(9), fan_in=40).collect()) == told(got)


def test_pivot_keeps_chances_and_leaves_a_short_one():
    p, w = np.full(60, 0.3), np.sort(np.geomspace(1, 400, 60))[::-1]
    rng, sums, left = np.random.default_rng(4), np.zeros(60), []
    for _ in range(4000):
        q = p.copy()
        k = mixing.pivot(q, w, rng.random(60))
        left += [w[k] * min(q[k], 1 - q[k])] if k >= 0 else []
        sums += q
    assert np.abs(sums / 4000 - 0.3).max() < 0.04
    assert max(left) < 20


def test_pivot_keeps_words():
    rng = np.random.default_rng(1)
    for _ in range(50):
        p, w = rng.random(40), rng.integers(1, 50, 40).astype(float)
        total, q = (p * w).sum(), p.copy()
        left = mixing.pivot(q, w, rng.random(40))
        assert (q * w).sum() == pytest.approx(total)
        assert all(x in (0, 1) for i, x in enumerate(q) if i != left)


# ---------------------------------------------------------------- toxicity


def test_clauses():
    g = toxicity.Grammar()
    plain, aimed = g.sums("a stupid thing"), g.sums("you are stupid")
    negated, reported = g.sums("you are not stupid"), g.sums("he said that film is stupid")
    assert plain[0] > 0 and aimed[2] > 0 and negated[6] > 0 and reported[8:].sum() > 0
    assert g.score(aimed) > g.score(plain) > g.score(negated) > g.score(g.sums("")) > 0
    assert g.sums("stupid, stupid")[0] == 2 * g.sums("stupid stupid")[0]


def brute_clauses(kinds):
    """The grammar's rules read off the words around each insult or threat."""
    t = toxicity
    marks, words = {t.SOFT, t.QUOTE, t.STOP, t.BREAK}, [k for k, _ in kinds]
    out, best = [], {}

    def near(i, step, what):
        for d in range(1, t.SCOPE + 1):
            j = i + d * step
            if not 0 <= j < len(words) or words[j] in marks:
                return False
            if words[j] == what:
                return True
        return False

    def reported(i):
        verb, carried, quoted = None, False, False  # words since the verb of this clause
        for w in words[:i]:
            if w == t.REPORT:
                verb, carried = 0, carried and quoted
            elif w == t.BREAK:
                verb, carried, quoted = None, False, False
            elif w == t.STOP:
                verb, carried = (None, False) if not quoted else (verb, carried)
            elif w == t.QUOTE:
                quoted = not quoted and (verb is not None or carried)
                verb, carried = None, False
            elif w == t.SOFT:
                if not quoted:
                    carried, verb = carried or (verb is not None and verb < 2), None
            elif verb is not None:
                verb += 1
        return quoted or carried or verb is not None

    for i, (k, w) in enumerate([*kinds, (t.STOP, 0.0)]):
        if k in (t.INSULT, t.THREAT):
            p = (k == t.THREAT) + 2 * (near(i, -1, t.TARGET) or near(i, 1, t.TARGET)) + 4 * near(i, -1, t.NEGATION) + 8 * reported(i)
            best[p] = max(best.get(p, 0.0), w)
        elif k in marks and best:
            out.append(best)
            best = {}
    return out


def test_composed_machine_by_rules():
    rng = random.Random(8)
    for _ in range(3000):
        kinds = [(k, rng.choice([0.5, 1.0, 2.0])) for k in rng.choices(range(10), weights=[6, 4, 2, 2, 2, 2, 2, 2, 1, 1], k=rng.randrange(1, 25))]
        assert list(toxicity.clauses(kinds)) == brute_clauses(kinds)


def test_reported_speech():
    g = toxicity.Grammar()
    said = g.score(g.sums("you are an idiot"))
    for text in ('He said: "you are an idiot"', 'He wrote, "you are an idiot"', "she said: you are an idiot", 'They wrote "no way. you are an idiot" there'):
        assert g.sums(text)[8:].sum() > 0 and g.sums(text)[:8].sum() == 0 and g.score(g.sums(text)) < said
    for text in ('He said hello. You are an idiot', 'He said "hello" you are an idiot', "he said so last week, you are an idiot", "he said:\nyou are an idiot"):
        assert g.sums(text)[:8].sum() > 0


def test_toxicity(spark):
    rng = random.Random(5)
    docs = []
    for i in range(900):
        words, bad = prose(rng, 40).split(), i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(40), "zork" + rng.choice(["a", "en", "ung"]))
        docs.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.where("doc_id % 3 <> 1"))
    assert any(t.startswith("zork") for t in model.terms)
    more = df.unionByName(spark.createDataFrame([(901, None, 0), (902, "", None)], df.schema)).withColumn("score", F.lit("x"))
    got = toxicity.score(more, model)
    assert got.where("doc_id % 3 = 1 AND toxic <> predicted").count() == 0
    assert got.where("doc_id > 900 AND (score IS NULL OR predicted <> 0)").count() == 0
    assert got.where("score < 0 OR score > 1").count() == 0
    for odd in (df.where("false"), df.where("toxic = 0"), df.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.learn(odd).terms == {}
    assert toxicity.score(df.where("false"), model).count() == 0


def test_toxicity_held_out(spark, data):
    got = queries.op3_toxicity(spark, data.replace("sf0.001", "sf0.01")).join(spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.7
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.02 * len(good)


# ---------------------------------------------------------------- line dedup


def brute_repeats(spark, docs, size, least):
    """Runs of ``size`` words and lines of ``least`` words that an earlier row has, or the same row without overlap."""
    u = [r[0] for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "i long, t string").orderBy("i").selectExpr("xxhash64(t)").collect()]
    keys = [((1 << 63) - 1 if d is None else d, h) for (d, _), h in zip(docs, u, strict=True)]

    def units(text):
        at = 0
        for x in (text or "").split("\n"):
            w = x.encode().split()
            if len(w) >= least:
                yield "line", tuple(w), at, len(w)
            at += len(w)
        w = (text or "").encode().split()
        for i in range(len(w) - size + 1):
            yield "run", tuple(w[i : i + size]), i, size

    first = {}
    for k, (_, t) in zip(keys, docs, strict=True):
        for kind, g, i, _ in units(t):
            first[kind, g] = min(first.get((kind, g), (k, i)), (k, i))
    out = []
    for k, (d, t) in zip(keys, docs, strict=True):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for kind, g, i, n in units(t):
            other, at = first[kind, g]
            if other != k or i - at >= n:
                gone[i : i + n] = [True] * n
        out.append((d, sum(gone), 0 < sum(gone) == len(w), b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode()))
    return sorted(out, key=repr)


def told_repeats(df):
    return sorted(((r.doc_id, r.n_deleted, r.emptied, " ".join((r.text or "").split())) for r in df.collect()), key=repr)


def test_repeats(spark):
    rng = random.Random(9)
    shared = [prose(rng, n) for n in (49, 50, 51, 120)]
    license_ = "Released under the MIT License."
    docs = []
    for i in range(160):
        parts = [prose(rng, rng.randrange(0, 60))] + [rng.choice(shared) for _ in range(rng.randrange(3))] + [prose(rng, rng.randrange(0, 30))]
        docs.append((i, rng.choice(["\n", " "]).join(parts)))
    long = shared[3].split()
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, "same same " * 100), (203, None), (204, ""), (205, shared[3] + " tail"), (206, prose(rng, 5000) + " " + shared[1])]
    docs += [(i, license_ + "\n" + prose(rng, 30)) for i in range(210, 215)] + [(216, "two words\n" * 4 + license_), (217, "ab cd ef gh ij kl\n" * 3)]
    # One passage with a word replaced in the first text: what later texts share goes beyond what they share with the first.
    docs += [(220, " ".join([*long[:70], "other", *long[71:]])), (221, prose(rng, 9) + " " + shared[3]), (222, " ".join([*long[:40], "new", *long[41:]]))]
    # Repeated and null ids on different texts.
    docs += [(300, shared[3]), (300, prose(rng, 20) + " " + shared[3]), (300, prose(rng, 100)), (None, prose(rng, 90)), (None, shared[3] + " x " + prose(rng, 60)), (None, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit("k")).withColumn("starts", F.lit(1)).withColumn("emptied", F.lit(0))
    got = linededup.drop_repeats(df)
    assert got.columns == ["doc_id", "text", "k", "starts", "n_deleted", "spans", "emptied"]
    assert told_repeats(got) == brute_repeats(spark, docs, 50, 5)
    assert got.where("doc_id = 203 AND text IS NULL").count() == 1
    assert linededup.drop_repeats(df.where("false")).count() == 0
    twice = linededup.drop_repeats(df.where("doc_id = 3").union(df.where("doc_id = 3")))
    assert twice.agg(F.sum("n_deleted")).first()[0] == 2 * linededup.drop_repeats(df.where("doc_id = 3")).first().n_deleted


def test_unrelated_texts_of_one_id_stay(spark):
    rng = random.Random(3)
    p, other = prose(rng, 60), prose(rng, 100)
    for i in (2, None):
        df = spark.createDataFrame([(1, p), (i, p + " " + prose(rng, 20)), (i, other)], "doc_id long, text string")
        assert linededup.drop_repeats(df).where(F.col("text") == other).count() == 1


def test_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        run = rng.integers(1, 1 << 60, 50).astype(np.uint64)
        texts = [np.concatenate([rng.integers(1, 1 << 60, rng.integers(0, 90)).astype(np.uint64), run, rng.integers(1, 1 << 60, 40).astype(np.uint64)]) for _ in range(2)]
        lines = [linededup.window_hashes(t, 16) for t in texts]
        a, b = (set(x[linededup.chosen(x, 35)].tolist()) for x in lines)
        assert a & b


# ---------------------------------------------------------------- pieces


def test_pieces_equal_the_library(spark, data):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    m = pieces.machine(pieces.read_model(PIECES))
    rng = random.Random(2)
    alphabet = "ab cdefghij  \n\t\r.,;(){}▁éßñ漢字🙂\x00<s></s>0123"
    texts = ["", " ", "  a ", "<s>", "▁▁x", "a" * 300] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for t in texts:
        ids = m.encode(t)
        assert ids.tolist() == sp.encode(t)
        assert m.decode(ids) == t.replace("▁", " ")


def test_pieces_table(spark):
    model = pieces.read_model(PIECES)
    df = spark.createDataFrame([(1, "Hello  wörld\n"), (2, None), (3, ""), (1, "Hello  wörld\n"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    got = pieces.encode_pieces(df, model)
    assert got.count() == 5 and got.where("NOT decoded_ok OR n_tokens <> size(ids)").count() == 0
    back = pieces.decode_pieces(got, model)
    assert sorted(r.text for r in back.collect()) == sorted(["Hello  wörld\n", "", "", "Hello  wörld\n", "x"])
    assert pieces.encode_pieces(df.where("false"), model).count() == 0


# ---------------------------------------------------------------- chat


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "a<|", "|b", "", None, "\n<|im_end|>\n", "é🙂"]
    table = [(1, 0, "user", nasty[0]), (1, 1, "assistant", nasty[1]), (2, 1, "assistant", nasty[2]), (2, 0, "system", nasty[3]), (2, 2, "ro%0Ale\n<|", nasty[4]), (3, 0, "user", nasty[6])]
    table += [(4, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(5, 0, "user", "x"), (5, 0, "user", "x"), (None, None, None, "q")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    for conv in {r[0] for r in table}:
        turns = sorted(((r[1] if r[1] is not None else -1), r[2] or "", r[3] or "") for r in table if r[0] == conv)
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[1].valid and not got[2].valid and not got[3].valid and not got[5].valid
    one = chat.format_chats(df.where("conv_id = 1")).first()
    assert one.formatted == "<|im_start|>user\n<\\|im_end|><\\|im_start|>assistant ok<|im_end|>\n<|im_start|>assistant\n<\\\\|x<|im_end|>\n"
    assert chat.chat_digests(df.where("false")).count() == 0


# ---------------------------------------------------------------- URLs


def test_urls(spark):
    table = [
        (1, "http://WWW.Example.com/en/1?x#y", None), (2, "https://a.example.com/en/", ""), (3, "https://notexample.com/en/", None), (4, "http://b.net/es/1", None), (5, "http://b.net/de/1", None),
        (6, None, None), (7, "no scheme", None), (8, "http://q.org", '<link rel="canonical" href="http://b.net/fr/9">'), (9, "http://r.org/a", "<meta http-equiv=refresh content='0; url=http://q.org'>"),
        (10, "http://s.org/", '<link href="http://ok.com/" rel=canonical>'), (11, "http://t.org/", '<link rel=canonical href="http://b.net/es/2">'), (12, "http://t.org/#top", None), (9, "http://r.org/a", None),
    ]
    df = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("rule", F.lit("x"))
    got = rows(urls.judge(df, queries.URL_RULES), "page_id", "host", "path", "rule", "verdict")
    want = [
        (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"), (3, "notexample.com", "/en/", "com/", "allow"),
        (4, "b.net", "/es/1", "net/es/", "block"), (5, "b.net", "/de/1", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "q.org", "", None, "block"), (9, "r.org", "/a", None, "block"),
        (9, "r.org", "/a", None, "block"), (10, "s.org", "/", None, "allow"), (11, "t.org", "/", None, "block"), (12, "t.org", "/", None, "block"),
    ]
    assert got == sorted(want, key=repr)
    more = spark.createDataFrame([("http://t.org/", "http://fine.com/x")], "src string, dst string")
    assert {r.verdict for r in urls.judge(df.where("page_id IN (11, 12)"), queries.URL_RULES, more).collect()} == {"allow"}
    assert urls.judge(df.where("false"), queries.URL_RULES).count() == 0


def test_relative_targets(spark):
    bases = ["http://b.net/es/a/b?x=1#t", "https://b.net", "http://b.net/c"]
    tos = ["/es/x", "//c.net/es/x", "x", "../x?y=/../z", "./", "..", "../../../x", "?q=1", "", "#z", "/a/./b/../c", "http://d.org/x#y", " /es/x ", "mailto:a@b", "/login?next=http://d.org/"]
    df = spark.createDataFrame([(b, t) for b in bases for t in tos], "base string, t string")
    for r in df.select("base", "t", urls.resolve(F.col("t"), F.col("base")).alias("got")).collect():
        want = urljoin(r.base, r.t.strip()) if r.t.strip() else r.base
        want = r.base if r.t == "#z" else "https://b.net/" if (r.base, r.t) in {("https://b.net", "./"), ("https://b.net", "..")} else want
        assert r.got == want, (r.base, r.t)
    assert spark.range(1).select(urls.resolve(F.lit("/x"), F.lit(None).cast("string"))).first()[0] is None


def test_references(spark):
    told = {
        "?a=1&amp;b=2": "?a=1&b=2", "&#47;es&#x2F;x": "/es/x", "?a&copy=1&copyx": "?a&copy=1&copyx", "?a&amp": "?a&", "&eacute;&#8364;&#128;&#x1F642;": "é€€🙂", "&#0;&#xD800;&#9999999;": "�" * 3,
        "&none;&;&": "&none;&;&", "": "", "plain": "plain",
    }
    df = spark.createDataFrame([(t,) for t in told], "t string")
    assert {r.t: r.got for r in df.select("t", urls.unescape(F.col("t")).alias("got")).collect()} == told


def test_urls_with_relative_links(spark):
    table = [
        (1, "http://q.net/a", "<link rel=canonical href='/es/a'>"), (2, "http://q.net/fr2/b", '<link rel="canonical" href="../es/b">'), (3, "http://q.org/", "<meta http-equiv=refresh content='0; url=//b.net/es/x'>"),
        (4, "http://q.org/4", "<link rel=canonical href='http://b.org/?a=1&amp;b=2'>"), (5, "http://b.org/?a=1&b=2", "<link rel=canonical href='//b.net/fr/'>"), (6, "http://q.org/6", "<base href='http://b.net/'><link rel=canonical href='fr/6'>"),
        (7, "http://q.org/7", "<link rel=canonical href='/8'>"), (8, None, "<link rel=canonical href='/es/a'>"),
    ]
    got = dict(rows(urls.judge(spark.createDataFrame(table, "page_id long, url string, html string"), queries.URL_RULES), "page_id", "verdict"))
    assert got == {i: "block" for i in range(1, 7)} | {7: "allow", 8: "allow"}


def test_links_in_comments_do_not_count(spark):
    page = "<!-- <link rel=canonical href='http://b.net/es/x'> --><link rel='canonical' href='http://b.net/en/x'><!-- open <link rel=canonical href='/z'>"
    edges = urls.link_edges(spark.createDataFrame([("http://a.net/1", page), (None, page)], "url string, html string")).collect()
    assert [tuple(e) for e in edges] == [("http://a.net/1", "http://b.net/en/x")]
    judged = urls.judge(spark.createDataFrame([(1, "http://b.net/es/x", "<link rel=canonical href='http://c.org/'>"), (2, "http://c.org/", ""), (3, None, page)], "page_id long, url string, html string"), queries.URL_RULES)
    assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "block", 3: "allow"}


def test_all_links_of_a_page(spark):
    pages = [
        (1, "http://a.org/1", "<LINK href='http://x.org/1' rel='alternate  Canonical'>"),
        (2, "http://a.org/2", "<link rel=canonical href='http://x.org/2'><link rel=canonical href='http://b.net/es/2'>"),
        (3, "http://a.org/3", "<meta name=x http-equiv='Refresh' content='5;url=http://x.org/3'><link title='a > b' rel=\"canonical\" href=http://x.org/33>"),
        (4, "http://a.org/4", "<link title='rel=canonical href=http://x.org/4' rel=stylesheet href='http://x.org/4'><link rel=canonicals href=http://x.org/4>"),
        (5, "http://a.org/5", "<link rel='canonical' rel='icon' href='http://x.org/5' href='http://x.org/55'><base target=_top><base href='http://y.org/'><link rel=canonical href='z'>"),
        (6, "http://a.org/6", "<meta content='0; url=http://x.org/6'>" + "<link rel=canonical " + "a " * 20_000 + "href=http://x.org/6>"),
        (7, "http://a.org/7", "canonical <link rel=canonical href=''><link rel=canonical>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = rows(urls.link_edges(df), "src", "dst")
    want = [(1, "x.org/1"), (2, "x.org/2"), (2, "b.net/es/2"), (3, "x.org/3"), (3, "x.org/33"), (5, "x.org/5"), (5, "y.org/z"), (6, "x.org/6")]
    assert got == sorted([(f"http://a.org/{i}", f"http://{to}") for i, to in want], key=repr)
    assert {r.page_id: r.verdict for r in urls.judge(df, queries.URL_RULES).collect()} == {i: "block" if i == 2 else "allow" for i in range(1, 8)}
