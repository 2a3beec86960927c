"""Toxicity by a weighted finite-state grammar over clauses.

Words and marks map to terminals: insults and threats with a weight, targets,
negations, verbs of reported speech, soft marks, quotes and stops. Five small
transducers are given as transition tables. Negation and target hold for a few
words (target is read from both sides), reported speech to the end of the
clause, and from a verb right before it over a colon, comma or into quotes;
insult and threat put out the weight of their word. Their product is composed
once: a state of it names the pattern under which a weight comes out, such as
"insult, aimed, not negated, not reported". A clause counts once for a pattern,
with its best weight. A document's score is the logistic function of the
clauses' sums by pattern.

Insult terminals are learned from labelled rows: words, and beginnings of words
for inflected forms, that toxic rows hold far more often than others. The arc
weights of the patterns are fitted on the same rows around hand-set values, so a
pattern that the labels never show keeps its hand-set weight.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.llm.common import Scratch, released, ship, window_hashes, word_hashes

#: Labelled rows that the model is fitted on at most, chosen by a hash of their id.
MAX_ROWS = 20_000
#: Terminals that are learned at most, the best first.
MAX_TERMS = 4_000
#: Least likelihood ratio (G squared) and log odds of a learned terminal.
MIN_G2, MIN_ODDS, MIN_ROWS = 24.0, 2.0, 4
#: Words whose terminals a task remembers.
MEMO = 40_000
STEMS = range(4, 8)
SCOPE = 4
THRESHOLD = 0.7

# Terminals that need no labels.
_INSULT = "idiot moron imbecile scum trash worthless pathetic disgusting clown loser stupid dumb bastard idiota imbécil estúpido idiote débile crétin dummkopf trottel abschaum".split()
_THREAT = "kill killing murder hurt stab shoot strangle destroy töten umbringen tuer tuerai matar mataré".split()
_TARGET = "you your yours u he she they them him her dich dir du ihr euch tu toi te vous tú usted ustedes ellos".split()
_NEGATION = "not no never nobody isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
_REPORT = "said says say told claimed claims reported wrote writes quoted called alleged sagte sagt schrieb behauptet dit disait écrit prétend dijo dice escribió afirma".split()

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.,;:!?|()\"\n«»„“”]")
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, SOFT, QUOTE, STOP, BREAK = range(10)
_MARKS = dict.fromkeys(",:", SOFT) | dict.fromkeys("\"«»„“”", QUOTE) | dict.fromkeys(".;!?|()", STOP) | {"\n": BREAK}
_FIXED = {w: k for k, ws in ((INSULT, _INSULT), (THREAT, _THREAT), (TARGET, _TARGET), (NEGATION, _NEGATION), (REPORT, _REPORT)) for w in ws}
_TERMINALS = range(10)


def _scope(trigger: int) -> list[list[int]]:
    """Transducer that holds for ``SCOPE`` words after ``trigger``; state 0 is off. Rows are states, columns terminals."""
    return [[SCOPE if t == trigger else 0 if t >= SOFT else max(0, s - 1) for t in _TERMINALS] for s in range(SCOPE + 1)]


# States of reported speech: none, a verb just now, one word ago, further back in the clause, carried over a mark, in quotes.
_PLAIN_SPEECH, _VERB, _NEAR, _CLAUSE, _CARRIED, _QUOTED = range(6)


def _reported() -> list[list[int]]:
    """Transducer of reported speech; all states but 0 mean reported."""
    out = []
    for s in range(6):
        row = [{_VERB: _NEAR, _NEAR: _CLAUSE}.get(s, s)] * len(_TERMINALS)
        row[REPORT] = s if s == _QUOTED else _VERB
        row[SOFT] = {_VERB: _CARRIED, _NEAR: _CARRIED, _CLAUSE: _PLAIN_SPEECH}.get(s, s)
        row[QUOTE] = _PLAIN_SPEECH if s in (_PLAIN_SPEECH, _QUOTED) else _QUOTED
        row[STOP] = s if s == _QUOTED else _PLAIN_SPEECH
        row[BREAK] = _PLAIN_SPEECH
        out.append(row)
    return out


def compose(*machines: list[list[int]]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Product of transducers that read the same input: its transition table, and the states of each of its states."""
    states = list(itertools.product(*(range(len(m)) for m in machines)))
    number = {s: i for i, s in enumerate(states)}
    return [[number[tuple(m[x][t] for m, x in zip(machines, s, strict=True))] for t in _TERMINALS] for s in states], states


#: Patterns: kind (insult, threat) x aimed x negated x reported.
PATTERNS = 16
#: Hand-set arc weights: (insult, threat), and factors for aimed, negated, reported.
_BASE, _AIMED, _NEGATED, _REPORTED = (0.8, 0.8), 1.4, 0.25, 0.3
_BIAS = -3.0


def hand_set() -> np.ndarray:
    w = [_BASE[p & 1] * (_AIMED if p & 2 else 1) * (_NEGATED if p & 4 else 1) * (_REPORTED if p & 8 else 1) for p in range(PATTERNS)]
    return np.array([_BIAS, *w])


#: The composed machine, and the part of a pattern that each state gives.
_NEXT, _STATES = compose(_scope(NEGATION), _scope(TARGET), _reported())
_PATTERN = [(aimed > 0) << 1 | (negated > 0) << 2 | (speech > 0) << 3 for negated, aimed, speech in _STATES]
_AHEAD = _scope(TARGET)


class _Kinds(dict):
    """Word -> (terminal, weight), worked out once a word."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > MEMO:
            self.clear()
        got = (_MARKS[word], 0.0) if word in _MARKS else (_FIXED.get(word, NONE), 1.0)
        if got[0] in (NONE, INSULT):
            forms = [word, *(word[:n] + "*" for n in STEMS if n <= len(word))]
            best = max((self.terms.get(x, 0.0) for x in forms), default=0.0)
            if best > 0:
                got = (INSULT, max(best, got[1] if got[0] == INSULT else 0.0))
        self[word] = got if got[0] != NONE else _PLAIN
        return self[word]


_PLAIN = (NONE, 0.0)


@dataclass
class Grammar:
    """Learned terminals and arc weights (bias first)."""

    terms: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=hand_set)

    def __post_init__(self):
        self.kinds = _Kinds(self.terms)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def sums(self, text: str | None) -> np.ndarray:
        """Best weight of each clause by pattern, summed over the clauses."""
        kinds = list(map(self.kinds.__getitem__, _TOKEN.findall((text or "").lower())))
        out = np.zeros(PATTERNS)
        if any(k in (INSULT, THREAT) for k, _ in set(kinds)):
            for best in clauses(kinds):
                for p, w in best.items():
                    out[p] += w
        return out

    def score(self, sums: np.ndarray) -> float:
        z = float(self.weights[0] + np.log1p(sums) @ self.weights[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def clauses(kinds: list[tuple[int, float]]) -> Iterator[dict[int, float]]:
    """Best weight by pattern of each clause that puts out any, from one pass of the composed machine over terminals."""
    ahead, s = bytearray(len(kinds)), 0
    for i in range(len(kinds) - 1, -1, -1):  # the target transducer, from the right
        ahead[i] = s > 0
        s = _AHEAD[s][kinds[i][0]]
    s, best = 0, {}
    for i, (k, w) in enumerate(kinds):
        if k in (INSULT, THREAT):
            p = _PATTERN[s] | ahead[i] << 1 | (k == THREAT)
            best[p] = max(best.get(p, 0.0), w)
        elif k >= SOFT and best:
            yield best
            best = {}
        s = _NEXT[s][k]
    if best:
        yield best


def _forms(text: str) -> set[str]:
    words = set(_TOKEN.findall(text.lower())) - _MARKS.keys()
    return words | {w[:n] + "*" for w in words for n in STEMS if n <= len(w)}


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic weights (bias first) nearest to the hand-set ones, by Newton steps."""
    prior = hand_set()
    w = prior.copy()
    a = np.column_stack([np.ones(len(x)), np.log1p(x)])
    ridge = np.full(len(w), strength)
    ridge[0] = 0.01
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * (w - prior)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """About ``max_rows`` of the rows ``(doc_id, toxic)`` with a label, all if there are fewer, chosen by a hash of doc_id."""
    labels = labels.where("toxic IS NOT NULL")
    share = min(1.0, max_rows / max(labels.count(), 1))
    return labels.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20)) < int(share * (1 << 20)))


def learn(labelled: DataFrame, *, max_terms: int = MAX_TERMS) -> Grammar:
    """Grammar from ``labelled(doc_id, text, toxic)``, a bounded table (see ``sampled``); rows with a null label are left out.

    Of rows that are near copies (same least shingle and label) one is used.
    Without rows of both labels the grammar keeps its fixed terminals and weights.
    """
    spark = labelled.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    rows = labelled.where("toxic IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic")
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column(1):
                h = window_hashes(word_hashes(text.as_py().encode().lower()), 5)
                least.append(int(h.min().view(np.int64)) if len(h) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "least"])

    rows = rows.mapInArrow(released(sketch), "doc_id long, text string, toxic int, least long")
    rows = scratch.keep(rows.withColumn("least", F.coalesce("least", F.xxhash64("doc_id"))).dropDuplicates(["least", "toxic"]).drop("least"), "rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(1), batch.column(2), strict=True):
                seen[toxic.as_py()].update(_forms(text.as_py()))
            terms = list(seen[0].keys() | seen[1].keys())
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([seen[1][t] for t in part], pa.int64()), pa.array([seen[0][t] for t in part], pa.int64())], ["term", "bad", "good"]
                )

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Grammar()
    terms = rows.mapInArrow(released(count), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    k = F.col("bad") + F.col("good")
    part = lambda x, rate: F.when(x > 0, x * F.log(x / (k * rate))).otherwise(0.0)
    g2 = 2 * (part(F.col("bad"), bad / (bad + good)) + part(F.col("good"), good / (bad + good)))
    terms = terms.where(F.col("bad") >= MIN_ROWS).select("term", odds.alias("odds"), g2.alias("g2"))
    terms = terms.where((F.col("odds") >= MIN_ODDS) & (F.col("g2") >= MIN_G2)).orderBy(F.desc("g2"), "term").limit(max_terms).collect()
    grammar = Grammar({r.term: min(2.0, r.odds / 3) for r in terms})

    shared = spark.sparkContext.broadcast(grammar)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            sums = [g.sums(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float64())), batch.column(2)], ["x", "y"])

    got = rows.mapInArrow(released(measure), "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "x").collect()
    n = [r.n for r in got]
    x, y = np.repeat(np.array([r.x for r in got]), n, axis=0), np.repeat(np.array([r.y for r in got], dtype=float), n)
    return Grammar(grammar.terms, fit_weights(x, y))


def score(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs(text, ...)`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    A null or empty text has no clause and gets the score of a text without any
    match. Rows are scored one by one, whole; repeated rows come back each. A
    column named like an added one is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(grammar)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            scores = [g.score(g.sums(t.as_py())) for t in batch.column(at).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])
        g.kinds.clear()

    out = plain.mapInArrow(released(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", score double")
    return out.toDF(*names, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
