"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult (learned, weighted), threat, target, negation, report, other. Five transducers, one for
each of these, are composed into one; it reads a clause and weighs each insult by what stands around it: less after a
negation or a reporting verb, more with a target, and a threat counts with a target only. The document's score is a
logistic function of its weightiest clause and of the sum of its clauses, fitted with the lexicon.

The insult lexicon is learned from at most SAMPLE labelled rows outside the held-out fold: words and word beginnings
whose likelihood ratio against the number of candidates tried rules out chance, all of them, so the lexicon is bounded
by that sample alone. Every document is scored on its whole
text; labels, lang, source and doc_id never enter a score.

Edge cases: null or empty text has no clause and scores the constant of the fit; rows that repeat an id are scored
each; without usable labels the lexicon is empty; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, table
from .near_dedup import shingles
from .quality import training

SAMPLE, LEAST = 8000, 4.0
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
BREAKS = frozenset(".!?;\n")
FORMS = (4, 5, 6, 7)
_MEMO = 150_000
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Closed word classes of the grammar.
WORDS = {
    THREAT: "kill hurt destroy burn beat shoot stab töten umbringen schlagen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours u du dich dein deine ihr tu toi ton vous votre tú ti tus usted ustedes",
    NEGATION: "not never no nicht kein keine nie pas jamais non nunca jamás",
    REPORT: "said says wrote writes quoted called reported sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
CLASS = {word: kind for kind, text in WORDS.items() for word in text.split()}
NEGATED, REPORTED, TARGETED, THREATENED, REACH = 0.5, 0.6, 1.25, 1.0, 3


def _counter(mark: int, most: int):
    """Transducer that remembers for `most` words that a word of class `mark` was read (0: for the whole clause)."""

    def step(state: int, kind: int) -> int:
        if kind == mark:
            return most or 1
        return max(0, state - 1) if most else state

    return range((most or 1) + 1), step


def composed() -> dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], float]]:
    """The product of the transducers: (state, class) -> (next state, factor of an insult read here)."""
    parts = [_counter(NEGATION, REACH), _counter(REPORT, 0), _counter(TARGET, 0), _counter(THREAT, 0)]
    arcs = {}
    for state in product(*[states for states, _ in parts]):
        for kind in range(6):
            factor = (NEGATED if state[0] else 1.0) * (REPORTED if state[1] else 1.0) if kind == INSULT else 0.0
            arcs[state, kind] = tuple(step(s, kind) for s, (_, step) in zip(state, parts, strict=True)), factor
    return arcs


ARCS = composed()
START = (0, 0, 0, 0)


def forms(word: str) -> list[str]:
    return [word + "$", *[word[:k] for k in FORMS if len(word) >= k]]


class Grammar:
    def __init__(self, lexicon: dict[str, float], constants=(0.0, 0.0, 0.0)):
        self.lexicon, self.constants = lexicon, constants
        self.memo: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        got = self.memo.get(word)
        if got is None:
            weight = self.lexicon.get(word + "$")  # what is known of the whole word goes before its beginnings
            if weight is None:
                weight = max((self.lexicon.get(f, 0.0) for f in forms(word)), default=0.0)
            got = (INSULT, weight) if weight else (CLASS.get(word, OTHER), 0.0)
            if len(self.memo) < _MEMO:
                self.memo[word] = got
        return got

    def clauses(self, text: str | None):
        """(first and last token, weight) of each clause with an insult or a threat to a target."""
        tokens = TOKEN.findall((text or "").lower())
        state, weight, begin = START, 0.0, 0
        read, arcs = self.read, ARCS
        for i, token in enumerate(tokens):
            if token in BREAKS:
                if weight or state[3]:
                    yield begin, i, self._weigh(state, weight)
                state, weight, begin = START, 0.0, i + 1
                continue
            kind, own = read(token)
            if kind or state[0]:
                state, factor = arcs[state, kind]
                weight += own * factor
        if weight or state[3]:
            yield begin, len(tokens), self._weigh(state, weight)

    def _weigh(self, state, weight: float) -> float:
        threat = THREATENED if state[3] and state[2] else 0.0
        return weight * (TARGETED if state[2] else 1.0) + threat

    def figures(self, text: str | None) -> tuple[float, float]:
        weights = [w for _, _, w in self.clauses(text)]
        return max(weights, default=0.0), float(np.log1p(sum(weights)))

    def score(self, text: str | None) -> float:
        c, a, b = self.constants
        x, y = self.figures(text)
        return float(1 / (1 + np.exp(-np.clip(c + a * x + b * y, -35, 35))))


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights (log ratios) of the forms that mark toxic rows beyond chance."""

    def run(batches):
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                found = {f for w in set(TOKEN.findall((text.as_py() or "").lower())) for f in forms(w)}
                n[y.as_py() == 1] += 1
                (toxic if y.as_py() == 1 else clean).update(found)
        terms = list(toxic.keys() | clean.keys())
        out = [["", *terms], [n[1], *[toxic[t] for t in terms]], [n[0], *[clean[t] for t in terms]]]
        for i in range(0, len(terms) + 1, 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000], t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["term", "a", "b"])

    counts = rows.select("text", "y").mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = counts.persist()
    try:
        whole = counts.where("term = ''").first()
        if whole is None or not whole["a"] or not whole["b"]:
            return {}
        n1, n0 = whole["a"], whole["b"]
        candidates = counts.where("term <> '' AND a >= 3").count()
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        both, share = a + b, n1 / (n1 + n0)
        part = lambda k, p: F.when(k > 0, k * F.log(k / (both * p))).otherwise(0.0)
        ratio = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
        strong = counts.where("term <> '' AND a >= 3").select("term", ratio.alias("w"), (part(a, share) + part(b, 1 - share)).alias("g"))
        strong = strong.where((F.col("w") > LEAST) & (F.col("g") > float(np.log(max(1, candidates)) + 1)))
        found = {r["term"]: r["w"] for r in strong.collect()}
        # Whole words that clean rows use, too, though a marked beginning covers them.
        starts = sorted(t for t in found if not t.endswith("$"))
        covered = F.lit(False)
        for k in FORMS:
            covered = covered | F.substring("term", 1, k).isin([t for t in starts if len(t) == k])
        spared = counts.where(F.col("term").endswith("$") & (F.col("b") >= 2) & covered).select("term", ratio.alias("w"))
        return found | {r["term"]: max(0.0, r["w"]) for r in spared.collect() if r["term"] not in found}
    finally:
        counts.unpersist()


def unlike(rows: DataFrame) -> DataFrame:
    """One of the rows that share their least hash of three words and their label, so near copies do not count as evidence."""

    def run(batches):
        memo: dict[str, int] = {}
        for batch in batches:
            least = [int(own.view(np.int64).min()) if len(own := shingles(t.as_py(), 3, memo)) else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), *batch.columns], names=["k", "l_id", "text", "y"])

    keyed = rows.select(F.col("l_id").cast("long"), "text", "y").mapInArrow(run, "k long, l_id long, text string, y int")
    return keyed.groupBy("k", "y").agg(F.min_by("text", "l_id").alias("text")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    every = materialize(training(docs, labels, "toxic", sample).select("l_id", "text", "y"), "toxic-sample")
    rows = materialize(unlike(every), "toxic-unlike")
    words = lexicon(rows)
    if not words:  # too few unlike rows to rule out chance: copies count as well
        rows = every
        words = lexicon(rows)

    def run(batches):
        own = Grammar(words)
        for batch in batches:
            x = [own.figures(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in x], pa.float64()), pa.array([q for _, q in x], pa.float64()), batch.column(1)], names=["p", "q", "y"])

    got = rows.select("text", "y").mapInArrow(run, "p double, q double, y int").toArrow()
    got = got.sort_by([("p", "ascending"), ("q", "ascending"), ("y", "ascending")])
    y = got["y"].to_numpy().astype(float) if len(got) else np.zeros(0)
    x = np.column_stack([np.ones(len(y)), got["p"].to_numpy(), got["q"].to_numpy()]) if len(y) else np.zeros((0, 3))
    constants = np.zeros(3)
    penalty = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ constants, -35, 35)))
        gradient = x.T @ (p - y) + penalty @ constants
        constants = constants - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, gradient).clip(-2, 2)
    return Grammar(words, tuple(constants))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast((grammar.lexicon, grammar.constants))

    def run(batches):
        own = Grammar(*held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
