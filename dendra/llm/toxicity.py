"""Toxicity scores from a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, report) and
each sentence is read by one composed transducer over these classes: an insult
or threat opens a match; a target next to it raises its weight, a negation or
a reporting verb in front of it lowers it.  The score of a document comes from
its matched clauses.  Insults are word stems; besides a few fixed ones they
are learned, with their weights, from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import is_held_out, is_training, small_batches, texts

# Labelled rows that the lexicon and weights are fitted on, at most (those with
# the smallest hash of their id), and stems brought to the driver, at most.
FIT_ROWS, FIT_STEMS = 20_000, 50_000
# Shortest stem; documents a learned stem must occur in; its least log odds.
MIN_STEM, MIN_DOCS, MIN_WEIGHT = 4, 5, 2.5
THRESHOLD = 0.7

# Fixed words of the grammar.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic",
           "disgusting", "clown", "imbecile", "bastard", "dumb")
THREATS = ("kill", "destroy", "hurt", "murder", "beat", "burn", "strangle")
TARGETS = ("you", "your", "yourself", "u", "ur", "they", "them", "he", "she", "him", "her",
           "du", "dich", "ihr", "tu", "toi", "vous", "vosotros", "usted")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "pas", "jamais",
             "nunca")
REPORTS = ("said", "says", "say", "wrote", "called", "quoted", "reported", "claimed", "sagte",
           "dit", "dijo")

# Output weights of the transducers' arcs.
TARGET_GAIN, NEGATION_GAIN, REPORT_GAIN = 1.0, -2.0, -1.0
# Words after which an open negation, report or target no longer reaches.
REACH = 3
FIXED_WEIGHT, THREAT_WEIGHT = 3.0, 2.0

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
SENTENCE = re.compile(r"[.!?\n]+")


class Grammar:
    """The composed transducer.  Its state is the distance (in words) to the
    last target, negation and report; reading a word moves to the next state
    and emits the weight of the clause that the word completes."""

    def __init__(self, stems: dict[str, float]):
        self.classes: dict[str, tuple[str, float]] = {}
        for words, name in ((TARGETS, "target"), (NEGATIONS, "negation"), (REPORTS, "report")):
            self.classes.update((w, (name, 0.0)) for w in words)
        self.stems = {**{w: FIXED_WEIGHT for w in INSULTS},
                      **{w: THREAT_WEIGHT for w in THREATS}, **stems}
        self.threats = frozenset(THREATS)
        self.by_first = sorted({len(s) for s in self.stems})
        self.cache: dict[str, tuple[str, float] | None] = {}

    def word_class(self, w: str) -> tuple[str, float] | None:
        """The class of a word: a fixed word, or the longest stem it begins with."""
        if w in self.cache:
            return self.cache[w]
        got = self.classes.get(w)
        if got is None:
            for k in reversed(self.by_first):
                if k <= len(w) and (s := self.stems.get(w[:k])) is not None:
                    got = ("threat" if w[:k] in self.threats else "insult", s)
                    break
        if len(self.cache) < 200_000:
            self.cache[w] = got
        return got

    def clauses(self, text: str) -> list[float]:
        """Weights of the matched clauses of a text, in order."""
        out = []
        lowered = text.lower()
        for sentence in SENTENCE.split(lowered):
            far = REACH + 1
            target = negation = report = far
            pending = None                        # clause that a target behind it may raise
            for w in WORD.findall(sentence):
                kind = self.word_class(w)
                target, negation, report = target + 1, negation + 1, report + 1
                if kind is None:
                    continue
                name, weight = kind
                if name == "target":
                    target = 0
                    if pending is not None and not pending[1]:
                        out[pending[0]] += TARGET_GAIN
                        pending = (pending[0], True)
                elif name == "negation":
                    negation = 0
                elif name == "report":
                    report = 0
                elif name == "threat" and target > REACH:
                    continue                      # a threat needs somebody to do it, or it to
                else:
                    near = target <= REACH
                    out.append(weight + TARGET_GAIN * near + NEGATION_GAIN * (negation <= REACH)
                               + REPORT_GAIN * (report <= REACH))
                    pending = (len(out) - 1, near)
        return out


def features(clauses: list[float], n_words: int) -> tuple[float, float, float]:
    """Best clause, total of all clauses (damped), clauses per 100 words."""
    good = [c for c in clauses if c > 0]
    if not good:
        return 0.0, 0.0, 0.0
    return max(good), math.log1p(sum(good)), 100.0 * len(good) / (n_words + 20)


def _labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Training rows (text, toxic, half), the ``limit`` ids with the smallest
    hash."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int"))
           .filter(is_training(F.col("doc_id")) & F.col("toxic").isin(0, 1))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit))
    # at most ``limit`` ids
    half = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)).alias("half")
    return texts(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic", half)


def _stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, documents with it labelled 1, labelled 0): every beginning of
    ``MIN_STEM`` letters or more of every word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(have), pa.string()), pa.array([v[1] for v in have.values()], pa.int64()),
                 pa.array([v[0] for v in have.values()], pa.int64())], ["stem", "toxic", "clean"])
            have.clear()
            return out

        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                ws = set(WORD.findall(t.lower()))
                for s in {w[:k] for w in ws for k in range(MIN_STEM, min(len(w), 12) + 1)}:
                    have.setdefault(s, [0, 0])[y] += 1
            if len(have) > 500_000:
                yield flush()
        yield flush()

    return (rows.select("text", "toxic").mapInArrow(count, "stem string, toxic long, clean long")
            .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Stems that mark toxic rows, with their smoothed log odds; a longer stem
    stays only if it is clearly stronger than its beginnings."""
    n1, n0 = (x or 0 for x in rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not n1 or not n0:
        return {}
    odds = F.log(((F.col("toxic") + 0.1) / n1) / ((F.col("clean") + 0.5) / n0))
    found = (_stem_counts(rows).withColumn("w", odds)
             .filter((F.col("toxic") >= MIN_DOCS) & (F.col("w") >= MIN_WEIGHT))
             .orderBy(F.desc("toxic"), "stem").limit(FIT_STEMS).collect())
    weight = {r["stem"]: r["w"] for r in found}
    keep = {}
    for s in sorted(weight, key=len):
        best = max((keep[s[:k]] for k in range(MIN_STEM, len(s)) if s[:k] in keep), default=None)
        if best is None or weight[s] > best + 0.5:
            keep[s] = weight[s]
    return keep


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.5] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge,
                               x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap around it."""
    o = np.argsort(-z, kind="stable")
    z, y = z[o], y[o]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[1:] == z[:-1]] = 0                    # never cut between equal scores
    k = int(f1.argmax())
    return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[dict, list[float]]:
    """(stems, weights of the logistic score) from the labelled training rows.

    Stems learned on one half of the rows give the features of the other half;
    on these the weights are fitted, and the intercept is moved so that the
    cut with the best F1 scores ``THRESHOLD``.  The stems returned are learned
    on all rows.  With no labelled row of either kind the fixed grammar is used
    with fixed weights.  At most ``limit`` feature rows come to the driver."""
    small_batches(docs.sparkSession)
    rows = _labelled(docs, labels, limit).cache()
    try:
        half = learn_stems(rows.filter("half = 0"))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = Grammar(half)
            for b in batches:
                f = [features(g.clauses(t), len(t.split())) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in f], pa.float64()) for i in range(3)]
                    + [b.column("toxic")], ["a", "b", "c", "toxic"])

        got = (rows.filter("half = 1").select("text", "toxic")
               .mapInArrow(measure, "a double, b double, c double, toxic int").collect())
        stems = learn_stems(rows)
    finally:
        rows.unpersist()
    y = np.array([r[3] for r in got], float)
    if not len(y) or y.min() == y.max():
        return stems, [-4.0, 1.5, 0.5, 0.1]
    x = np.column_stack([np.ones(len(y)), np.array([r[:3] for r in got], float)])
    w = _logistic(x, y)
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(x @ w, y)
    return stems, w.tolist()


class Scorer:
    """Scores texts with a fitted grammar."""

    def __init__(self, stems: dict, weights: list[float]):
        self.grammar, self.weights = Grammar(stems), weights

    def __call__(self, text: str) -> float:
        f = features(self.grammar.clauses(text), len(text.split()))
        z = self.weights[0] + sum(a * x for a, x in zip(self.weights[1:], f))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and
    ``predicted`` (1 from ``THRESHOLD`` on).

    Null and empty texts get the score of a text without clauses.  Repeated
    rows stay apart; an empty table gives an empty result.  Whole texts are
    read; scoring is narrow.  The model is fitted on a bounded sample of
    ``limit`` labelled rows."""
    stems, w = fit(docs, labels, limit)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems, w)
        for b in batches:
            out = [scorer(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(out, pa.float64()),
                 pa.array([int(p >= THRESHOLD) for p in out], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    return (texts(docs).withColumn("held_out", is_held_out(F.col("doc_id")))
            .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, in their own columns, that are not predicted toxic."""
    stems, w = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems, w)
        for b in batches:
            yield b.filter(pa.array([scorer(t or "") < THRESHOLD
                                     for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
