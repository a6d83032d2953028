"""Toxicity by a weighted finite-state pattern grammar over clauses.

Every word of a clause has a class: insult, threat, target, negation, report or other. Insults
and threats carry weights; besides seed words they are learned, as words and as word beginnings,
from the log-odds of labelled documents. Five weighted transducers read the classes: insult and
threat each look for a target before or after their match (what comes after is guessed by a
branch that must be kept within REACH words), negation damps matches that follow it shortly, and
after a reporting verb the rest of the clause counts less. They are composed into one machine, whose
factor of a word is the product of theirs; a path's score is the sum of the words' weights times
factors, and a clause's score that of its best accepted path. A document's matched
clauses (their sum, largest and number) go through a logistic curve fitted to the labelled ones.

Labels, lang, source and doc_id are no inputs of a score. The lexicon and curve are fitted on a
bounded sample: SAMPLE labelled rows with the smallest hash. Null and empty texts have no clause
and get the score of such; without any labelled row the seeds alone decide. Repeated doc_ids are
scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that lexicon and curve are fitted on, at most.
SAMPLE = 20_000
#: Learned words and beginnings that are kept, at most; least log-odds, and least toxic documents, as a number and as a share.
LEXICON, LEAST_ODDS, LEAST_DOCS, LEAST_SHARE = 5_000, 2.5, 3, 0.01
#: Lengths of the word beginnings that are learned.
STEMS = (4, 5, 6)
THRESHOLD = 0.7

INSULT = {"idiot", "idiots", "moron", "loser", "scum", "stupid", "imbecile", "filth", "vermin", "bastard"}
THREAT = {"kill", "hurt", "destroy", "strangle", "stab", "shoot"}
TARGET = {"you", "your", "he", "she", "they", "them", "him", "du", "ihr", "sie", "tu", "vous", "ils", "usted", "ellos"}
NEGATION = {"not", "never", "isn", "aren", "kein", "keine", "nicht", "jamais", "nunca", "jamás"}
REPORT = {"said", "says", "called", "claimed", "quoted", "wrote", "sagte", "behauptete", "disait", "écrit", "dijo", "escribió"}
SEED_WEIGHT = 2.0
#: Factors of a match: insults and threats with a target near, threats without one, after a negation, after a report; and for how many words a target and a negation hold.
NEAR_TARGET, AIMED, UNAIMED, NEGATED, REPORTED, REACH = 1.2, 1.3, 0.9, 0.4, 0.6, 3

CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"\w+")


@dataclass
class Model:
    """lexicon: weights of words, and of beginnings, which end in *. curve: intercept, and factors of sum, largest and number."""

    lexicon: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float, float] = (-4.0, 1.0, 1.0, 0.5)

    def weight(self, word: str) -> float:
        seed = SEED_WEIGHT if word in INSULT or word in THREAT else 0.0
        return max(seed, self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS))


#: Classes of words.
OTHER, IS_INSULT, IS_THREAT, IS_TARGET, IS_NEGATION, IS_REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """arcs: what (state, class) leads to, as (state, factor of the word's weight); no arc, no path. A path begins in start and ends in one of accepting."""

    start: object
    arcs: dict[tuple, list[tuple]]
    accepting: frozenset


CLASSES = (OTHER, IS_INSULT, IS_THREAT, IS_TARGET, IS_NEGATION, IS_REPORT)


def aimed(match: int, near: float, far: float, reach: int = REACH) -> Transducer:
    """The factor near for matches with a target among the reach words before or after, far for others. States: words that a target still holds; or, negative, in which one must come."""
    arcs: dict[tuple, list[tuple]] = {}
    for state in range(-reach, reach + 1):
        for c in CLASSES:
            if c == IS_TARGET:
                arcs[state, c] = [(reach, 1.0)]
            elif state < 0:  # a target is owed, and this word is none
                arcs[state, c] = [(state + 1, near if c == match else 1.0)] if state < -1 else []
            elif c == match:
                after = max(0, state - 1)
                arcs[state, c] = [(after, near)] if state else [(0, far), (-reach, near)]
            else:
                arcs[state, c] = [(max(0, state - 1), 1.0)]
    return Transducer(0, arcs, frozenset(range(reach + 1)))


def damped(cue: int, factor: float, reach: int | None) -> Transducer:
    """The factor for matches within reach words after a cue; up to the clause's end without a reach. States: words that the cue still holds."""
    most = 1 if reach is None else reach
    arcs = {}
    for state in range(most + 1):
        for c in CLASSES:
            left = state if reach is None else max(0, state - 1)
            arcs[state, c] = [(most, 1.0) if c == cue else (left, factor if state and c in (IS_INSULT, IS_THREAT) else 1.0)]
    return Transducer(0, arcs, frozenset(range(most + 1)))


def composed(machines: list[Transducer]) -> Transducer:
    """One transducer whose states are those of all, with the product of their factors; only states that a path reaches."""
    start = tuple(m.start for m in machines)
    arcs: dict[tuple, list[tuple]] = {}
    todo = [start]
    while todo:
        state = todo.pop()
        if (state, OTHER) in arcs:
            continue
        for c in CLASSES:
            each = [m.arcs[s, c] for m, s in zip(machines, state, strict=True)]
            arcs[state, c] = [(tuple(s for s, _ in way), float(np.prod([x for _, x in way]))) for way in product(*each)]
            todo += [s for s, _ in arcs[state, c]]
    accepting = frozenset(s for s, _ in arcs if all(x in m.accepting for x, m in zip(s, machines, strict=True)))
    return Transducer(start, arcs, accepting)


PARTS = [aimed(IS_INSULT, NEAR_TARGET, 1.0), aimed(IS_THREAT, AIMED, UNAIMED), damped(IS_NEGATION, NEGATED, REACH), damped(IS_REPORT, REPORTED, None)]
GRAMMAR = composed(PARTS)


def word_class(word: str, weight: float) -> int:
    if word in NEGATION:
        return IS_NEGATION
    if word in REPORT:
        return IS_REPORT
    if word in TARGET:
        return IS_TARGET
    if weight:
        return IS_THREAT if word in THREAT else IS_INSULT
    return OTHER


def best_path(classes: list[int], weights: list[float], machine: Transducer = GRAMMAR) -> float:
    """The largest score of an accepted path."""
    now = {machine.start: 0.0}
    for c, w in zip(classes, weights, strict=True):
        new: dict[object, float] = {}
        for state, score in now.items():
            for to, factor in machine.arcs[state, c]:
                if (x := score + w * factor) > new.get(to, -1.0):
                    new[to] = x
        now = new
    return max(score for state, score in now.items() if state in machine.accepting)


def clause_score(words: list[str], weights: dict[str, float]) -> float:
    """The score of a clause; of words of no class in a row, those that no state counts are left out."""
    classes, own, idle = [], [], 0
    for word in words:
        w = weights.get(word, 0.0)
        c = word_class(word, w)
        idle = idle + 1 if c == OTHER else 0
        if idle <= REACH + 1:
            classes.append(c)
            own.append(w if c in (IS_INSULT, IS_THREAT) else 0.0)
    return best_path(classes, own)


def features(text: str, model: Model, known: dict[str, float]) -> tuple[float, float, int]:
    """Sum, largest and number of the scores of matched clauses. known: weights of words met before, for speed."""
    text = text.lower()
    hits = {}
    for w in set(WORD.findall(text)):
        x = known.get(w)
        if x is None:
            x = model.weight(w)
            if len(known) < 1_000_000:
                known[w] = x
        if x:
            hits[w] = x
    if not hits:
        return 0.0, 0.0, 0
    scores = [s for clause in CLAUSE.split(text) if not hits.keys().isdisjoint(words := WORD.findall(clause)) and (s := clause_score(words, hits))]
    return sum(scores), max(scores, default=0.0), len(scores)


def curve(x: np.ndarray, model: Model) -> np.ndarray:
    """Scores for rows of features, which are damped by log1p."""
    z = model.curve[0] + np.log1p(x) @ np.array(model.curve[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Intercept and factors by Newton's steps."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def learned(sample: DataFrame) -> dict[str, float]:
    """Words and beginnings of toxic documents by smoothed log-odds; sample: text, toxic."""

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counts: Counter = Counter()
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                words = set(WORD.findall(text.lower()))
                counts.update((t, int(toxic)) for t in words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
            if counts:
                yield pd.DataFrame([(t, n * y, n * (1 - y)) for (t, y), n in counts.items()], columns=["term", "bad", "good"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return {}
    odds = F.log((F.col("bad") + 0.1) / (n_bad + 1)) - F.log((F.col("good") + 0.1) / (n_good + 1))
    counted = sample.mapInPandas(terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = counted.filter(F.col("bad") >= max(LEAST_DOCS, LEAST_SHARE * n_bad)).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    return {r["term"]: r["odds"] for r in found.orderBy(F.desc(F.col("odds") * F.col("bad")), "term").limit(LEXICON).collect()}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> Model:
    """labels: doc_id, toxic (0 or 1; others are left out). Only sample_rows of them, by hash, are used."""
    spark = docs.sparkSession
    common.small_batches(spark)
    before = set(common.written())
    rows = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    sample = common.stored(common.texts(docs).join(F.broadcast(rows), "doc_id").select("text", "toxic"))  # at most sample_rows ids
    model = Model(learned(sample))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for f in frames:
            x = pd.DataFrame([features(t, model, known) for t in f["text"]], columns=["a", "b", "c"])
            yield x.assign(y=f["toxic"].to_numpy()).groupby(["a", "b", "c", "y"], as_index=False).size().rename(columns={"size": "n"})

    got = sample.mapInPandas(run, "a double, b double, c double, y int, n long").collect()
    x = np.array([(r["a"], r["b"], r["c"]) for r in got for _ in range(r["n"])])
    y = np.array([r["y"] for r in got for _ in range(r["n"])])
    if len(y) and 0 < y.sum() < len(y):
        model.curve = tuple(logistic(np.log1p(x), y))
    common.drop_stored(spark, [p for p in common.written() if p not in before])
    return model


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, further columns of docs by name (none may be named score), score."""
    common.small_batches(docs.sparkSession)
    known: dict[str, float] = {}

    def run(texts: list) -> tuple[None, list]:
        x = np.array([features(t if t is not None else "", model, known) for t in texts], float).reshape(-1, 3)
        return None, [(s,) for s in curve(x, model).tolist()]

    columns = ("doc_id", *[c for c in keep if c != "doc_id"])
    return common.mapped(docs, run, ("text",), "score double", columns).select(*columns, "score")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: scores of all documents; labels of the third with remainder 1 are held out."""
    docs, labels = (common.table(spark, sf_dir, x) for x in ("documents", "labels"))
    held = common.crc32_mod("doc_id", 3) == 1
    out = scored(docs, fit(docs, labels.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
