"""Toxicity: a weighted finite-state grammar over clauses.

Five transducers read the words of a text in one pass and write tags with weights:

- insult: words whose weight is the log-odds that training learned for them or for one of their
  stems (beginnings of 5 to 8 letters, as inflected forms share one), else a seed
- threat: a threat verb after an intent word, aimed at somebody
- target: words for the person spoken to or of
- negation: up to ``NEAR`` words before an insult or threat takes it back
- reported speech: what a clause says that somebody said counts little

Their composition walks the tags of one clause (up to . ! ? ; or a line end); a clause that holds
an insult or threat is a match and scores its weight by what else it holds: in full with a target or
beside a second insult, by ``LONE`` if an insult stands alone. A text's score is a logistic curve, fitted on training rows, of its summed and of its
strongest clause and of how often it matches. What decides is clauses, not words; but a lone insult that training
learned strongly is a clause that can decide, as such texts are labelled toxic. Whole texts are read.

Training takes at most ``sample_rows`` labelled rows (a hash of doc_id chooses them, evenly). Labels
of held-out rows (crc32 of the doc_id as text, modulo 4, is 2) are never read. One pass over the
documents; the model that is sent out is bounded by the sample. No shuffle in scoring.

Defined results: null and empty texts have no clause and get the curve's lowest score; rows with an
equal doc_id are scored row by row; labels other than 0 and 1 are skipped, of several of a document 1 counts; without toxic training rows the
seeds alone count; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import read, utf8

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
STEMS = range(5, 9)
MEMO = 200_000  # words that a worker remembers
#: Words of the fixed grammar; weights of insults are learned where training has them.
SEED_INSULTS = {"idiot": 3.0, "moron": 3.0, "stupid": 2.5, "scum": 3.0, "loser": 2.5, "pathetic": 2.5, "worthless": 2.5, "disgusting": 2.0, "trash": 1.5, "clown": 1.5, "fool": 2.0, "coward": 2.0, "liar": 2.0, "filth": 2.5}
TARGETS = {"you", "your", "you're", "youre", "u", "he", "she", "they", "them", "him", "her", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "usted", "ustedes", "vosotros"}
NEGATIONS = {"not", "never", "no", "isn't", "aren't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca"}
REPORTS = {"said", "says", "called", "wrote", "quoted", "claimed", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"}
INTENTS = {"will", "gonna", "shall", "i'll", "we'll", "werde", "wird", "vais", "voy"}
THREATS = {"kill", "hurt", "destroy", "murder", "beat", "attack", "stab", "shoot", "töten", "tuer", "matar"}
EDGES = "\"'`“”«»()[]{}<>*_~#%&$|,:-!.?;"
ENDS = (".", "!", "?", ";")
#: What a clause's other tags do to its insults, and what a threat weighs.
TARGETED, LONE, NEGATED, REPORTED, THREAT, NEAR = 1.25, 0.6, 0.0, 0.1, 3.0, 3


def features_of(word: str) -> list[str]:
    """The word, and its stems."""
    return ["=" + word, *("^" + word[:k] for k in STEMS if k < len(word))]


class Clause:
    """What the transducers have written of a clause so far."""

    __slots__ = ("insults", "matched", "targeted", "reported", "intent", "threat")

    def __init__(self):
        self.insults, self.matched, self.threat = 0.0, 0, 0.0
        self.targeted = self.reported = self.intent = False

    def insult(self, weight: float) -> None:
        self.insults += weight
        self.matched += weight > 0

    def score(self) -> float:
        how = TARGETED if self.targeted else 1.0 if self.matched > 1 else LONE
        return (self.insults * how + self.threat * self.targeted) * (REPORTED if self.reported else 1.0)


class Grammar:
    """Transducers with given insult weights. Tags by word are remembered per process."""

    def __init__(self, weights: dict[str, float], curve: list[float]):
        self.weights, self.curve = weights, curve

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve}

    def tag(self, chunk: bytes) -> tuple | int:
        """0, or (tag, weight, whether a clause ends after it)."""
        text = chunk.decode("utf-8", "replace").lower()
        ends = text.rstrip("\"'”»)*_~#%&$|").endswith(ENDS)
        word = text.strip(EDGES)
        weight = max((self.weights.get(f, 0.0) for f in features_of(word)), default=0.0) if word else 0.0
        weight = weight or SEED_INSULTS.get(word, 0.0)
        kind = "I" if weight else next((k for k, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("W", INTENTS), ("V", THREATS)) if word in words), "")
        return (kind, weight, ends) if kind or ends else 0

    def clauses(self, text: str | None) -> list[float]:
        """Scores of matched clauses."""
        memo = self.__dict__.setdefault("memo", {})
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for line in utf8(text).split(b"\n"):
            words = line.split()
            for w in words:
                if w not in memo:
                    memo[w] = self.tag(w)
            tags = [(i, t) for i, w in enumerate(words) if (t := memo[w])]
            if any(t[0] in ("I", "V") for _, t in tags):
                out += self.walk(tags)
        return out

    @staticmethod
    def walk(tags: list[tuple]) -> list[float]:
        """The composed transducer on the tags of one line: a score for each clause that matches."""
        out, clause, negated_at = [], Clause(), -99
        for i, (kind, weight, ends) in tags:
            near = i - negated_at <= NEAR
            if kind == "T":
                clause.targeted = True
            elif kind == "N":
                negated_at = i
            elif kind == "R":
                clause.reported = True
            elif kind == "W":
                clause.intent = True
            elif kind == "V":
                clause.threat += THREAT * (clause.intent and not near)
            elif kind == "I":
                clause.insult(weight * (NEGATED if near else 1.0))
            if ends:
                out.append(clause.score())
                clause, negated_at = Clause(), -99
        out.append(clause.score())
        return [x for x in out if x > 0]

    def evidence(self, text: str | None) -> list[float]:
        """1, log of the summed clauses, the strongest clause, matches per word's root."""
        found = self.clauses(text)
        words = 1 + (utf8(text).count(b" ") if found else 0)
        return [1.0, math.log1p(sum(found)), min(max(found, default=0.0), 10.0), sum(found) / math.sqrt(words)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.curve, self.evidence(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _words(text: str | None) -> set[str]:
    return {w for c in set(utf8(text).split()) if (w := c.decode("utf-8", "replace").lower().strip(EDGES))}


def _counted(only: dict | None):
    """(feature, documents) of a partition's texts; only: features that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, keep = Counter(), only.value if only else None
        for b in batches:
            for text in b.column(0).to_pylist():
                found = {f for w in _words(text) for f in features_of(w)}
                n.update(found if keep is None else found & keep)
                n[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["feature", "n"])

    return run


def held_out(doc_id, folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def chosen(share: float, *columns):
    """A condition that this share of the rows meets, by a 64-bit hash of the columns."""
    bound = round(min(1.0, share) * (1 << 64)) - (1 << 63) - 1
    return F.xxhash64(*columns) <= F.lit(max(bound, -(1 << 63)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of training rows with a label: about ``bound`` of them, chosen by a hash of doc_id."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out("doc_id"))
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, bound / max(1, y.count()))
    y = y.where(chosen(share, "doc_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(y, "doc_id").select("text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the constant."""
    w, s = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    pull = np.r_[1e-4, np.full(x.shape[1] - 1, ridge)] * max(1, len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (s * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (s * (p - y)) + pull * w)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, least: int = 6, least_z: float = 6.0, least_odds: float = 1.5) -> Grammar:
    """Weights of words and beginnings, then the curve, from the bounded sample."""
    from brookwave.llm.shared import dropped, stored

    sc = docs.sparkSession.sparkContext
    rows = stored(labelled_sample(docs, labels, label, sample_rows), "toxicity-sample")
    toxic, clean = rows.where("y = 1").select("text"), rows.where("y = 0").select("text")
    counts = "feature string, n long"
    # bounded: features that at least ``least`` of the sampled toxic documents hold
    t = {f: n for f, n in toxic.mapInArrow(_counted(None), counts).groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    kept = sc.broadcast(set(t) | {""})
    c = {f: n for f, n in clean.mapInArrow(_counted(kept), counts).groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    nt, nc = t.pop("", 0), c.pop("", 0)
    weights = {}
    for f, a in t.items():
        b = c.get(f, 0)
        expected = (a + b) * nt / (nt + nc) if nc else a
        odds = math.log((a + 0.5) / (nt + 1)) - math.log((b + 0.5) / (nc + 1))
        if odds >= least_odds and (a - expected) / math.sqrt(max(expected, 1e-9)) >= least_z:
            weights[f] = min(odds, 6.0)
    grammar = sc.broadcast(Grammar(weights, [0.0] * 4))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = [grammar.value.evidence(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.list_(pa.float64())), b.column(1)], names=["e", "y"])

    found = rows.mapInArrow(evidence, "e array<double>, y int").collect()
    curve = [-4.0, 1.5, 0.3, 0.0]
    if len({r.y for r in found}) == 2:
        x, y = np.array([r.e for r in found]), np.array([r.y for r in found], float)
        curve = logistic(x, y, ridge=1e-4).tolist()
    dropped(rows)
    return Grammar(weights, curve)


def scorer(grammar: Grammar, spark: SparkSession):
    """A column function of the text: its score."""
    sent = spark.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(None if x is None else x) for x in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    score = scorer(learn(docs, labels, sample_rows=sample_rows), docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def nontoxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    score = scorer(learn(docs, labels, sample_rows=sample_rows), docs.sparkSession)
    return docs.where(score(F.col("text").cast("string")) < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
