"""Toxicity by multiple-instance learning.

Only documents carry labels, but it is sentences that offend. A sentence's probability is the logistic of a bias and the
weights of its distinct words; a word's weight is the sum of those of its beginnings and of the whole word. A document's
probability is the noisy-or of its sentences: one minus the chance that none offends. Bias and weights are fitted to
document labels by gradients of that noisy-or, with weights held at zero or above and pulled to zero, so that what
remains is the evidence that locates the offending sentences. A document that is missed weighs more than a false alarm:
scores are these probabilities with their odds multiplied by ``ODDS``.

The model is fitted on a bounded sample of the labelled rows (``max_train``, those with the smallest hashes of their
ids); scoring is one narrow pass over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 8_000
#: A feature must occur in so many documents of label 1 in the sample.
LEAST_DOCS = 5
#: Weights are not negative, so a feature is of use only where label 1 is this much more frequent than overall.
LEAST_LIFT = 1.5
PREFIXES = (4, 5, 6, 7, 8)
STEPS = 300
RATE = 0.3
PULL = 0.4
THRESHOLD = 0.7
#: A probability of 0.3 scores 0.7: a document that is missed weighs as much as 7 / 3 false alarms.
ODDS = (0.7 / 0.3) ** 2
#: Words beyond this many are forgotten and looked up anew.
CACHE = 500_000

SENTENCE_END = re.compile(r"[.!?\n]+")
EDGES = re.compile(r"^\W+|\W+$")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each stretch between ends of sentences that has more than blanks."""
    out, start = [], 0
    text = text or ""
    for m in SENTENCE_END.finditer(text):
        if text[start : m.start()].strip():
            out.append((start, m.start()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def words(sentence: str) -> set[str]:
    return {EDGES.sub("", w) for w in sentence.lower().split()} - {""}


def features(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if n < len(word)] + [f"{word}$"]


class Weights(dict):
    """Weight of each blank-separated, lower-cased token, found once and kept."""

    def __init__(self, by_feature: dict[str, float]):
        super().__init__()
        self.by_feature = by_feature

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        bare = EDGES.sub("", token)
        got = self[token] = sum(self.by_feature.get(f, 0.0) for f in features(bare)) if bare else 0.0
        return got


class Model:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.tokens = bias, weights, Weights(weights)
        self.blank = self.probability(0.0)

    @staticmethod
    def score(clean: float) -> float:
        """The score of a text with the log ``clean`` of the chance that nothing in it offends."""
        p = -expm1(clean)
        return ODDS * p / (1 + (ODDS - 1) * p)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + exp(-(self.bias + evidence)))

    def sentence(self, text: str) -> float:
        """Probability that a sentence offends; each word counts once."""
        tokens = text.lower().split()
        return self.probability(sum({EDGES.sub("", w): x for w, x in zip(tokens, map(self.tokens.__getitem__, tokens), strict=True) if x}.values()))

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of the noisy-or over the sentences, and (start, end, probability) of those whose own score is the
        threshold or more."""
        text = text or ""
        spans = sentences(text)
        if not any(map(self.tokens.__getitem__, text.lower().split())):  # most texts hold no evidence at all
            return self.score(len(spans) * log1p(-self.blank)), []
        clean, found = 0.0, []
        for start, end in spans:
            p = self.sentence(text[start:end])
            one = log1p(-min(p, 1 - 1e-12))
            clean += one
            if self.score(one) >= THRESHOLD:
                found.append((start, end, p))
        return self.score(clean), found


def evidence(text: str | None, kept: frozenset[str]) -> tuple[list[list[str]], int]:
    """The distinct words of each sentence that have a kept feature, and the number of sentences without any."""
    found, plain = [], 0
    for start, end in sentences(text):
        some = sorted(w for w in words((text or "")[start:end]) if not kept.isdisjoint(features(w)))
        if some:
            found.append(some)
        else:
            plain += 1
    return found, plain


def fit(documents: list[tuple[list[list[str]], int]], labels: np.ndarray, kept: list[str], steps: int = STEPS) -> Model:
    """Fit bias and weights of the ``kept`` features to the evidence and label of each document.

    Both labels must occur, else there are no weights and each sentence has the share of label 1."""
    share = float(np.mean(labels)) if len(labels) else 0.0
    seen = sum(len(x) for x, _ in documents)
    if not 0 < share < 1 or not seen:
        share = min(max(share, 1e-4), 1 - 1e-4)
        return Model(float(np.log(share / (1 - share))), {})
    place = {f: i for i, f in enumerate(kept)}
    vocabulary: dict[str, int] = {}
    tw, ts, sd = [], [], []
    for d, (found, _) in enumerate(documents):
        for sentence in found:
            tw += [vocabulary.setdefault(w, len(vocabulary)) for w in sentence]
            ts += [len(sd)] * len(sentence)
            sd.append(d)
    tw, ts, sd = (np.array(x, np.int64) for x in (tw, ts, sd))
    pw, pf = np.array([(i, place[f]) for w, i in vocabulary.items() for f in features(w) if f in place], np.int64).T
    plain = np.array([n for _, n in documents], float)
    n, m, docs = len(kept), len(vocabulary), len(documents)
    theta, bias, g_theta, g_bias = np.zeros(n), -6.0, np.full(n, 1e-6), 1e-6
    y = labels.astype(float)
    for _ in range(steps):
        z = bias + np.bincount(ts, np.bincount(pw, theta[pf], minlength=m)[tw], minlength=seen)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        clean = np.bincount(sd, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=docs) + plain * np.log1p(-p0)
        whole = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-12)
        by_doc = np.where(y == 1, -(1 - whole) / whole, 1.0)  # slope of the loss by each log of one minus p
        pull = by_doc[sd] * p
        step = np.bincount(pf, np.bincount(tw, pull[ts], minlength=m)[pw], minlength=n)
        g_theta += step**2
        theta = np.maximum(0, theta - RATE * (step + PULL) / np.sqrt(g_theta))
        down = pull.sum() + (by_doc * plain).sum() * p0
        g_bias += down**2
        bias -= RATE * down / np.sqrt(g_bias)
    return Model(float(bias), {kept[i]: float(theta[i]) for i in np.flatnonzero(theta > 1e-3)})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted({f for w in words(t.as_py() or "") for f in features(w)}) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "features"])


def _evidence(kept: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [evidence(t.as_py(), kept) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.list_(pa.list_(pa.string()))), pa.array([n for _, n in found], pa.int32())], ["toxic", "found", "plain"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, least_docs: int = LEAST_DOCS) -> Model:
    """Fit on at most ``max_train`` labelled documents outside the held-out third.

    Of rows that repeat an id one counts. Spark counts in how many documents of the sample each feature stands and reduces every document to the words that
    have a useful one; only that reaches the driver, and its size is bounded by the sample's."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    sample = common.stored(sample.select("toxic", "text", F.xxhash64("doc_id").alias("at")), "toxicity-sample")
    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    least = LEAST_LIFT * size["toxic"] / max(1, size["n"])
    counts = sample.select("toxic", "text").mapInArrow(_features, "toxic int, features array<string>").select("toxic", F.explode("features").alias("feature"))
    counts = counts.groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).where((F.col("toxic") >= least_docs) & (F.col("toxic") >= least * F.col("n")))
    kept = sorted(r["feature"] for r in counts.select("feature").toLocalIterator())
    rows = sample.orderBy("at").select("toxic", "text").mapInArrow(_evidence(frozenset(kept)), "toxic int, found array<array<string>>, plain int").collect()
    return fit([(r["found"], r["plain"]) for r in rows], np.array([r["toxic"] for r in rows], float), kept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending) of every row; offending lists start, end and probability of sentences, in characters.

    Null and empty texts have no sentences and the score 0. Rows that repeat an id are scored each by its own text."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for b in batches:
            found = [own.document(t.as_py()) for t in b.column(1)]
            where = [[{"start": s, "end": e, "probability": p} for s, e, p in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array(where, places)], ["id", "score", "offending"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, score double, offending array<struct<start:int,end:int,probability:double>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: score of every document, and where it offends."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), "offending"
    )
