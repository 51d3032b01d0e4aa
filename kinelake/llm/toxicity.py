"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts are learned from. With the share p of toxic texts among all (the class
prior), the risk of a classifier g is p R_P(+) + max(0, R_U(-) - p R_P(-)): the unlabelled texts' risk as negatives is
corrected by the part that their hidden positives cause, and is not let below zero. Where it falls below, the step
goes the other way, which keeps the classifier from fitting single texts.

The classifier is linear over the words of a text and their beginnings. Which of these count is a statistic of the
positive against the unlabelled sample, summed by Spark; weights are fitted in numpy on the driver. Both samples are
bounded (``POSITIVE``, ``UNLABELLED`` texts, those with the smallest id hashes). Every whole text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import held_out, query, table, texts_of, whole_text

POSITIVE, UNLABELLED = 4000, 8000
FEATURES = 4096
LEAST_SCORE, LEAST_TEXTS = 4.0, 4
STEPS, RATE, DECAY = 400, 0.1, 1e-4
REMEMBERED = 300_000
WORD = re.compile(r"\w+")
BEGINNINGS = range(4, 9)


def parts_of(word: str) -> list[str]:
    """A word's features: itself and its beginnings (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if n < len(word))]


def features(text: str) -> set[str]:
    return {p for w in set(WORD.findall(text.lower())) for p in parts_of(w)}


def samples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, positive, text) of both samples, outside the held-out fold, and the class prior: the share of toxic
    among labelled rows outside that fold. A text drawn for both is in both, as an unlabelled sample holds positives."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    positive = known.filter("y = 1").select("doc_id").orderBy(*order).limit(POSITIVE).withColumn("positive", F.lit(True))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(~held_out())
    unlabelled = ids.orderBy(*order).limit(UNLABELLED).distinct().withColumn("positive", F.lit(False))
    # Both are bounded lists of ids: a bounded broadcast.
    return whole_text(docs).join(F.broadcast(positive.union(unlabelled)), "doc_id").select("doc_id", "positive", "text"), float(prior)


def choose(sample: DataFrame) -> tuple[list[str], int, int]:
    """The features more frequent among positives than their chance of it allows, at most FEATURES; sample sizes."""

    def count(batches):
        pos, neg, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for p, t in zip(b.column(1).to_pylist(), texts_of(b)):
                (pos if p else neg).update(features(t))
                n[not p] += 1
        # A feature of no positive text here still counts where another task has one.
        names = [*pos.keys(), *(k for k, v in neg.items() if k not in pos)]
        yield pa.RecordBatch.from_arrays([pa.array([None, *names], pa.string()), pa.array([n[0], *(pos[k] for k in names)], pa.int64()), pa.array([n[1], *(neg[k] for k in names)], pa.int64())], ["f", "p", "u"])

    counted = sample.mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # A word is never null: the null row holds the sizes of the samples.
    sized = counted.filter("f IS NULL").select("p", "u").first() or (0, 0)
    n_p, n_u = int(sized[0]), int(sized[1])
    if not n_p or not n_u:
        return [], n_p, n_u
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = counted.filter(F.col("f").isNotNull() & (F.col("p") >= min(LEAST_TEXTS, max(2, n_p // 20)))).withColumn("z", z).filter(F.col("z") > LEAST_SCORE)
    return [r["f"] for r in best.orderBy(F.desc("z"), "f").limit(FEATURES).select("f").collect()], n_p, n_u


class Scorer:
    """Weights of the chosen features; a text's score is the logistic of their sum over the features it holds."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = {f: k for k, f in enumerate(names)}, weights.tolist(), bias
        self.known: dict[str, tuple[int, ...]] = {}

    def held(self, text: str) -> set[int]:
        known, names, out = self.known, self.names, set()
        if len(known) > REMEMBERED:
            self.known = known = {}
        for w in set(WORD.findall(text.lower())):
            found = known.get(w)
            if found is None:
                known[w] = found = tuple(names[p] for p in parts_of(w) if p in names)
            if found:
                out.update(found)
        return out

    def probability(self, text: str) -> float:
        z = self.bias + sum(self.weights[k] for k in sorted(self.held(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(rows: list[list[int]], positive: np.ndarray, n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic losses, by Adam over the whole sample."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([k for r in rows for k in r], np.int64)
    pos, neg = positive, ~positive
    w, bias = np.zeros(n + 1), math.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))
    w[n] = bias
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = w[n] + np.bincount(of, w[at], len(rows))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        unlabelled, inner = np.logaddexp(0, z[neg]).mean(), np.logaddexp(0, z[pos]).mean()
        # Gradients of the losses by z: s - 1 as a positive, s as a negative.
        as_negative = np.where(neg, s / neg.sum(), -prior * s / pos.sum())
        if unlabelled - prior * inner >= 0:
            d = as_negative + np.where(pos, prior * (s - 1) / pos.sum(), 0)
        else:
            d = -as_negative
        g = np.append(np.bincount(at, d[of], n), d.sum()) + DECAY * np.append(w[:n], 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Scorer:
    """The classifier. ``prior`` overrides the share of toxic among the labelled. Without positives all texts score low."""
    sample, share = samples(docs, labels)
    names, n_p, n_u = choose(sample)
    prior = share if prior is None else prior
    if not names:
        return Scorer([], np.zeros(0), -4.0)
    blank = Scorer(names, np.zeros(len(names)), 0.0)

    def read(batches):
        for b in batches:
            made = [sorted(blank.held(t)) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], ["doc_id", "positive", "held"])

    # At most POSITIVE + UNLABELLED rows of a few numbers.
    rows = sample.mapInArrow(read, "doc_id long, positive boolean, held array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["positive"], r["held"]))
    weights, bias = learn([r["held"] for r in rows], np.array([r["positive"] for r in rows]), len(names), prior)
    return Scorer(names, weights, bias)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts are empty and score as a text without any sign, repeated rows give equal rows, null or other labels are
    left out, a label given twice counts as its larger value; an empty table gives none.
    """
    scorer = fit(docs, labels, prior)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.probability(t) for t in texts_of(b)], pa.float64())], ["doc_id", "score"])

    found = whole_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
