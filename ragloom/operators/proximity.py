"""Reranking by where a question's words stand in a text, with weights learnt from pairs of texts.

Features of a (question, text), each from 0 to 1: the share of the question's words that the text has; of its pairs of neighbouring
words, the share that are neighbours in the text, and the share that stand in that order within NEAR words; the share of its words
that one stretch of SPAN words has; the similarity of the word sets. A text is a candidate that retrieval has found, so its words are at
hand and no positions are stored. Null texts and texts without words have features 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import files
from .fusion import overlap_score

NEAR, SPAN = 4, 16
NAMES = ("covered", "adjacent", "near", "tight", "overlap")
#: Pull of the weights to those before learning, and steps of Newton's method.
RIDGE, STEPS = 0.1, 8


def _pairs(toks: Column, gap: int) -> Column:
    """Distinct pairs "a b" where b stands 1 to ``gap`` words after a."""
    at = lambda g: F.filter(F.transform(toks, lambda x, i: F.concat(x, F.lit(" "), F.get(toks, i + g))), lambda p: p.isNotNull())
    return F.array_distinct(F.concat(*(at(g) for g in range(1, gap + 1))))


def features(question: str | Column, text: str | Column) -> Column:
    """An array in the order of NAMES, rounded to 6 places."""
    q, t = tokens(question), tokens(text)
    words, pairs = F.array_distinct(q), _pairs(q, 1)
    stretch = F.transform(t, lambda x, i: F.when(F.array_contains(words, x), F.size(F.array_intersect(F.slice(t, i + 1, SPAN), words))).otherwise(0))
    share = lambda n, of: F.when(F.size(of) > 0, F.round(n / F.size(of), 6))
    each = [share(F.size(F.array_intersect(words, t)), words), share(F.size(F.array_intersect(pairs, _pairs(t, 1))), pairs), share(F.size(F.array_intersect(pairs, _pairs(t, NEAR))), pairs), share(F.array_max(stretch), words)]
    return F.array(*(F.coalesce(f, F.lit(0.0)) for f in each), F.coalesce(overlap_score(question, text), F.lit(0.0)))


@dataclass(frozen=True)
class Proximity:
    """A scorer for `fusion.rerank` and ``Engine(scorer=...)``: the weighted sum of the features."""

    weights: tuple[float, ...] = (0.2,) * len(NAMES)

    def score(self, question: str | Column, text: str | Column) -> Column:
        terms = F.zip_with(features(question, text), F.array(*map(F.lit, self.weights)), lambda f, w: f * w)
        return F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 6)


def learn(found: DataFrame, questions: DataFrame, truth: DataFrame, start: Proximity = Proximity()) -> Proximity:
    """Weights by which right texts come before wrong ones: logistic regression on the differences of their features.

    ``found``: candidates (query_id, doc_id, text), a few a question as retrieval leaves them; ``truth``: (query_id, doc_id) that are right.
    Only pairs of one question's right and wrong candidates count. Each step of Newton's method is one aggregation over the
    stored differences, whose sums alone reach the driver. Without any pair the weights stay as they were.
    """
    right = truth.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), F.lit(True).alias("right")).distinct()
    rows = found.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "text").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    rows = rows.join(right, ["query_id", "doc_id"], "left").select("query_id", F.coalesce("right", F.lit(False)).alias("right"), features("question", "text").alias("f"))
    rows = files.index(rows, "rerank-features")
    good, bad = (rows.where(F.col("right") == x).select("query_id", F.col("f").alias(name)) for x, name in ((True, "good"), (False, "bad")))
    diff = good.join(bad, "query_id").select(*((F.col("good")[i] - F.col("bad")[i]).alias(f"d{i}") for i in range(len(NAMES))))
    diff = files.index(diff, "rerank-pairs")
    n, before = len(NAMES), np.array(start.weights)
    w, upper = before.copy(), np.triu_indices(n)
    for _ in range(STEPS):
        z = sum((F.col(f"d{i}") * float(w[i]) for i in range(n)), F.lit(0.0))
        p = 1 / (1 + F.exp(z))  # how wrong the pair is
        sums = [F.sum(p * F.col(f"d{i}")) for i in range(n)] + [F.sum(p * (1 - p) * F.col(f"d{i}") * F.col(f"d{j}")) for i, j in zip(*upper, strict=True)]
        got = np.array([x or 0.0 for x in diff.agg(*sums).first()])
        hessian = np.zeros((n, n))
        hessian[upper] = got[n:]
        hessian = hessian + np.triu(hessian, 1).T + RIDGE * np.eye(n)
        step = np.linalg.solve(hessian, got[:n] - RIDGE * (w - before))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Proximity(tuple(float(x) for x in np.round(w, 6)))
