"""Proximity features against plain loops, learned weights against a dense solution."""

import random
import re

import numpy as np

from ragloom.operators import proximity
from ragloom.plans.queries import QUERIES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(question, text):
    q, t = words(question), words(text)
    pairs = {(a, b) for a, b in zip(q, q[1:], strict=False)}
    near = lambda gap: {(t[i], t[j]) for i in range(len(t)) for j in range(i + 1, min(len(t), i + gap + 1))}
    share = lambda found, of: len(found) / len(of) if of else 0.0
    tight = max((len(set(t[i : i + proximity.SPAN]) & set(q)) for i in range(len(t))), default=0)
    both = set(q) & set(t)
    return [share(both, set(q)), share(pairs & near(1), pairs), share(pairs & near(proximity.NEAR), pairs), tight / len(set(q)) if q else 0.0, share(both, set(q) | set(t))]


def test_features_equal_plain_loops(spark):
    rng = random.Random(3)
    some = lambda n, of: " ".join(rng.choice("abcdefghijklmnop"[:of]) for _ in range(n))
    rows = [(some(rng.randint(0, 9), 8), some(rng.randint(0, 80), rng.choice([4, 8, 16]))) for _ in range(150)]
    rows += [("", ""), (None, "a b"), ("a b", None), ("a", "a"), ("a a a", "a"), ("A b!", "b, a; B"), ("x y", "q " * 3000 + "x y")]
    df = spark.createDataFrame(rows, "q string, t string").select("q", "t", proximity.features("q", "t").alias("f"), proximity.Proximity().score("q", "t").alias("s"))
    for r in df.collect():
        want = plain(r.q, r.t) if r.q is not None and r.t is not None else [0.0] * 5
        assert np.allclose(r.f, want, atol=1e-6), (r, want)
        assert abs(r.s - 0.2 * sum(r.f)) < 2e-6


def test_weights_equal_a_dense_solution(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    questions = [(i, some(5)) for i in range(30)]
    found = [(i, f"{i}-{k}", (q if k == 0 and i % 4 else "") + " " + some(20)) for i, q in questions for k in range(4)]
    truth = [(i, f"{i}-0") for i, _ in questions] * 2
    q, c = spark.createDataFrame(questions, "query_id long, text string"), spark.createDataFrame(found, "query_id long, doc_id string, text string")
    got = proximity.learn(c, q, spark.createDataFrame(truth, "query_id long, doc_id string"))
    at = dict(questions)
    f = {(i, d): np.round(plain(at[i], t), 6) for i, d, t in found}
    d = np.array([f[i, f"{i}-0"] - f[i, f"{i}-{k}"] for i, _ in questions for k in (1, 2, 3)])
    w = np.array(got.weights)
    p = 1 / (1 + np.exp(d @ w))
    assert np.abs(p @ d - proximity.RIDGE * (w - 0.2)).max() < 1e-4  # the gradient vanishes
    assert (d @ w > 0).mean() >= (d @ np.full(5, 0.2) > 0).mean()


def test_without_pairs_nothing_is_learnt(spark):
    q, c = spark.createDataFrame([(1, "a b")], "query_id long, text string"), spark.createDataFrame([(1, "x", "a b"), (1, "y", None)], "query_id long, doc_id string, text string")
    none = spark.createDataFrame([], "query_id long, doc_id string")
    assert proximity.learn(c, q, none) == proximity.learn(c.limit(0), q, none) == proximity.Proximity()


def test_recall_is_not_below_token_overlap(spark):
    got = {r.way: r for r in QUERIES["rerank_recall"](spark, "/root/testdata/sf0.001").collect()}
    assert got["proximity"].hits >= got["overlap"].hits > 0 and got["proximity"].questions >= got["overlap"].questions
    assert got["proximity"].reciprocal_ranks >= got["overlap"].reciprocal_ranks
