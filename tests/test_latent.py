"""Learned embeddings against a dense decomposition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.functions.text import bucket, hash_embedding
from ragloom.operators import latent, retrieval

TOPICS = 12


@pytest.fixture(scope="module")
def corpus():
    """Texts on topics; a topic's words come in two sets, of which a text mostly uses one."""
    rng = random.Random(3)
    words = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)] for _ in range(TOPICS)]
    texts = []
    for i in range(600):
        own = words[i % TOPICS]
        half = own[:30] if rng.random() < 0.5 else own[30:]
        texts.append(" ".join(rng.choices(half, k=12) + rng.choices(own, k=8) + rng.choices(rng.choice(words), k=6)))
    return texts


def test_vectors_equal_a_dense_decomposition(spark, corpus):
    df = spark.createDataFrame(list(enumerate(corpus)) + [(900, None), (901, "..."), (902, "")], "id long, text string")
    model = latent.fit(df.repartition(5), 8)
    x = np.zeros((len(corpus), latent.FEATURES))
    for i, t in enumerate(corpus):
        for w in t.split():
            x[i, bucket(w, latent.FEATURES)] += 1
    idf = np.log((1 + len(corpus)) / (1 + (x > 0).sum(0))) + 1
    assert np.allclose(idf, model.idf)
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert (np.linalg.svd(vt[:8] @ model.directions)[1] > 0.99).all()  # nearly the same directions, those of close values mix
    assert ((x @ model.directions) ** 2).sum() > 0.999 * (s[:8] ** 2).sum()
    assert np.allclose(model.directions.T @ model.directions, np.eye(8), atol=1e-6)
    got = {r.id: r.e for r in df.select("id", model.embed("text", 8).alias("e")).collect()}
    assert np.allclose([got[i] for i in range(len(corpus))], x @ model.directions, atol=1e-5)
    assert got[900] is None and got[901] == [0.0] * 8 == got[902]
    again = latent.fit(df.repartition(3), 8)
    assert np.allclose(again.directions, model.directions, atol=1e-6)


def test_vectors_find_texts_of_the_topic(spark, corpus):
    """Of the twenty nearest texts more are of the question's topic than with counts of hashed tokens."""
    df = spark.createDataFrame(list(enumerate(corpus)), "child_id long, text string")
    q = df.where("child_id % 7 = 0").select(F.col("child_id").alias("query_id"), "text")
    model = latent.fit(df, 16)
    share = {}
    for name, embedder in (("hashed", hash_embedding), ("latent", model.embed)):
        e = lambda x: x.withColumn("embedding", embedder("text", 16))  # noqa: B023, E731
        near = retrieval.knn(e(q), e(df), 20, dims=16)
        share[name] = near.select(F.avg((F.col("query_id") % TOPICS == F.col("child_id") % TOPICS).cast("double"))).first()[0]
    assert share["latent"] > 0.9 and share["latent"] > share["hashed"] + 0.1


def test_nothing_to_learn_from(spark):
    model = latent.fit(spark.createDataFrame([(None,), ("",)], "text string"), 4)
    assert spark.createDataFrame([("a b",)], "text string").select(model.embed("text", 4).alias("e")).first().e == [0.0] * 4
    with pytest.raises(ValueError):
        model.embed("text", 5)
