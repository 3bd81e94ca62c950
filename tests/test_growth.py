"""What grows with the documents is done once: words hashed, texts cut, questions searched; blocks aren't shuffled or copied by tasks."""

from collections import Counter

import numpy as np
import pytest

from ragloom.functions import text
from ragloom.operators import latent, lexical, retrieval, segments
from ragloom.plans import queries


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, None if i == 5 else "" if i == 6 else f"alpha beta w{i}. gamma w{i % 3} delta beta") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_word_is_hashed_once(monkeypatch):
    import pyarrow as pa

    seen = Counter()
    real = text.bucket
    monkeypatch.setattr(text, "_hashes", {})
    monkeypatch.setattr(text, "bucket", lambda t, dims: seen.update([t]) or real(t, dims))
    for dims in (64, 8192, 7):
        words = ["one", "two", "three", "é"]
        assert text.buckets(pa.array(words), dims).tolist() == [real(w, dims) for w in words]
    assert set(seen.values()) == {1}
    monkeypatch.setattr(text, "REMEMBERED", 2)
    assert text.buckets(pa.array(["four"]), 64).tolist() == [real("four", 64)] and len(text._hashes) == 1


def test_features_are_counted_once_and_stored(docs):
    rows = latent.counted(docs.repartition(3)).collect()
    assert len(rows) == 38
    words = next(r.text for r in docs.collect() if r.doc_id == 9).replace(".", "").split()
    want = Counter(text.bucket(w, latent.FEATURES) for w in words)
    assert dict(want) in [dict(zip(r.features, r.counts, strict=True)) for r in rows]


def test_a_question_is_searched_once_for_each_wording(spark, monkeypatch):
    calls, real = [], lexical.weighted
    monkeypatch.setattr(lexical, "weighted", lambda *a, **b: calls.append(1) or real(*a, **b))
    queries.feedback_recall(spark, "/root/testdata/sf0.001")
    assert len(calls) == 2  # as asked, and with feedback


@pytest.mark.parametrize("min_score", [0.0, 0.8])
def test_nearest_over_many_batches(spark, min_score):
    """Batches of some rows after one another, copies, null vectors and those of zeros; ties by key."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (300, 8)).astype(float)
    x[50:200:3], x[7] = x[50], 0
    rows = [(i, None if i == 9 else v.tolist()) for i, v in enumerate(x)]
    asked = x[[1, 20, 50]]
    items = spark.createDataFrame(rows, "child_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    want = []
    for i, a in enumerate(asked):
        norm = np.sqrt((x * x).sum(1))
        s = {j: np.floor((1 + a @ x[j] / (np.sqrt(a @ a) * norm[j])) / 2 * 1e6 + 0.5) / 1e6 for j in range(300) if norm[j] and j != 9}
        want += [(i, n + 1, j) for n, j in enumerate(sorted((j for j in s if s[j] >= min_score), key=lambda j: (-s[j], j))[:20])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = retrieval.knn(q, items, 20, min_score, dims=8).select("query_id", "rank", "child_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == want


def test_deletions_do_not_shuffle_blocks(spark, docs):
    index = lexical.build(docs, "doc_id")
    assert "MapInArrow" not in _plan(segments.purged(index))
    less = lexical.without(index, docs.where("doc_id % 4 = 1").select("doc_id"), "doc_id", 10)
    want = lexical.build(docs.where("doc_id % 4 <> 1"), "doc_id")
    assert (less.docs, less.tokens) == (want.docs, want.tokens) and sorted(less.terms.collect()) == sorted(want.terms.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange hashpartitioning" not in _plan(lexical._blocks(less))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_feedback_cuts_only_the_texts_it_found(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "all"))
    items = spark.read.parquet(str(tmp_path / "all"))
    index = lexical.build(items, "doc_id")
    q = spark.createDataFrame([(1, "alpha w7")], "query_id long, text string")
    first = retrieval.files.index(retrieval.bm25(q, items, key="doc_id", posted=index), "first")
    terms = retrieval.feedback_terms(q, first, items, index, key="doc_id")
    assert not [f for f in terms.inputFiles() if str(tmp_path) in f] and terms.count() > 2
