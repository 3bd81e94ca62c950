"""Appends, deletions and merges of a knowledge base give what a rebuild gives; rebuilds that fail leave the old rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ragloom.engine import Engine
from ragloom.operators import lexical, retrieval, segments
from ragloom.sources import files, snapshots

DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, "\n\n".join(" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(rng.randint(0, 6))), "s") for i in range(60)]
    return spark.createDataFrame([*rows, (60, None, "s"), (61, "...", "s"), (62, rows[0][1], "s")], DOCS)


@pytest.fixture(scope="module")
def questions(docs):
    return docs.where("doc_id % 7 = 0 AND length(text) > 0").select(F.col("doc_id").alias("query_id"), F.expr("substring(text, 1, 60)").alias("text"))


def answers(engine, questions):
    rows = engine.retrieve(questions).collect()
    found = engine.hits(questions).select("query_id", "retriever", "rank", "child_id", "score").collect()
    return sorted(map(str, rows)), sorted(map(str, found))


def rebuilt(spark, docs, questions):
    engine = Engine(spark)
    engine.ingest(docs)
    return answers(engine, questions)


def test_appends_deletions_and_merges_equal_a_rebuild(spark, docs, questions, tmp_path):
    path = str(tmp_path / "base")
    base = segments.Base(spark, path)
    for k in range(4):
        base.append(docs.where(f"pmod(xxhash64(doc_id), 4) = {k}"))
    assert answers(base.engine(), questions) == rebuilt(spark, docs, questions)
    old = segments.Base(spark, path)
    base.delete(docs.where("doc_id % 5 = 1").select("doc_id"))
    base.delete(spark.createDataFrame([(3,), (6,), (999,)], "doc_id long"))
    rest = docs.where("doc_id % 5 <> 1 AND doc_id <> 3")
    assert answers(base.engine(), questions) == rebuilt(spark, rest, questions)
    assert answers(old.engine(), questions) == rebuilt(spark, docs, questions)  # a reader keeps its state
    new = spark.createDataFrame([(2, "quite new words here", "n"), (500, "abc", "n")], DOCS)
    base.put(new)
    rest = rest.where("doc_id <> 2").unionByName(new)
    assert answers(base.engine(), questions) == rebuilt(spark, rest, questions)
    n = len(base.says["segments"])
    assert base.merge(2) and len(base.says["segments"]) < n
    while base.merge(2):
        pass
    assert answers(segments.Base(spark, path).engine(), questions) == rebuilt(spark, rest, questions)
    base.delete(rest.select("doc_id"))
    assert base.engine().hits(questions).count() == 0 and base.postings.docs == 0 and base.postings.tokens == 0
    with pytest.raises(snapshots.Conflict):
        old.append(new)


def test_a_deletion_reads_no_text(spark, docs, tmp_path):
    base = segments.Base(spark, str(tmp_path / "base"))
    base.append(docs)
    s = base.says["segments"][0]
    plan = lexical.without(base._lexical(s), base._live("children", [s]).select("child_id"), "child_id", 0).terms
    assert "child_id" in base.children.columns and plan.count() == 0
    keys = base._live("children", [s]).join(docs.select("doc_id"), "doc_id", "left_semi").select("child_id", "doc_id")
    scan = [x for x in keys._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x or "FileScan" in x]
    assert scan and not any("text:" in x for x in scan)


def test_a_batch_is_added_once(spark, docs, tmp_path):
    base = segments.Base(spark, str(tmp_path / "base"))
    assert base.append(docs.limit(3), ("docs", 0)) and not base.append(docs.limit(3), ("docs", 0))
    assert len(segments.Base(spark, str(tmp_path / "base")).says["segments"]) == 1


def test_a_failed_rebuild_leaves_the_old_rows(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("half-way")).cast("long")).alias("id"))
    path = str(tmp_path / "versions")
    for write, there, at in ((files.versioned, lambda: files.read(spark, path), path), (files.rebuild, lambda: spark.read.parquet(str(tmp_path / "plain")), str(tmp_path / "plain"))):
        write(spark.range(5), at)
        with pytest.raises(Exception, match="half-way"):
            write(bad, at)
        assert there().count() == 5
        reader = there()
        write(there().where("id > 1"), at)  # it reads what it replaces
        assert there().count() == 3
        if write is files.versioned:
            assert (reader.count(), files.read(spark, path, 1).count()) == (5, 5)
    snapshots.prune(spark, path, 1)
    assert files.read(spark, path).count() == 3 and len([x for x in os.listdir(path) if x.startswith("data-")]) == 1
    with pytest.raises(FileNotFoundError):
        files.read(spark, str(tmp_path / "none"))


def test_bm25_equals_plain_loops(spark, docs, questions, monkeypatch):
    """Small blocks, several passes of questions and bounds that matter."""
    import math

    monkeypatch.setattr(lexical, "BLOCK", 5)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 600)
    monkeypatch.setattr(lexical, "HELD", 10)
    rows = {r.doc_id: (r.text or "").replace(".", " ").split() for r in docs.collect()}
    mean = sum(map(len, rows.values())) / len(rows)
    df = {}
    for ws in rows.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    want = set()
    for q in questions.collect():
        scores = []
        for i, ws in rows.items():
            s = sum(math.log1p((len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in set(q.text.split()) if t in df and t in ws)
            if s:
                scores.append((-round(s, 6), i))
        want |= {(q.query_id, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:6])}
    got = {(r.query_id, r["rank"], r.doc_id, r.score) for r in retrieval.bm25(questions, docs.repartition(3), k=6, key="doc_id").collect()}
    assert got == want
    assert retrieval.bm25(questions.limit(0), docs, key="doc_id").collect() == [] == retrieval.bm25(questions, docs.limit(0), key="doc_id").collect()
