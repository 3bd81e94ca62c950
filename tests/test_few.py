"""What is looked up in the large tables is searched for once, and those tables aren't shuffled for it, nor is a row lost beyond FEW."""

import pytest

from ragloom.engine import Engine
from ragloom.operators import fusion
from ragloom.sources import files


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.ingest(spark.createDataFrame([(i, f"alpha beta w{i}. gamma w{i % 3} delta.", "s") for i in range(30)], "doc_id long, text string, source string"))
    return e


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "alpha w7"), (2, "gamma w2 beta"), (3, "nothing of it")], "query_id long, text string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_not_searched_again(engine, asked):
    assert "MapInArrow" not in _plan(engine.hits(asked))
    assert "MapInArrow" not in _plan(engine.retrieve(asked))


def test_parents_are_not_shuffled(spark, engine, asked):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fusion.expand_parents(fusion.top_children(fusion.rrf(engine.hits(asked))), engine.parents)
        assert "Exchange hashpartitioning" not in _plan(found) and found.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_more_than_few(engine, asked, monkeypatch):
    rows = lambda: (sorted(map(str, engine.hits(asked).select(sorted(engine.hits(asked).columns)).collect())), sorted(map(str, engine.retrieve(asked).collect())))
    want = rows()
    monkeypatch.setattr(files, "FEW", 0)
    assert want[0] and want == rows()
