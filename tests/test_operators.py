"""Edge cases by hand."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.config import Config
from ragloom.engine import DISABLED, Engine
from ragloom.functions.text import get_or, merge_counts
from ragloom.operators import booking, chunking, fusion, memory, models, retrieval, routing
from ragloom.plans import fixtures
from ragloom.sources import files
from ragloom.streaming import state


def test_chunks_keep_their_limit(spark):
    texts = ["", None, "a" * 2500, "para one\n\n" + "word " * 400 + "\n\npara three", "。".join("汉字" * 30 for _ in range(40)), "x" * 1000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    p = chunking.parents(docs)
    c = chunking.children(p)
    assert max(len(r.text) for r in p.collect()) <= 1000 and max(len(r.text) for r in c.collect()) <= 300
    assert {r.doc_id for r in p.collect()} == {2, 3, 4, 5}
    assert {r.parent_id for r in c.collect()} == {r.parent_id for r in p.collect()}
    assert [r.text for r in p.where("doc_id = 5").collect()] == ["x" * 1000]


def test_rrf_counts_a_text_twice_and_breaks_ties_by_id(spark):
    hits = spark.createDataFrame([(1, "bm25", 1, "b", "p1", "t"), (1, "bm25", 2, "c", "p1", "t"), (1, "knn", 1, "d", None, "u"), (1, "knn", 3, "a", "p9", "w"), (1, "bm25", 3, "e", "p2", "v")], "query_id long, retriever string, rank int, child_id string, parent_id string, text string")
    fused = {r.text: r for r in fusion.rrf(hits).collect()}
    assert abs(fused["t"].score - (1 / 61 + 1 / 62)) < 1e-9 and fused["t"].child_id == "b"
    best = fusion.top_children(fusion.rrf(hits))
    assert [r.child_id for r in best.orderBy("rank").collect()] == ["b", "d", "a", "e"]
    parents = spark.createDataFrame([("p1", "t t", 1, "s"), ("p2", "v", 2, "s")], "parent_id string, text string, doc_id long, source string")
    assert [(r.parent_id, r.position) for r in fusion.expand_parents(best, parents).orderBy("position").collect()] == [("p1", 1), ("p2", 4)]
    q = spark.createDataFrame([(1, "v"), (2, "x")], "query_id long, text string")
    assert [r.chunk_id for r in fusion.augment(best, parents, q).orderBy("rank").collect()] == ["p2", "p1"]
    assert [r.kind for r in fusion.augment(best, parents.limit(0), q).collect()] == ["child"] * 4
    assert {r.answer for r in fusion.search_text(q, spark.createDataFrame([(1, 1, None, "t")], "query_id long, rank int, doc_id string, text string")).collect()} == {"[来源：未知]\nt", fusion.NO_MATCH}


def test_routes(spark):
    cases = {"问" * 15: "规则·短句(<=15字)", "问" * 16: None, "问" * 60: None, "问" * 61: "规则·超长问题(>60字)", "？a?": "规则·多问句", "history of the hospital": "规则·寒暄", "　 ": "空问题", "对比一下这两个科室，然后帮我挂号": "规则·对比择优"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "text string")
    assert {r.text: r.reason for r in routing.rules(df).collect()} == cases | {None: "空问题"}
    off = routing.rules(df, Config(router_enabled=False)).collect()
    assert {r.reason for r in off} == {"路由已关闭"}


def test_memory(spark):
    rows = [(1, t, "system" if t == 0 else "user", str(t)) for t in range(6)] + [(2, t, "user", str(t)) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.turn) for r in memory.window(df, 3).collect()) == [(1, 0), (1, 4), (1, 5), (2, 0), (2, 1), (2, 2)]
    assert sorted(memory.from_json(memory.to_json(df)).collect()) == sorted(df.collect())
    assert memory.get(df, 9).collect() == []


def test_bookings(spark):
    table = spark.createDataFrame(fixtures.BOOKINGS, fixtures.BOOKING)
    asked = spark.createDataFrame(fixtures.REQUESTS, "request_id long, " + fixtures.BOOKING.removeprefix("id long, "))
    new, said = booking.book(table, asked)
    assert {r.request_id: r.message == booking.BOOKED for r in said.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}
    rest, said = booking.cancel(table, asked)
    assert sorted(r.id for r in rest.collect()) == [3, 4] and {r.request_id for r in said.where("message = '取消预约成功'").collect()} == {1, 5}


def test_bookings_of_a_hot_slot_against_a_loop(spark):
    rng = random.Random(5)
    slot = lambda: (rng.choice(["a", "a", "a", "b", None]), "1", rng.choice(["x", "y"]), "2025", "am")
    table = [(i, *slot(), None) for i in range(1, 15)]
    asked = [(i, *slot(), rng.choice(["d", None])) for i in range(1, 40)]
    left, out, gone = list(table), {}, {}
    for r in asked:
        free = None in r[1:6] or all(r[1:6] != t[1:6] for t in left)
        out[r[0]] = booking.BOOKED if free else booking.TAKEN
        left += [(14 + r[0], *r[1:])] if free else []
        gone[r[0]] = min((t[0] for t in table if None not in t[1:6] and t[1:6] == r[1:6]), default=None)
    t, q = spark.createDataFrame(table, fixtures.BOOKING), spark.createDataFrame(asked, "request_id long, " + fixtures.BOOKING.removeprefix("id long, "))
    new, said = booking.book(t, q)
    assert sorted(tuple(r) for r in new.collect()) == sorted(left) and dict(map(tuple, said.collect())) == out
    rest, said = booking.cancel(t, q)
    assert {r.id for r in rest.collect()} == {r[0] for r in table} - set(gone.values())
    assert {i: m == booking.CANCELLED for i, m in map(tuple, said.collect())} == {i: x is not None for i, x in gone.items()}
    assert booking.book(t.limit(0), q.limit(0))[0].collect() == [] and booking.cancel(t.limit(0), q)[1].where("message = '取消预约成功'").count() == 0


def test_streams_and_files(spark, tmp_path):
    fixtures.write_files(str(tmp_path / "f"))
    assert {r.doc_id for r in files.text_dir(spark, str(tmp_path / "f"), recursive=False).collect()} == {"a.txt", "b.md"}
    (tmp_path / "f" / "lang=en").mkdir()
    (tmp_path / "f" / "lang=en" / "e.txt").write_text("zeta")
    assert {r.doc_id for r in files.text_dir(spark, str(tmp_path / "f"), recursive=False).collect()} == {"a.txt", "b.md"}
    assert {r.doc_id for r in files.text_dir(spark, str(tmp_path / "f") + "/").collect()} == {"a.txt", "b.md", "d.txt", "e.txt"}
    (tmp_path / "f" / "x.pdf").write_bytes(b"pdf")
    assert {(r.doc_id, r.text) for r in files.folder(spark, str(tmp_path / "f"), lambda b: b.decode()).collect()} >= {("x.pdf", "pdf"), ("a.txt", "alpha beta\n")}
    spark.createDataFrame([(1, t, "user", "x") for t in range(7)] + [(2, 0, "user", "x")], state.MESSAGES).write.parquet(str(tmp_path / "in" / "conversations.parquet"))
    got = state.run_to_table(state.bounded_memory(spark.readStream.schema(state.MESSAGES).parquet(str(tmp_path / "in" / "conversations.parquet")), 3), str(tmp_path / "mem"))
    assert {(r.conv_id, r.seen, tuple(m.turn for m in r.messages)) for r in got.collect()} == {(1, 7, (4, 5, 6)), (2, 1, (0,))}


def test_streams_over_several_batches(spark, tmp_path):
    """Memory and ingest go on where the batch before ended, and give what one batch gives."""
    rows = [(c, t, "system" if t in (0, 5) else "user", f"{c}-{t}") for c in range(3) for t in range(4 + 3 * c)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 3 == k], state.MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(state.MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates = state.run_to_table(state.bounded_memory(stream, 4), str(tmp_path / "mem"))
    assert updates.select("epoch").distinct().count() > 1
    got = state.latest(updates, "conv_id")
    assert {(r.conv_id, r.seen) for r in got.collect()} == {(c, 4 + 3 * c) for c in range(3)}
    schema = "doc_id long, text string, source string"
    for k in range(2):
        spark.createDataFrame([(k, "hello", "s")], schema).write.mode("append").parquet(str(tmp_path / "docs"))
        docs = spark.readStream.schema(schema).parquet(str(tmp_path / "docs"))
        assert state.ingest(docs, chunking.parents, str(tmp_path / "out")).count() == k + 1
    assert state.bounded([(1, "user", "a"), (0, "system", "s"), (2, "user", "b")], 2) == [(0, "system", "s"), (2, "user", "b")]


def test_knn(spark):
    """Against plain loops, in several blocks of queries; null, short and zero vectors match nothing, ties go by key."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (300, 8)).astype(float)
    items = [(f"k{i:03}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("short", [1.0]), ("zero", [0.0] * 8)]
    queries = [(q, v, rng.integers(0, 3, 8).astype(float).tolist()) for q in range(20) for v in range(2)] + [(99, 0, None), (98, 0, [0.0] * 8)]
    want = set()
    for q, v, e in queries[:-2]:
        n = np.linalg.norm(e)
        s = sorted((-round((1 + np.dot(e, y) / (n * np.linalg.norm(y))) / 2, 6), k) for k, y in items[:300] if n and np.linalg.norm(y))
        want |= {(q, v, r + 1, k, -z) for r, (z, k) in enumerate(s[:5])}
    q = spark.createDataFrame(queries, "query_id long, variant int, embedding array<double>")
    i = spark.createDataFrame(items, "child_id string, embedding array<double>").repartition(5)
    for size in (1 << 20, 8 * 8 * 9):
        retrieval.QUERY_BYTES, keep = size, retrieval.QUERY_BYTES
        try:
            got = {(r.query_id, r.variant, r.rank, r.child_id, r.score) for r in retrieval.knn(q, i, 5, dims=8).collect()}
        finally:
            retrieval.QUERY_BYTES = keep
        assert got == want
    assert retrieval.knn(q, i.limit(0), 5, dims=8).collect() == [] == retrieval.knn(q.limit(0), i, 5, dims=8).collect()


def test_rerank_falls_back(spark):
    """Scorers that score some parents, none, or equal segments twice."""
    found = spark.createDataFrame([(1, "p1", 1, "t1", 1, "s"), (1, "p2", 2, "t2", 2, "s"), (1, "p3", 3, "t1", 1, "s"), (1, "p4", 4, "t4", 4, "s"), (2, "p1", 1, "t1", 1, "s"), (2, "p3", 2, "t1", 1, "s")], "query_id long, parent_id string, position int, text string, doc_id long, source string")
    q = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, text string")

    def scorer(question, text):
        return F.when(F.col(question) == "q", F.when(F.col("parent_id") == "p1", 0.1).when(F.col("parent_id") == "p3", 0.9).when(F.col("parent_id") == "p4", 0.5))

    got = [(r.query_id, r.rank, r.parent_id, r.score) for r in fusion.rerank(found, q, Config(), scorer).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "p1", 0.9), (1, 2, "p4", 0.5), (2, 1, "p1", None), (2, 2, "p3", None)]


def test_variants_rank_apart(spark):
    hits = spark.createDataFrame([(1, v, "bm25", r, c, "p", c) for v, r, c in [(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "a")]], "query_id long, variant int, retriever string, rank int, child_id string, parent_id string, text string")
    assert {r.child_id: r.score for r in fusion.rrf(hits).collect()} == {c: round(1 / 61 + 1 / 62, 10) for c in "ab"}
    q = spark.createDataFrame([(1, "long words here"), (2, "no"), (3, None)], "query_id long, text string")
    got = {(r.query_id, r.variant): r.text for r in retrieval.expand(q, Config(variants=3)).collect()}
    assert got == {(1, 0): "long words here", (1, 1): "words", (2, 0): "no", (3, 0): None}
    assert retrieval.expand(q, Config(variants=1)).count() == 3


def test_splits_by_tokens(spark):
    words = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(1, words), (2, "one two\n\nthree"), (3, None), (4, " \n ")], "doc_id long, text string")
    got = {}
    for r in chunking.split(df, 300, 30, "tokens").orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r.text.split())
    assert set(got) == {1, 2} and max(map(len, got[1])) == 300
    assert sorted({w for c in got[1] for w in c}) == sorted(words.split())


def test_files_and_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.text_dir(spark, str(tmp_path / "none"))
    fixtures.write_files(str(tmp_path / "f"))
    assert {c for c in files.binary_dir(spark, str(tmp_path / "f")).columns} >= {"name", "path", "length", "modificationTime", "content"}
    assert files.text_file(spark, str(tmp_path / "f" / "a.txt")).first().text == "alpha beta\n"
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    table = files.rebuild(df, str(tmp_path / "t"), "id long, text string, more double")
    assert table.dtypes == [("id", "bigint"), ("text", "string"), ("more", "double")]
    files.append(table, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and files.find_by_id(table, "id", 1).count() == 1 and files.find_by_id(table, "id", 7).count() == 0
    with pytest.raises(ValueError):
        files.declared(df, "id long")
    assert files.table_or_empty(spark, str(tmp_path / "none"), "id long").collect() == []
    assert files.in_memory(df, "kept_in_memory").count() == spark.table("kept_in_memory").count() == 1


def test_jdbc(spark, tmp_path):
    """Spark's own distribution has an embedded database."""
    at = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    table = spark.createDataFrame(fixtures.BOOKINGS, fixtures.BOOKING).withColumnsRenamed({"date": "day", "time": "at"})
    table.write.format("jdbc").options(dbtable="bookings", **at).save()
    got = files.jdbc(spark, at["url"], "bookings", driver=at["driver"])
    assert files.find_by_id(got, "id", 2).first()["username"] == "李四" and got.count() == 4


def test_chat_and_ask(spark):
    rows = spark.createDataFrame([(1, [("user", "我是环环")])], f"id long, messages array<{models.MESSAGE}>")
    once = models.reply(rows)
    assert once.first().answer == "[1] 我是环环" and [m.role for m in once.first().messages] == ["user", "ai"]
    parts = models.stream(rows, "id", 3).orderBy("part").collect()
    assert "".join(p.delta for p in parts) == "[1] 我是环环" and len(parts) == 3
    engine = Engine(spark, Config(llm_fallback=False, dims=16))
    docs = spark.createDataFrame([(1, "The clinic opens at eight.", "a"), (2, "Vaccines are given in spring.", "b")], "doc_id long, text string, source string")
    assert {r.key: r.value for r in engine.ingest(docs).collect()} == {"documents": 2, "parents": 2, "children": 2}
    q = spark.createDataFrame([(1, "When does the clinic open?"), (2, "vaccines? spring?"), (3, None)], "query_id long, text string")
    history = spark.createDataFrame([(1, 0, "system", "be brief"), (1, 1, "user", "hi")], "query_id long, turn long, role string, text string")
    got = {r.query_id: r for r in engine.ask(q, history).collect()}
    assert got[1].route == "SIMPLE_RAG" and got[1].answer.startswith("[3] ") and "eight" in got[1].prompt
    assert got[2].route == "AGENTIC_RAG" and "[来源：" in got[2].prompt
    assert engine.ask_agentic(q).count() == 3 and Engine(spark, Config(agentic=False)).ask_agentic(q).first().answer == DISABLED


def test_metadata_is_inherited(spark):
    docs = spark.createDataFrame([(1, "text", "s", {"k": "v", "docId": "x"}), (2, "text", "s", None)], "doc_id long, text string, source string, metadata map<string,string>")
    got = {r.doc_id: r.metadata for r in chunking.children(chunking.parents(docs)).collect()}
    assert got == {1: {"k": "v", "docId": "1", "parentId": "1#0", "source": "s"}, 2: {"docId": "2", "parentId": "2#0", "source": "s"}}


def test_counts_merge(spark):
    row = spark.range(1).select(merge_counts(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))).alias("m"))
    assert row.select(get_or(F.col("m"), "a"), get_or(F.col("m"), "b"), get_or(F.col("m"), "c", 7)).first()[:] == (3, 3, 7)


def test_assistants(spark):
    """A memory per key or shared, a system text in place of the stored one, templates, and texts found for the message."""
    from ragloom.config import ASSISTANTS, Assistant

    rows = [(1, 0, "system", "old"), *((1, t, "user" if t % 2 else "ai", f"1-{t}") for t in range(1, 5)), (2, 0, "user", "2-0")]
    history = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = spark.createDataFrame([(1, 5, "new", "Li"), (3, 7, "first", "Wu")], "conv_id long, turn long, text string, name string")
    engine = Engine(spark)

    def prompts(assistant, **values):
        return {r.conv_id: [(m.role, m.text) for m in r.messages] for r in engine.converse(assistant, history, said, **values).collect()}

    got = prompts(Assistant(system="You are {{name}}.", user="<{{message}}>", memory=3), name=F.col("name"))
    assert got == {1: [("system", "You are Li."), ("ai", "1-4"), ("user", "<new>")], 3: [("system", "You are Wu."), ("user", "<first>")]}
    assert prompts(Assistant(memory=3))[1] == [("system", "old"), ("ai", "1-4"), ("user", "new")]
    assert prompts(Assistant(memory=3, memory_per_key=False)) == {1: [("system", "old"), ("ai", "1-4"), ("user", "new")], 3: [("system", "old"), ("ai", "1-4"), ("user", "first")]}
    assert prompts(Assistant()) == {1: [("user", "new")], 3: [("user", "first")]}
    assert prompts(ASSISTANTS["friend"])[3] == [("user", "你是我的好朋友，请用粤语回答问题。first")]
    docs = spark.createDataFrame([(1, "the new door is red", "s")], "doc_id long, text string, source string")
    engine.ingest(docs)
    assert "the new door is red" in prompts(ASSISTANTS["main"])[1][-1][1]
    tools = engine.model
    engine.model = lambda rows: rows.withColumn("answer", F.array_join("tools", ","))
    assert {r.answer for r in engine.converse(ASSISTANTS["separate"], history, said).collect()} == {"add,root"}
    engine.model = tools
