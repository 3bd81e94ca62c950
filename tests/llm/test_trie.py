"""The prefix trie against plain Python."""

import hashlib
import random
import zlib

import numpy as np

from ragloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Rows of (conv_id, turn, role, text), turns in distinct order, to the nodes' rows."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    ts = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in ts}
    new = {c: ts.get(c - int(np.fmod(c, 5)), [])[: h[c]] + ts[c][h[c] :] for c in ts}
    root = {"kids": {}, "ids": [], "ends": [], "bytes": 0, "d": 0, "up": None}
    nodes = [root] if new else []
    for c in sorted(new):
        at = root
        at["ids"].append(c)
        for d, t in enumerate(new[c], 1):
            if t not in at["kids"]:
                at["kids"][t] = {"kids": {}, "ids": [], "ends": [], "bytes": len(t[1].encode()), "d": d, "up": at}
                nodes.append(at["kids"][t])
            at = at["kids"][t]
            at["ids"].append(c)
        at["ends"].append(c)
    for x in reversed(nodes):  # a node comes before those below it
        x["leaves"] = sum(k["leaves"] for k in x["kids"].values()) or 1
        x["saved"] = (len(x["ids"]) - 1) * x["bytes"] + sum(k["saved"] for k in x["kids"].values())
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((x["ids"][0], x["d"], x["up"]["ids"][0] if x["up"] else -1, len(x["ids"]), len(x["kids"]), x["leaves"], x["saved"], sha(x["ends"])) for x in nodes)


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.prefix_trie(df).collect())


def conversations(rng, n, most, words):
    out = []
    for c in rng.sample(range(-n, 3 * n), n):
        turns = [None, *range(rng.randint(0, most))]
        out += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in (turns if rng.random() < 0.2 else turns[1:] or [0])]
    return out


def test_trie_equals_plain_python(spark):
    rng = random.Random(1)
    rows = conversations(rng, 300, 12, ["a", "ü😀", "", None]) + [(7000 + 5 * k, t, "user", "same") for k in range(150) for t in range(k % 4 + 1)]
    rows += [(9000, t, "user", str(t)) for t in range(1500)] + [(None, 1, "user", "lost")]  # one long conversation
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_long_shared_conversations(spark):
    rows = [(c, t, "user", str(t)) for c in (10, 15, 20) for t in range(400 + c)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_heavy_levels_meet_the_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST", 3)
    monkeypatch.setattr(prefix_trie, "FOREST", 20)
    rows = conversations(random.Random(2), 200, 9, ["a", "b"])
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_trie_of_nothing_and_of_repeated_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(3, 1, "user", "x")] * 3 + [(3, 0, None, "y" * 300_000), (4, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == plain(rows)
    from pyspark.sql import functions as F

    assert found(df.withColumns({c: F.lit("z") for c in ("i", "h1", "part", "len", "a-b")})) == plain(rows)


def test_louds_navigation():
    trie = prefix_trie.Louds(np.array([2, 1, 2, 0, 0, 1, 0]))
    assert trie.parents().tolist() == [0, 0, 1, 2, 2, 5]
    assert trie.levels() == [(0, 1), (1, 3), (3, 6), (6, 7)]
