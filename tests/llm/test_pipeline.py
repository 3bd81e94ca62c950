"""The pipeline's stages, one after the other, against plain Python."""

import array
import importlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragloom.llm import quality_rules
from ragloom.llm.common import tokenizer_bytes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns with names that operators use themselves.
CLASHING = ["row", "key", "score", "k0", "rid", "rank", "kept", "cuts", "a-b", "slot", "digest", "prefix"]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def corpus(rng):
    good = [prose(rng, rng.randint(20, 250)) + "." for _ in range(90)]
    junk = [" ".join(rng.choices(["!!!", "$$$", "CLICK", "WIN", "100%", "###"], k=rng.randint(20, 80))) for _ in range(60)]
    texts = [*good, *junk]
    texts += [t.upper() for t in good[:10]] + [good[3]] * 3  # exact copies
    for t in good[10:25]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = prose(rng, 90)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) + (" " + passage if k % 3 else "") for k in range(9)]
    texts += ["word " * 400, prose(rng, 6000), None, "", " \n", "a", "x y"]
    order = rng.sample(range(1000), len(texts))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(order, texts, strict=True)]
    labels = [(i, int(t in good), 0) for i, t, *_ in rows if t in good or t in junk]
    return [*rows, *rows[:4]], labels


def quality(rows, model):
    def score(t):
        x = quality_rules.statistics(t)
        return 1 / (1 + math.exp(-model[0] - sum(w for w, path in model[1] if all((x[j] > cut) == side for j, cut, side in path))))

    return [r for r in rows if score(r[1]) >= 0.3]


def exact(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for r in rows:
        k = (r[1] or "").translate(low)
        best[k] = max(best.get(k, r), r, key=lambda r: r[0])
    return list(best.values())


def near(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    rows = sorted(set(rows), key=lambda r: r[0])
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def substrings(rows, window=50):
    first, out = {}, []
    for i, t, *_ in rows:
        w = (t or "").split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    for i, t, lang, source, n in rows:
        w = (t or "").split()
        off = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                off[s : s + window] = [True] * window
        kept = " ".join(x for x, o in zip(w, off, strict=True) if not o) if any(off) else t
        out.append((i, kept, lang, source, None if kept is None else len(kept)))
    return out


def test_stages_equal_plain_python(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows, labels = corpus(random.Random(17))
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING} | {"s.t": F.struct(F.col("doc_id").alias("x-y"))})
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = quality_rules.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")).where(~quality_rules.fold()))
    want, steps = rows, [lambda r: quality(r, model), exact, near, substrings]
    for (name, stage), plain in zip(pipeline.STAGES[:-1], steps, strict=True):
        before, want = len(want), plain(want)
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [*(c.split()[0] for c in COLUMNS.split(", ")), *CLASHING, "s.t"]
        got = docs.collect()
        assert sorted(map(str, (r[:5] for r in map(tuple, got)))) == sorted(map(str, want)), name
        assert all(r[c] == f"{c}{r.doc_id}" and r["s.t"]["x-y"] == r.doc_id for r in got for c in CLASHING)
        assert name == "substrings" or len(want) < before
    assert sum(r[1] is not None and len(r[1]) < 400 for r in want) > 5
    pieces = defaultdict(list)
    for r in pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    tok = Tokenizer.from_buffer(tokenizer_bytes("byte_bpe_50k.json"))
    windows = defaultdict(list)
    assert set(pieces) == {r[0] for r in want}
    for i, t, *_ in want:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(array.array("I", ids[at : at + p.length]).tobytes())
            at += p.length
            windows[p.sequence_id].append((p.offset, p.length))
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)] * 3])
def test_stages_of_nothing(spark, tmp_path, rows):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == ([1] if rows else [])
