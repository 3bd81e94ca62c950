"""The training-data operators against plain Python, and on nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import importlib
import random
import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragloom.llm import exact_dedup, fingerprints, jaccard_join, language_id, license_scan, packing, piece_codec, quality_rules, substring_dedup, token_counts
from ragloom.llm.common import tokenizer_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, rid long, kept string"
ODD = [None, "", " ", "\n", "a", "a  b ", "a\n\nb\n", "\n x", "▁ a▁▁", "<s> <0x0A> 日本　x 😀", "<|endoftext|> b<|endoftext|>", "x\x1cy !\x1c?", "it's  they'll", "a" * 5000, "İ Ç", "a\r\nb\tc"]


def make(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "d", 7, "k") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=None):
    words = words or ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(400)]
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [prose(rng, rng.choice([3, 20, 80, 200, 400])) for _ in range(40)]
    out = list(base)
    for t in base[:15]:
        w = t.split()
        out.append(t.upper())
        k = rng.randrange(len(w))
        out.append(" ".join(w[:k] + ["changed"] + w[k + 1 :]))
        out.append(prose(rng, 60) + " " + " ".join(w[: len(w) // 2]) + "\n" + prose(rng, 60))
    passage = prose(rng, 70)
    out += [prose(rng, rng.randint(0, 30)) + " " + passage + " " + prose(rng, rng.randint(0, 30)) for _ in range(10)]
    hub = base[4].split() * 1
    for _ in range(12):  # a group of near copies whose members aren't all alike
        w = list(prose(rng, 200).split() if False else hub)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.random())
        out.append(" ".join(w))
    return out + ["word " * 300, "word " * 120] + ODD


def test_piece_codec(spark, corpus):
    model = tokenizer_bytes("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r.doc_id: r for r in piece_codec.piece_digests(make(spark, corpus), model).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(corpus):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert [r.ids for r in piece_codec.encode_documents(make(spark, ["a b", None]), model).orderBy("doc_id").collect()] == [sp.encode("a b"), []]


def test_token_counts_and_packing(spark, corpus):
    files = token_counts.byte_tokenizer_files()
    tok = Tokenizer.from_str(files[0].decode())
    ids = [tok.encode(t or "", add_special_tokens=False).ids for t in corpus]
    for r in token_counts.token_counts(make(spark, corpus), files).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((corpus[r.doc_id] or "").encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 1024)
    seen, pad, line = Counter(), 0, {}
    for r in packing.pack(make(spark, corpus), files).collect():
        whole = [*ids[r.doc_id], 0]
        piece = whole[r.start : r.start + r.length]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) == r.ids_crc32 and r.doc_tokens == len(whole)
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        line.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(seen) == sum(len(x) + 1 for x in ids) and set(seen.values()) == {1}
    for s in line.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
        pad += 0 if at & (at - 1) == 0 else 1024 - at
    assert pad == 0
    assert packing.fill([0, 3, 0, 2, 0, 1], 9) in ({5: 1, 3: 1, 1: 1}, {5: 1, 1: 1, 3: 1})
    assert packing.pack(make(spark, []), files).collect() == [] == token_counts.token_counts(make(spark, []), files).collect()


def test_exact_dedup(spark, corpus):
    texts = [*corpus, "É", "é", None, "A", "A"]
    ids = [*range(len(texts) - 1), len(texts) - 2]  # the last two rows repeat each other
    norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    best = {}
    for i, n in zip(ids, norm, strict=True):
        best[n] = max(best.get(n, -1), i)
    size = Counter(norm)
    want = Counter((i, best[n], size[n], i == best[n], hashlib.sha256(n.encode()).hexdigest()) for i, n in zip(ids, norm, strict=True))
    docs = make(spark, texts, ids)
    assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(best.values())
    assert exact_dedup.exact_groups(make(spark, [])).collect() == []


def test_substring_dedup(spark, corpus):
    first, want = {}, []
    for i, t in enumerate(corpus):
        w = (t or "").encode().split()
        keys = [tuple(w[s : s + 50]) for s in range(len(w) - 49)]
        off = [False] * len(w)
        for s, k in enumerate(keys):
            if first.get(k, i) < i:
                off[s : s + 50] = [True] * 50
        for k in keys:
            first.setdefault(k, i)
        kept = b" ".join(x for x, o in zip(w, off, strict=True) if not o)
        want.append((i, len(w), sum(off), hashlib.sha256(kept).hexdigest()))
    assert sum(x[2] for x in want) > 1000
    got = substring_dedup.without_repeats(make(spark, corpus)).drop("kept")
    assert sorted(map(tuple, got.collect())) == want
    assert substring_dedup.without_repeats(make(spark, [])).collect() == []
    nulls = substring_dedup.without_repeats(make(spark, [corpus[3], corpus[3]], [None, 5]))
    assert {r.doc_id: r.n_removed > 0 for r in nulls.collect()} == {None: len(corpus[3].split()) >= 50, 5: False}


def test_substring_dedup_of_repeating_texts(spark):
    """Texts that repeat themselves, share parts of passages, start and end inside them; repeated rows; long passages in many documents."""
    rng = random.Random(21)
    long, other = prose(rng, 900).split(), prose(rng, 300).split()
    some = lambda n: prose(rng, n).split()
    texts = [long, some(20) + long[100:700] + some(20), long[650:] + other, other[:200] + long[:60] + other[200:], ["the"] * 400, ["the"] * 90 + some(60), ["a", "b", "c"] * 100, some(10) + ["a", "b", "c"] * 40]
    texts += [some(30) + long[k : k + 300] + some(5) for k in range(0, 600, 37)] + [["the"] * 30 + long[300:400] + ["the"] * 70, long + long]
    texts = [" ".join(w) for w in texts]
    ids = [*range(len(texts)), 3, 5]
    texts += [texts[3], texts[5]]
    first, want = {}, []
    for i, t in sorted(zip(ids, texts, strict=True)):
        w = t.split()
        keys = [tuple(w[s : s + 50]) for s in range(len(w) - 49)]
        off = [False] * len(w)
        for s, k in enumerate(keys):
            if first.setdefault(k, i) < i:
                off[s : s + 50] = [True] * 50
        want.append((i, len(w), sum(off), " ".join(x for x, o in zip(w, off, strict=True) if not o) if any(off) else t))
    got = substring_dedup.without_repeats(make(spark, texts, ids)).drop("kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_substring_paths_compact(spark):
    """A passage of many paths that always stands as a whole is one span, and a word repeated over and over is one path."""
    rng = random.Random(22)
    passage = prose(rng, 2000)
    docs = make(spark, [passage, prose(rng, 100) + " " + passage, "x " * 5000]).select(*substring_dedup.prepared(None, "doc_id", "text"))
    occ = substring_dedup.path_table(docs, 50, 16).withColumn("base", F.lit(0))
    assert occ.where("rank = 2").count() == 1
    shared = substring_dedup.nodes_of(occ).where(F.col("first.rank") < F.col("last"))
    spans = substring_dedup.compacted(substring_dedup.nodes_of(occ))
    assert shared.count() > 50 and spans.count() == 1


def test_substring_dedup_verifies_words():
    """A span whose digest isn't that of the words, as after a clash of hashes, isn't cut."""
    words = [b"%d" % i for i in range(60)]
    good = {"start": 2, "edges": 3, "digest": substring_dedup._digest(words[2:54])}
    assert substring_dedup.covered(words, [good], 50).sum() == 52
    assert substring_dedup.covered(words, [good | {"digest": b"else"}], 50).sum() == 0


def test_substring_cut_keeps_clashing_columns(spark):
    rng = random.Random(23)
    passage = prose(rng, 80)
    docs = make(spark, ["a " + passage, "b " + passage, None]).select("*", F.lit(1).alias("n_words"), F.lit("r").alias("row"), F.lit(2).alias("kept_sha256"), F.struct(F.lit(3).alias("a-b")).alias("cuts"), F.lit(4).alias("x.y"))
    got = substring_dedup.cut(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].text for i in range(3)] == ["a " + passage, "b", None] and [rows[i].n_chars for i in range(3)] == [len(passage) + 2, 1, None]
    assert rows[1].kept == "k" and rows[1]["row"] == "r" and rows[1]["x.y"] == 4


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (5, 60)])
def test_jaccard_join(spark, corpus, size, percent):
    sets = []
    for t in corpus:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = jaccard_join.similar_groups(make(spark, corpus), size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    if percent == 80:
        left = jaccard_join.one_of_each(make(spark, corpus))
        empty = {i for i, s in enumerate(sets) if not s}
        assert {r.doc_id for r in left.collect()} == {find(i) for i in range(len(sets))} | empty and "rid" in left.columns
        assert jaccard_join.similar_groups(make(spark, [])).collect() == []


def test_fingerprints(spark, corpus):
    got = {r.doc_id: r for r in fingerprints.compare_with_next(make(spark, corpus)).collect()}
    n = len(corpus)
    for i, t in enumerate(corpus):
        t, other = t or "", corpus[(i - 1) % n] or ""
        k = len(t) // 3
        changed = t[: len(t) - k] + other[:k]
        mark = fingerprints.fingerprint(t)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (mark, fingerprints.fingerprint(changed))
        assert got[i].near_next == fingerprints.likeness(mark, fingerprints.fingerprint(other)) and 0 <= got[i].near_edited <= 1
    assert fingerprints.compare_with_next(make(spark, [])).collect() == []
    assert fingerprints.compare_with_next(make(spark, ["only one"])).first().near_next == 1.0


def test_language_id(spark):
    rng = random.Random(1)
    words = {"aa": ["the", "and", "thing", "other"], "bb": ["der", "und", "schön", "nicht"], "cc": ["qué", "año", "llama", "niño"]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(4, 60))), k) for i in range(300) for k in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 !", "bb"), (902, "the other", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, docs.where("doc_id % 3 != 1")).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.97 * len(held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs, docs.limit(0)).collect()} == {"und"}


def test_quality_rules(spark):
    rng = random.Random(2)
    texts = [prose(rng, 60) + "." if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 50).split()) for i in range(300)]
    docs = make(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_rules.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_rules.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in range(200, 300)) and all(0 <= s <= 1 for s in got.values()) and len(got) == 302
    kept = quality_rules.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(300) if i % 3}
    assert quality_rules.train(docs, labels.limit(0)) == (0.0, [])


def test_license_scan(spark):
    texts = ["prose\nLicensed under CC BY-NC 4.0.", "x. Released under the MIT License.", "# SPDX-License-Identifier: Apache-2.0\ncode", "He lost his driving license.", "nothing here", None, "", "This work is licensed under the GNU General Public License, version 3.\nReleased under the BSD License."]
    docs = make(spark, [*texts, texts[1]], [*range(8), 1])
    rows = license_scan.licenses(docs).collect()
    assert len(rows) == 9
    got = {r.doc_id: r for r in rows}
    assert [got[i].family for i in range(7)] == ["cc-by-nc", "mit", "apache-2.0", "none", "none", "none", "none"]
    assert got[7].families == ["bsd", "gpl"] and got[7].n_paragraphs == 2


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software.
"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Keep this.
"""
BSD_HEADER = "// Use of this source code is governed by a BSD-style\r\n// license that can be found in the LICENSE file.\r\n\r\nint x;\r\n"
GPL = "some prose\nThis work is licensed under the\nGNU General Public License, version 3.\nmore prose"


def test_license_scan_of_wrapped_notices(spark):
    rng = random.Random(9)
    far = "\n".join(prose(rng, 9) for _ in range(400)).split("\n")  # template words far apart are no notice
    for k, w in zip(range(0, 400, 80), ["released", "under the", "mit", "license", "was"], strict=True):
        far[k] += " " + w
    texts = [MIT, BSD, BSD_HEADER, GPL, "\n".join(far), "\n".join(far[:100]) + "\n" + GPL, GPL + "\n" + GPL.replace("\n", " ")]
    got = {r.doc_id: r for r in license_scan.licenses(make(spark, texts)).collect()}
    assert [got[i].families for i in range(7)] == [["mit"], ["bsd"], ["bsd"], ["gpl"], [], ["gpl"], ["gpl"]]
    assert [got[i].n_paragraphs for i in (0, 1, 2, 3, 4)] == [1, 1, 1, 1, 0]


def test_jaccard_join_without_star_candidates(spark):
    rng = random.Random(12)
    word = lambda n: ["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)]
    base, other = word(200), word(1000)
    one, two = list(base), list(base)
    one[60], two[140] = "first", "second"
    texts = [" ".join(x) for x in (base + other, one, two, *[other] * 5)]  # the first quotes the pair, and leads its tokens
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    alike = {(i, j) for j in range(8) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert alike == {(1, 2)} | {(i, j) for j in range(3, 8) for i in range(3, j)}
    got = jaccard_join.similar_groups(make(spark, texts), 4, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 1, 2: 1} | dict.fromkeys(range(3, 8), 3)


def test_license_scan_of_several_licences(spark):
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."
    cases = [
        ("Licensed under either of Apache License, Version 2.0 or the MIT license", ["apache-2.0", "mit"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["apache-2.0", "mit"]),
        ("Some prose is here. Released under the MIT License. More of it follows. Licensed under CC BY-NC 4.0. The end.", ["cc-by-nc", "mit"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["cc-by-nc"]),
        (lesser, ["lgpl"]),
        ("Licensed under the MIT license or the license of your choice and the terms of the contract", ["mit"]),
    ]
    got = {r.doc_id: r.families for r in license_scan.licenses(make(spark, [t for t, _ in cases])).collect()}
    assert got == {i: f for i, (_, f) in enumerate(cases)}


def test_language_id_learns_rare_languages(spark):
    rng = random.Random(3)
    words = {"aa": ["the", "and", "thing", "other"], "bb": ["der", "und", "schön", "nicht"], "cc": ["qué", "año", "llama", "niño"]}
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k) for i in range(1203) for k in ["cc" if i >= 1200 else "ab"[i % 2] * 2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, docs, most=60).collect()}
    assert {got[i] for i in range(1200, 1203)} == {"cc"} and sum(got[i] == k for i, _, k in rows) >= 0.97 * len(rows)
    assert 40 <= language_id.sample_of_each(docs, 60).count() <= 90


def test_pipeline_keeps_columns(spark, tmp_path, corpus):
    pipeline = importlib.import_module("corpus_pipeline")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(corpus)], columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == ids
