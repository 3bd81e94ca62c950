"""Passages that stand several times in one document, rows of equal ids and small vocabularies, against brute force."""

import random

import pytest

from ragloom.llm import substring_dedup

SCHEMA = "doc_id long, text string"


def plain(rows, window):
    first = {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = t.split()
        off = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                off[s : s + window] = [True] * window
        out.append((i, len(w), sum(off), " ".join(x for x, o in zip(w, off, strict=True) if not o) if any(off) else t))
    return sorted(out)


def found(spark, rows, window, k):
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), window, k)
    return sorted(map(tuple, got.drop("kept_sha256").collect()))


def words(rng, n, vocabulary=10**9):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_passages_twice_in_a_document(spark):
    rng = random.Random(31)
    rows = []
    for j, k in enumerate(range(55, 121, 5)):
        p = words(rng, 200)
        rows.append((3 * j, " ".join(words(rng, 20) + p[:k] + words(rng, 20))))
        rows.append((3 * j + 1, " ".join(words(rng, 20) + p + words(rng, 20) + p + words(rng, 20) + p[20:180])))
        if j % 2:  # another row of the same id
            rows.append((3 * j + 1, " ".join(words(rng, 25) + p[10:190] + words(rng, 7))))
    assert found(spark, rows, 50, 16) == plain(rows, 50)


@pytest.mark.parametrize("vocabulary,window,k", [(2, 5, 3), (3, 5, 3), (3, 6, 3), (6, 6, 4), (6, 5, 2)])
def test_small_vocabularies(spark, vocabulary, window, k):
    rng = random.Random(vocabulary * 100 + window)
    rows = [(rng.randrange(60), " ".join(words(rng, rng.randint(0, 60), vocabulary))) for _ in range(80)]
    rows += rows[:5]
    assert found(spark, rows, window, k) == plain(rows, window)
