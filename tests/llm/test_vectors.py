"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from ragloom.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = [np.array(v, np.float32).astype(float) if g else None for (_, v), g in zip(rows, good, strict=True)]
    n = len(rows)
    links = [[] for _ in range(n)]
    for size in {len(v) for v in x if v is not None}:
        at = [i for i in range(n) if x[i] is not None and len(x[i]) == size]
        m = np.stack([x[i] / np.abs(x[i]).max() for i in at])
        m /= np.linalg.norm(m, axis=1)[:, None]
        for i, j in zip(*np.nonzero(m @ m.T >= cosine), strict=True):
            if i != j:
                links[at[i]].append(at[j])
    root = [None] * n
    for i in range(n):
        if root[i] is None:
            stack, seen = [i], {i}
            while stack:
                for j in links[stack.pop()]:
                    if j not in seen:
                        seen.add(j)
                        stack.append(j)
            least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            for j in seen:
                root[j] = least
    return sorted(((r[0] is None, r[0] or 0), len(links[i]), root[i] is None, root[i] or 0, r[0] == root[i]) for i, r in enumerate(rows))


def found(df, **more):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id is None, r.component_id or 0, r.kept) for r in vector_dedup.near_vectors(df, **more).collect())


def at_cosine(rng, x, cosine):
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return cosine * x + math.sqrt(1 - cosine * cosine) * z


def sphere(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_groups_equal_brute_force(spark, monkeypatch):
    """A third of all rows in one group, wide groups whose balls must be compared member by member, copies and odd rows."""
    monkeypatch.setattr(vector_dedup, "GATHER", 40)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = sphere(rng, 120, 64)
    hot = at_cosine(rng, np.repeat(x[:1], 200, 0), 0.99)
    wide = at_cosine(rng, np.repeat(x[1:5], 40, 0), 0.955)  # any two are about 0.912 alike: many just above, some below
    rows = [*x, *hot, *wide, *np.repeat(x[5:6], 30, 0), *(x[5:8] * 3.5)]
    order = rng.permutation(len(rows))
    rows = [(int(i), [float(a) for a in rows[i]]) for i in order]
    rows += [(None, rows[0][1]), rows[1], rows[1], (9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] * 64), (9006, [1.0, float("inf")]), (9007, [1.0, 2.0, 2.0]), (9008, [2.0, 4.0, 4.1]), (9009, [1e-40, 1.0])]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), shape=(2, 16, 5)) == plain(rows)


def test_no_vectors(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA)) == [((False, 1), 0, False, 1, True), ((False, 2), 0, False, 2, True)]


def test_other_columns_may_have_any_name(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], SCHEMA).withColumns({c: F.lit(0) for c in ("vector", "k1", "rid", "ball", "a-b")})
    assert found(df) == [((False, 1), 1, False, 1, True), ((False, 2), 1, False, 1, False)]


@pytest.mark.parametrize("n", [10_000, 50_000, 10**6, 10**9])
def test_recall_at_the_threshold(n):
    """Pairs at cosine 0.9 exactly that meet in a bucket and pass the sketches, by the shape planned for n vectors."""
    rng = np.random.default_rng(n)
    x = sphere(rng, 400, 64)
    y = at_cosine(rng, x, 0.9)
    shape = vector_dedup.plan(n, 64)
    meet = (vector_dedup.buckets(x, *shape)[:, :, :, None] == vector_dedup.buckets(y, *shape)[:, :, None, :]).any((1, 2, 3))
    differ = np.bitwise_count((vector_dedup.sketches(x) ^ vector_dedup.sketches(y)).view(np.uint64)).sum(1)
    share = math.acos(0.9) / math.pi
    near = differ <= vector_dedup.SKETCH * share + vector_dedup.SLACK * math.sqrt(vector_dedup.SKETCH * share * (1 - share))
    assert (meet & near).mean() > 0.97
    far = (vector_dedup.buckets(x, *shape)[:-1, :, :, None] == vector_dedup.buckets(x, *shape)[1:, :, None, :]).any((1, 2, 3))
    assert far.mean() < 0.1


@pytest.mark.parametrize("d", [1, 2, 16, 64, 128, 512])
def test_fast_hadamard_equals_the_matrix(d):
    h = np.array([[1.0]])
    while len(h) < d:
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(d).normal(size=(7, d))
    assert np.allclose(vector_dedup.hadamard(x), x @ h)
