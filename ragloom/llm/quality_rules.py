"""Quality classifier: a sparse ensemble of rules.

Shallow trees on bootstrap samples give conjunctive rules over text statistics (every path from the root), a lasso logistic
regression weighs them, and the rules that keep a weight are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_mod, documents, schema_of, small_batches
from .sketches import sample

#: Labelled rows that the rules are learnt from (documented bound).
SAMPLE = 6000
STATS = ["n_chars", "n_words", "word_chars", "upper", "digits", "marks", "symbols", "shouts", "bars", "stops", "high", "distinct", "repeats", "lines", "line_words", "line_repeats", "marked_words"]
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_SYMBOLS, _MARKS = np.frombuffer(b"#$%&*@^~+=<>{}[]\\/_", np.uint8), np.frombuffer(b".,;:!?'\"()-", np.uint8)


def statistics(text: str | None) -> tuple[float, ...]:
    """The numbers named in STATS; all 0 for null and empty texts."""
    if not text:
        return (0.0,) * len(STATS)
    raw = text.encode("utf-8", "replace")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, w, k = len(raw), max(1, len(words)), len(lines)
    return (
        float(len(text)), float(len(words)), (n - c[32] - c[10]) / w, c[_UPPER].sum() / n, c[_DIGIT].sum() / n, c[_MARKS].sum() / n, c[_SYMBOLS].sum() / n, c[33] / n, c[124] / n, c[46] / w, c[128:].sum() / n,
        len(set(words)) / w, sum(map(operator.eq, words, words[1:])) / w, float(k), w / k, 1 - len(set(lines)) / k, sum([not x[-1].isalnum() for x in words]) / w,
    )


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns as k0, k1, ... (their own names may clash) and the statistics of every text as s_..."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in blocks(batches):
            rows = np.array([statistics(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(f"k{i}") for i in range(len(keep))), *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=[*(f"k{i}" for i in range(len(keep))), *(f"s_{x}" for x in STATS)])

    kinds = schema_of(**{f"k{i}": docs.schema[x].dataType for i, x in enumerate(keep)}, **{f"s_{x}": "double" for x in STATS})
    return docs.select(F.col("text").alias("text"), *(F.col(f"`{x}`").alias(f"k{i}") for i, x in enumerate(keep))).mapInArrow(run, kinds)


def grow(x: np.ndarray, y: np.ndarray, rng, depth: int, path: tuple = ()) -> list[tuple]:
    """Paths of (statistic, threshold, above) of a tree's nodes, by squared error, half of the statistics tried at a node."""
    if not depth or len(y) < 20 or y.min() == y.max():
        return []
    best = None
    for j in rng.permutation(x.shape[1])[: x.shape[1] // 2 + 1]:
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0.04, 0.96, 24))):
            above = x[:, j] > cut
            k = above.sum()
            if 5 <= k <= len(y) - 5:
                gain = k * (m := y[above].mean()) ** 2 + (len(y) - k) * y[~above].mean() ** 2
                if best is None or gain > best[0] + 1e-9:
                    best = gain, int(j), float(cut), above
    if best is None or best[0] - len(y) * y.mean() ** 2 < 1e-6:
        return []
    _, j, cut, above = best
    out = []
    for side, rows in ((True, above), (False, ~above)):
        here = (*path, (j, cut, side))
        out += [here, *grow(x[rows], y[rows], rng, depth - 1, here)]
    return out


def holds(path: tuple, x: np.ndarray) -> np.ndarray:
    return reduce(operator.and_, ((x[:, j] > cut) == side for j, cut, side in path))


def lasso(r: np.ndarray, y: np.ndarray, l1: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of an L1-penalised logistic regression, by accelerated proximal steps."""
    a = np.hstack([np.ones((len(r), 1)), r])
    step = 4 / max(1e-9, np.linalg.norm(a, 2) ** 2 / len(y))
    w = v = np.zeros(a.shape[1])
    for k in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / len(y)
        u = v - step * g
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * l1, 0)
        v, w = u + k / (k + 3) * (u - w), u
    return float(w[0]), w[1:]


def learn(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, l1: float = 5e-4, seed: int = 5) -> tuple[float, list[tuple[float, tuple]]]:
    """(intercept, [(weight, rule)])."""
    if not len(y):
        return 0.0, []
    if y.min() == y.max():
        return (4.0 if y[0] else -4.0), []
    rng = np.random.default_rng(seed)
    rules: dict[bytes, tuple] = {}
    for _ in range(trees):
        pick = rng.integers(0, len(y), min(len(y), 2000))
        for path in grow(x[pick], y[pick], rng, depth):
            seen = holds(path, x)
            if 0 < seen.sum() < len(y):
                rules.setdefault(seen.tobytes(), path)
    paths = list(rules.values())
    if not paths:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    b, w = lasso(np.column_stack([holds(p, x) for p in paths]).astype(float), y, l1)
    return b, [(float(k), p) for k, p in zip(w, paths, strict=True) if abs(k) > 1e-6]


def compiled(model: tuple[float, list[tuple[float, tuple]]]) -> Column:
    """The rules as one expression over the statistics' columns: the probability of quality 1."""
    total = F.lit(model[0])
    for weight, path in model[1]:
        rule = reduce(operator.and_, ((F.col(f"s_{STATS[j]}") > cut) if side else (F.col(f"s_{STATS[j]}") <= cut) for j, cut, side in path))
        total = total + F.when(rule, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """A model from ``labels`` (doc_id, quality) and the texts of their documents; null labels and rows without a text's row
    are left out, a document labelled twice counts as its larger label."""
    chosen = sample(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")), "doc_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``most``
    found = with_statistics(rows.select("doc_id", "text", "quality"), ["doc_id", "quality"]).toPandas().sort_values(["k0", *[f"s_{s}" for s in STATS]])
    return learn(found[[f"s_{s}" for s in STATS]].to_numpy(float), (found["k1"].to_numpy() == 1).astype(float))


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """The score of every row and its ``keep`` columns; empty and null texts are scored by their statistics, all 0."""
    return with_statistics(docs, keep).select(compiled(model).alias("score"), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))


def accepted(docs: DataFrame, model, least: float = 0.3) -> DataFrame:
    """The rows that score ``least`` or more, with all their columns, whatever these are called."""
    cols = docs.columns
    found = with_statistics(docs, cols).where(compiled(model) >= least)
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(cols)))


def fold(column: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(column, 5) == 0, F.lit(False))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold()))
    return score(docs, model, ["doc_id"]).select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
