"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1- to 3-grams of a lower-cased text; document frequencies cover all training documents. The weights are
learnt by follow-the-regularised-leader with L1 and L2 penalties on a bounded sample of labelled documents; most of them end at
exactly 0, and only the features that keep a weight are sent to the workers. A temperature fitted on a part of the sample that
isn't trained on calibrates the probabilities. Term frequencies are shares of the text, so a score is a sum of looked-up weights
over the whole text, however long, without a per-document table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, crc_mod, documents, materialise, schema_of, small_batches
from .sketches import slices, summed

WIDTH, ORDERS, PIECE = 1 << 17, 3, 1 << 18
#: Labelled documents that the weights are learnt from (documented bound); frequencies use all. Each language has the same number
#: of them, or all it has, and never fewer than LEAST for the sake of the bound.
SAMPLE, LEAST = 3000, 30
#: n-grams of the sample that the driver holds (documented bound): each language's share of it is filled in the order of a hash.
HELD = 8_000_000
#: Elastic net: at 0.03 a quarter of the weights of seen n-grams stay, with the accuracy of 1e-4, where nearly all do.
L1 = 0.03


def grams(text: str):
    """Feature numbers of a text's n-grams, in bounded pieces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    for at in range(0, len(codes), PIECE):
        c = codes[at : at + PIECE + ORDERS - 1]
        h, found = np.zeros(len(c), np.uint64), []
        for k in range(ORDERS):
            h = h[: len(c) - k] * np.uint64(0x9E3779B97F4A7C15) + c[k:] + np.uint64(1)
            m = h ^ (h >> np.uint64(29))
            found.append(((m * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(47)).astype(np.int64)[:PIECE])
        yield np.concatenate(found)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        counts, n = np.zeros(2 * WIDTH, np.int64), 0
        for b in blocks(batches):
            for t in b.column("text").to_pylist():
                seen = np.zeros(WIDTH, bool)
                for g in grams(t or ""):
                    seen[g] = True
                counts[np.flatnonzero(seen)] += 1
                n += 1
        counts[WIDTH] = n  # the number of documents travels along
        yield from slices(counts)

    total = summed(docs.select("text").mapInArrow(run, "slice int, counts binary"), 2 * WIDTH)
    return total[:WIDTH], int(total[WIDTH])


def sparse_rows(docs: DataFrame) -> list:
    """(label, features, shares) of a bounded sample."""

    def run(batches):
        for b in blocks(batches):
            feats, shares = [], []
            for t in b.column("text").to_pylist():
                f, n = np.unique(np.concatenate([*grams(t or ""), np.zeros(0, np.int64)]), return_counts=True)
                feats.append(f.astype(np.int32))
                shares.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(feats, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "f", "v"])

    found = materialise(docs.select("lang", "text").mapInArrow(run, "lang string, f array<int>, v array<float>"), "language-sample")
    kinds = max(1, found.select("lang").distinct().count())
    ahead = F.sum(F.size("f")).over(Window.partitionBy("lang").orderBy(F.xxhash64("f", "v")).rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < HELD // kinds).drop("ahead").toArrow()
    return [(lang, f.values.to_numpy(), v.values.to_numpy()) for lang, f, v in zip(rows["lang"].to_pylist(), rows["f"], rows["v"], strict=True)]


def sample_of_each(docs: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """About ``most`` rows, the same ones each time; every language of ``docs`` is among them. All rows if there are no more."""
    sizes = dict(docs.groupBy("lang").count().collect())  # one number a language, as the model has a column for each
    if sum(sizes.values()) <= most:
        return docs
    left, each = most, LEAST
    for k, n in enumerate(sorted(sizes.values())):  # what small languages leave, the others share
        each = max(LEAST, left // (len(sizes) - k))
        left -= min(n, each)
    rates = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, (1 << 40) if n <= each else int(each / n * (1 << 40)))))
    return docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) < rates[F.col("lang")])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(rows: list, langs: list[str], idf: np.ndarray, alpha=2.0, beta=1.0, l1=L1, l2=1e-4, epochs=4, seed=3) -> tuple[np.ndarray, float]:
    """(weights with the idf in them, temperature). Per-coordinate follow-the-regularised-leader with an elastic net."""
    at = {x: k for k, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    last = {rows[i][0]: i for i in order}  # a row of each language is trained on, however rare
    fifth = np.array([k < len(rows) // 5 and last[rows[i][0]] != i for k, i in enumerate(order)], bool)
    held, train = order[fifth], order[~fifth]
    z, n = np.zeros((len(idf), len(langs))), np.zeros((len(idf), len(langs)))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(train):
            lang, f, v = rows[i]
            x = v * idf[f]
            w = weights(z[f], n[f])
            p = softmax(x @ w)
            p[at[lang]] -= 1
            g = x[:, None] * p
            sq = n[f] + g * g
            z[f] += g - (np.sqrt(sq) - np.sqrt(n[f])) / alpha * w
            n[f] = sq
    w = weights(z, n)
    logits = np.array([(v * idf[f]) @ w[f] for _, f, v in (rows[i] for i in held)])
    y = np.array([at[rows[i][0]] for i in held])

    # targets are smoothed by one error in all held rows: without an error among them the likelihood alone has no best temperature
    smooth = 1 / (len(y) + 2)
    target = np.full((len(y), len(langs)), smooth / max(1, len(langs) - 1))
    target[np.arange(len(y)), y] = 1 - smooth

    def loss(t):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return (target * (np.log(np.exp(x).sum(axis=1, keepdims=True)) - x)).sum(axis=1).mean()

    heat = min(np.geomspace(1e-4, 100, 400), key=loss) if len(y) and len(langs) > 1 else 1.0
    return (w * idf[:, None]).astype(np.float32), float(heat)


class Model:
    """Languages, temperature, and the weights of the features that have any: a row number for each feature (0 for the others) and
    the rows, of which row 0 is zeros."""

    def __init__(self, langs: list[str], weights: np.ndarray, heat: float):
        used = np.flatnonzero(np.any(weights != 0, axis=1))
        self.langs, self.heat = langs, heat
        self.row = np.zeros(len(weights), np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.weights = np.vstack([np.zeros((1, len(langs)), np.float32), weights[used]])

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text):
            total += self.weights.take(self.row.take(g), axis=0).sum(axis=0, dtype=np.float64)
            n += len(g)
        p = softmax(total / n / self.heat)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(train: DataFrame, most: int = SAMPLE) -> Model:
    """A model from ``train`` (doc_id, text, lang); rows without a language or text are left out."""
    small_batches(train.sparkSession)
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = sparse_rows(sample_of_each(train, most))
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((WIDTH, 0), np.float32), 1.0)
    df, n = document_frequencies(train)
    return Model(langs, *learn(rows, langs, np.log((1 + n) / (1 + df)) + 1))


def identify(docs: DataFrame, train: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text), learnt from ``train`` (doc_id, text, lang).

    A null text and one without a letter give ``und`` with score 0; with nothing to learn from, every text does. Of languages that
    score the same the first by name is taken. Repeated rows stay repeated, an empty table gives an empty result, long texts are
    read in pieces, other columns are not read. Nothing is shuffled but the counters.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(train, most))  # WIDTH numbers and at most as many rows, whatever the corpus

    def run(batches):
        model = shared.value
        for b in blocks(batches):
            best, score = zip(*map(model, b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    small_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(run, schema_of(doc_id=docs.schema["doc_id"].dataType, lang_pred="string", score="double"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return identify(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
