"""Learned embeddings: latent vectors of hashed TF-IDF rows, by randomised range finding.

The Gram matrix of all rows is never built. The features of the texts are counted once and stored. A pass over them multiplies the Gram
matrix with a thin one: each task sums x (x Q) of its rows, a piece of rows as a dense block of the features that occur in it; the sums are added up slice by slice, and the driver orthogonalises FEATURES x (dims + EXTRA) numbers, whatever the corpus.
After ROUNDS passes Q spans the leading directions; a small eigenproblem turns it to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import buckets, tokens
from ..sources import files
from . import lexical

FEATURES, EXTRA, ROUNDS, SEED = 1 << 13, 16, 3, 11
#: Rows that are multiplied at once, and features of a slice of a sum.
ROWS, SLICE = 128, 1 << 10


def _counts(toks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each row, feature, count) of lists of tokens, one row after the other."""
    length = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64)
    terms = toks.flatten().dictionary_encode()
    of = buckets(terms.dictionary, FEATURES)[terms.indices.to_numpy()]
    pairs, tf = np.unique(np.repeat(np.arange(len(length)), length) * FEATURES + of, return_counts=True)
    row, feature = np.divmod(pairs, FEATURES)
    return np.bincount(row, minlength=len(length)), feature, tf


def _rows(n: np.ndarray, feature: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the features that occur, unit rows over these features); a row without features is zeros."""
    row = np.repeat(np.arange(len(n)), n)
    value = (1 + np.log(tf)) * idf[feature]
    norm = np.sqrt(np.bincount(row, value * value, len(n)))
    occurs = np.zeros(FEATURES, bool)
    occurs[feature] = True
    x = np.zeros((len(n), occurs.sum()))
    x[row, (np.cumsum(occurs) - 1)[feature]] = value / norm[row]
    return np.flatnonzero(occurs), x


def _pieces(toks: pa.Array):
    for lo in range(0, len(toks), ROWS):
        yield toks.slice(lo, ROWS)


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """features, counts: the hashed tokens of every text that has some."""
    toks = texts.select(tokens(text).alias("toks"))

    def run(batches):
        for b in (piece for whole in batches for piece in lexical.pieces(whole)):
            n, feature, tf = _counts(b.column("toks"))
            ends = pa.array(np.concatenate([[0], np.cumsum(n[n > 0])]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (feature, tf)], names=["features", "counts"])

    return toks.mapInArrow(run, "features array<int>, counts array<int>")


def _added(found: DataFrame, columns: int) -> np.ndarray:
    """The sum of the tasks' matrices of FEATURES rows, added up by slice before they come to the driver."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("values").to_pylist(), strict=True):
                x = np.frombuffer(x)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "values"])

    out = np.zeros((FEATURES, columns))
    for r in found.repartition(FEATURES // SLICE, "slice").sortWithinPartitions("slice", "values").mapInArrow(add, found.schema).toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["values"]).reshape(SLICE, columns)
    return out


def _sums(rows: DataFrame, columns: int, add) -> np.ndarray:
    """Adds up all `counted` rows by ``add``, a function of (the sum so far, features of each row, feature, count)."""

    def run(batches):
        total = np.zeros((FEATURES, columns))
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                features, counts = (b.column(c).slice(lo, ROWS) for c in ("features", "counts"))
                add(total, pc.list_value_length(features).to_numpy(), features.flatten().to_numpy(), counts.flatten().to_numpy())
        slices = total.reshape(-1, SLICE * columns)
        used = np.flatnonzero(slices.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([slices[i].tobytes() for i in used], pa.binary())], names=["slice", "values"])

    return _added(rows.mapInArrow(run, "slice int, values binary"), columns)


@dataclass(frozen=True)
class Latent:
    """``directions``: feature x dimension; ``idf``: of the features. ``embed`` goes where an embedder is asked for."""

    idf: np.ndarray
    directions: np.ndarray
    shared: Broadcast

    def embed(self, col: str | Column, dims: int) -> Column:
        """Vectors of texts, of zeros for a text without tokens; null for a null text."""
        if dims != self.directions.shape[1]:
            raise ValueError(f"the vectors have {self.directions.shape[1]} dimensions, not {dims}")
        shared = self.shared

        @F.arrow_udf("array<double>")
        def vectors(toks: pa.Array) -> pa.Array:
            idf, directions = shared.value
            x = [np.zeros((0, directions.shape[1]))]
            for piece in _pieces(toks):
                used, rows = _rows(*_counts(piece), idf)
                x.append(rows @ directions[used])
            x = np.round(np.concatenate(x), 6) + 0.0
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()), mask=toks.is_null())

        return vectors(tokens(col))


def fit(texts: DataFrame, dims: int = 64, text: str = "text") -> Latent:
    """Vectors learnt from all rows of ``texts``; the same for any partitioning, up to rounding. A corpus with fewer directions than
    ``dims`` gets zeros in the rest."""
    rows = files.index(counted(texts, text), "counted")

    def seen(total, n, feature, tf):
        total[:, 0] += np.bincount(feature, minlength=FEATURES)

    df = _sums(rows, 1, seen)[:, 0]
    idf = np.log((1 + rows.count()) / (1 + df)) + 1
    width = dims + EXTRA
    q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(FEATURES, width)) * (df > 0)[:, None])[0]
    spark = texts.sparkSession
    for turn in range(ROUNDS + 1):
        sent = spark.sparkContext.broadcast((idf, q))  # FEATURES x width numbers

        def gram(total, n, feature, tf, sent=sent):
            idf, q = sent.value
            used, x = _rows(n, feature, tf, idf)
            total[used] += x.T @ (x @ q[used])

        y = _sums(rows, width, gram)
        if turn < ROUNDS:
            q = np.linalg.qr(y)[0]
    values, turn_to = np.linalg.eigh(q.T @ y)
    v = q @ turn_to[:, ::-1][:, :dims]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(dims)] < 0, -1, 1)  # signs are arbitrary: the largest part is positive
    v[:, values[::-1][:dims] < 1e-9 * max(values[-1], 1e-300)] = 0
    v = np.round(v, 9)
    return Latent(idf, v, spark.sparkContext.broadcast((idf, v)))
