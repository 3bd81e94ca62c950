"""Approximate vector search over an inverted file.

Cells are learnt by spherical k-means from a bounded sample; every vector goes into the cell whose centre is nearest, and a cell knows
the largest angle of its vectors to the centre. A search reads, for each query, the cells nearest to it, as many as `build` has
found to hold TARGET of the true neighbours of a sample of vectors. The exact way then also reads each cell that by its radius
could hold a better vector than the k found.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources import files
from . import retrieval

#: Vectors of the sample for each cell, vectors searched for to choose the number of probes, and the share of neighbours they must find.
SAMPLE, TRIED, TARGET = 64, 128, 0.95
ROUNDS, SEED = 12, 5


@dataclass(frozen=True)
class Cells:
    """``table``: cell, key, embedding, a folder for each cell; unit ``centres``; ``counts`` and ``radii`` (angles) of the cells; how
    many cells a query reads, and the share of true neighbours these held for the vectors tried."""

    table: DataFrame
    key: str
    centres: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    probes: int = 0
    recall: float = 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def learn(x: np.ndarray, n: int) -> np.ndarray:
    """n unit centres (fewer for fewer vectors) of unit vectors; an empty cell starts anew at the vector that fits worst."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        near = x @ centres.T
        cell = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        for empty in np.flatnonzero(np.bincount(cell, minlength=len(centres)) == 0):
            worst = int(near.max(1).argmin())
            sums[empty], near[worst] = x[worst], 1
        centres = _unit(sums)
    return centres


def _sample(items: DataFrame, key: str, most: int, n: int, salt: int) -> DataFrame:
    share = int(min(1.0, most / max(1, n)) * (1 << 40))
    return items.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40)) < share)


def build(items: DataFrame, key: str = "child_id", dims: int = retrieval.DEFAULT.dims, cells: int | None = None, k: int = 20) -> Cells:
    """An index of ``items`` (key, embedding), written to the shared folder. ``cells``: by default the square root of the number of
    vectors. Null vectors, those of zeros and of other sizes are in no cell."""
    spark = items.sparkSession
    n = items.count()
    cells = cells or max(1, int(n**0.5))
    x, _ = retrieval._matrix(_sample(items, key, SAMPLE * cells, n, 1).select("embedding").toArrow()["embedding"], dims)
    x = _unit(x[(x * x).sum(1) > 0])
    centres = learn(x, cells) if len(x) else np.zeros((0, dims))
    shared = spark.sparkContext.broadcast(centres)
    schema = StructType([StructField("cell", LongType()), items.schema[key], items.schema["embedding"], *StructType.fromDDL("angle double").fields])

    def run(batches):
        for b in batches:
            x, _ = retrieval._matrix(b.column("embedding"), dims)
            use = np.flatnonzero((x * x).sum(1) > 0)
            if len(use) and len(shared.value):
                near = _unit(x[use]) @ shared.value.T
                at, pick = near.argmax(1), pa.array(use)
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(key).take(pick), b.column("embedding").take(pick), pa.array(np.arccos(np.clip(near.max(1), -1, 1)))], names=schema.names)

    path = f"{files.shared(spark)}/cells-{uuid.uuid4().hex}"
    dealt = items.select(key, "embedding").mapInArrow(run, schema)
    # by hash within the cell too, so that a cell of any size is written by several tasks
    dealt.repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).write.partitionBy("cell").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect():  # a row a cell
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    index = Cells(table.drop("angle"), key, centres, counts, radii)
    return _tuned(index, _sample(items, key, TRIED, n, 2), k, dims)


def _tuned(index: Cells, tried: DataFrame, k: int, dims: int) -> Cells:
    """The index with the least number of probes whose cells hold TARGET of the k nearest vectors of those tried."""
    queries = tried.select(F.monotonically_increasing_id().alias("query_id"), "embedding")
    queries = files.index(queries, "tried")
    near = retrieval.knn(queries, index.table, k, key=index.key, dims=dims).select("query_id", index.key)
    found = near.join(index.table.select(index.key, "cell"), index.key).select("query_id", "cell").toArrow()  # TRIED * k rows
    if not found.num_rows:
        return replace(index, probes=len(index.centres), recall=1.0)
    rows = queries.toArrow()
    x, _ = retrieval._matrix(rows["embedding"], dims)
    order = np.argsort(-(_unit(x) @ index.centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = {q: i for i, q in enumerate(rows["query_id"].to_pylist())}
    ranks = np.sort(place[[at[q] for q in found["query_id"].to_pylist()], found["cell"].to_numpy()])
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)]) + 1
    return replace(index, probes=probes, recall=float((ranks < probes).mean()))


def _read(index: Cells, vectors: np.ndarray, chosen: np.ndarray, k: int, min_score: float) -> DataFrame:
    """(q, key, score): the k best of every partition among the cells chosen (query x cell) for each of the unit ``vectors``."""
    table = index.table
    schema = StructType([StructField("q", LongType()), table.schema[index.key], *StructType.fromDDL("score double").fields])
    shared = table.sparkSession.sparkContext.broadcast((vectors, [np.flatnonzero(c) for c in chosen.T]))
    key, dims = index.key, vectors.shape[1]

    def run(batches):
        unit, asked = shared.value
        query, score, names, held = [], [], [], 0

        def reduced():
            q, s, name = np.concatenate(query), np.concatenate(score), pa.concat_arrays(names)
            best = retrieval.best_of(q, s, name.to_numpy(zero_copy_only=False), k)
            return [q[best]], [s[best]], [name.take(pa.array(best))], len(best)

        for b in batches:
            cell = b.column("cell").to_numpy()
            x, _ = retrieval._matrix(b.column("embedding"), dims)
            xn = np.sqrt((x * x).sum(1))
            for c in np.unique(cell).tolist():
                rows, own = np.flatnonzero(cell == c), asked[c]
                step = max(1, retrieval.SCORES // max(1, len(rows)))
                for lo in range(0, len(own), step):
                    qs = own[lo : lo + step]
                    s = (1 + (x[rows] @ unit[qs].T) / xn[rows, None]) / 2
                    s = np.floor(s * 1e6 + 0.5) / 1e6
                    least = np.partition(s, len(rows) - k, axis=0)[len(rows) - k] if len(rows) > k else -np.inf
                    i, j = np.nonzero((s >= least) & (s >= min_score))
                    query.append(qs[j])
                    score.append(s[i, j])
                    names.append(pc.take(b.column(key), pa.array(rows[i])))
                    held += len(i)
                    if held > max(1 << 18, 4 * k * len(unit)):
                        query, score, names, held = reduced()
        if names:
            query, score, names, held = reduced()
            yield pa.RecordBatch.from_arrays([pa.array(query[0].astype(np.int64)), names[0], pa.array(score[0])], names=schema.names)

    cells = np.flatnonzero(chosen.any(0)).tolist()  # as many as the index has cells
    return table.where(F.col("cell").isin(cells)).select("cell", key, "embedding").mapInArrow(run, schema)


def search(queries: DataFrame, index: Cells, k: int, min_score: float = 0.0, exact: bool = False, probes: int | None = None, report: Callable[[float], None] | None = None) -> DataFrame:
    """As `retrieval.knn`, from the cells nearest to each query; with ``exact`` the same rows as that gives. ``report`` is told the
    share of all (query, vector) pairs that were compared."""
    by = retrieval.keys_of(queries)
    spark, dims = queries.sparkSession, index.centres.shape[1]
    queries = files.index(queries.select(*by, "embedding"), "queries")
    passes = max(1, -(-queries.count() * (dims + len(index.centres)) * 8 // retrieval.QUERY_BYTES))
    found, compared, pairs = None, 0, 0
    for p in range(passes):
        part = (queries if passes == 1 else queries.where(F.pmod(F.xxhash64(*by), F.lit(passes)) == p)).toArrow()
        x, _ = retrieval._matrix(part["embedding"], dims)
        use = np.flatnonzero((x * x).sum(1) > 0)
        if not len(use) or not len(index.centres):
            continue
        unit = _unit(x[use])
        names = part.select(by).take(pa.array(use)).append_column("q", pa.array(np.arange(len(use))))
        names = spark.createDataFrame(names, StructType([*(queries.schema[c] for c in by), StructField("q", LongType())]))
        near = unit @ index.centres.T
        chosen = np.zeros(near.shape, bool)
        np.put_along_axis(chosen, np.argsort(-near, axis=1, kind="stable")[:, : probes or index.probes], True, 1)
        own = _read(index, unit, chosen, k, min_score)
        if exact:
            own = files.index(own, "probed")
            last = retrieval.top(own, k, index.key, ["q"]).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).toArrow()
            floor = np.full(len(use), min_score)
            full = last["n"].to_numpy() == k
            floor[last["q"].to_numpy()[full]] = last["least"].to_numpy()[full]
            best = (1 + np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - index.radii))) / 2
            rest = ~chosen & (best >= floor[:, None] - 2e-6) & (index.counts > 0)
            if rest.any():
                own = own.unionByName(_read(index, unit, rest, k, min_score))
            chosen |= rest
        compared, pairs = compared + int((chosen @ index.counts).sum()), pairs + len(use) * int(index.counts.sum())
        own = own.join(F.broadcast(names), "q").drop("q")  # a pass's queries
        found = own if found is None else found.unionByName(own)
    if report:
        report(compared / max(1, pairs))
    if found is None:
        found = spark.createDataFrame([], StructType([*(queries.schema[c] for c in by), index.table.schema[index.key], *StructType.fromDDL("score double").fields]))
    return retrieval.top(found, k, index.key, by).withColumn("retriever", F.lit("knn"))
