"""Two retrievers over chunks, in the long format query_id, variant, retriever, rank, child_id, score.

Queries are rows of query_id and, if they come in several wordings, variant; every wording has ranked lists of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import DEFAULT, Config
from ..functions.text import hash_embedding, tokens
from ..sources import files
from . import lexical

HIT = ["query_id", "variant", "retriever", "rank", "child_id", "score"]
#: Bytes of query vectors that are broadcast at once; more queries go in several passes over the items.
QUERY_BYTES = 16 << 20
#: Scores that a task holds at once.
SCORES = 1 << 22


def keys_of(queries: DataFrame) -> list[str]:
    return [c for c in ("query_id", "variant") if c in queries.columns]


def postings(children: DataFrame, key: str = "child_id") -> DataFrame:
    """key, term, tf, length of the chunk in tokens; ``key`` names a row. Terms are counted where their chunk lies, without a
    shuffle, a run of chunks after the other. Written once and reused, queries read only their terms."""
    toks = children.select(key, tokens("text").alias("toks"))
    schema = StructType([toks.schema[key], *StructType.fromDDL("term string, tf long, length int").fields])

    def run(batches):
        for b in (piece for whole in batches for piece in lexical.pieces(whole)):
            length = pc.fill_null(pc.list_value_length(b.column("toks")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = b.column("toks").flatten().dictionary_encode()
            seen, tf = np.unique(np.repeat(np.arange(len(length)), length) * len(terms.dictionary) + terms.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(seen, max(1, len(terms.dictionary)))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), terms.dictionary.take(pa.array(term)), pa.array(tf), pa.array(length[row].astype(np.int32))], names=schema.names)

    return toks.mapInArrow(run, schema)


def bm25(queries: DataFrame, children: DataFrame, cfg: Config = DEFAULT, k: int | None = None, key: str = "child_id", posted: lexical.Lexical | None = None) -> DataFrame:
    """Top k chunks a query. Without a stored index one is written first, so that the chunks are cut into tokens once."""
    by, k = keys_of(queries), k or cfg.per_retriever
    posted = lexical.build(children, key) if posted is None else posted
    return top(lexical.search(queries, posted, by, key, k, cfg), k, key, by).withColumn("retriever", F.lit("bm25"))


def feedback_terms(queries: DataFrame, first: DataFrame, items: DataFrame, posted: lexical.Lexical, cfg: Config = DEFAULT, key: str = "child_id") -> DataFrame:
    """(query, term, weight): the query's terms, and those that mark the best ``cfg.feedback_chunks`` chunks of its ``first`` list, up to
    ``cfg.feedback_terms`` with weights of ``cfg.feedback_weight`` and less.

    A term weighs its share of each chunk times its inverse frequency, summed over the chunks by their scores.
    """
    by = keys_of(queries)
    own = queries.select(*by, F.explode(F.array_distinct(tokens("text"))).alias("term"))
    best = first.where(F.col("rank") <= cfg.feedback_chunks).select(*by, key, "score")
    share = F.col("score") / F.sum("score").over(Window.partitionBy(*by))
    texts = items.select(key, "text").join(files.few(best.select(key).distinct(), "feedback-chunks"), key, "left_semi")
    texts = files.index(texts, "feedback-texts").select(key, tokens("text").alias("toks"))  # else Spark cuts all texts to look for tokens
    said = best.withColumn("share", share).join(texts, key).select(*by, F.explode("toks").alias("term"), (F.col("share") / F.size("toks")).alias("part"))
    said = said.groupBy(*by, "term").agg(F.sum("part").alias("part")).join(own, [*by, "term"], "left_anti").join(posted.terms, "term")
    w = F.round(F.col("part") * F.log1p((F.lit(posted.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 9)
    said = said.withColumn("w", w).where("w > 0").withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("w"), "term")))
    said = said.withColumn("most", F.max("w").over(Window.partitionBy(*by))).where(F.col("n") <= cfg.feedback_terms)
    return own.withColumn("weight", F.lit(1.0)).unionByName(said.select(*by, "term", (F.col("w") / F.col("most") * cfg.feedback_weight).alias("weight")))


def bm25_feedback(queries: DataFrame, items: DataFrame, cfg: Config = DEFAULT, k: int | None = None, key: str = "child_id", posted: lexical.Lexical | None = None, first: DataFrame | None = None) -> DataFrame:
    """`bm25` twice: the second time the question is widened by the terms of what the first found (`feedback_terms`). ``first``: what it
    found, if that is stored already."""
    by, k = keys_of(queries), k or cfg.per_retriever
    posted = lexical.build(items, key) if posted is None else posted
    first = files.index(bm25(queries, items, cfg, max(k, cfg.feedback_chunks), key, posted), "first") if first is None else first
    terms = feedback_terms(queries, first, items, posted, cfg, key)
    return top(lexical.weighted(terms, posted, by, key, k, cfg), k, key, by).withColumn("retriever", F.lit("bm25"))


def top(scored: DataFrame, k: int, key: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def embed(df: DataFrame, cfg: Config = DEFAULT, embedder=hash_embedding) -> DataFrame:
    """``embedder``: (column, dims) -> column of arrays, for an embedding model."""
    return df.withColumn("embedding", embedder("text", cfg.dims))


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows, which rows have one): null vectors and those of other sizes are zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    x = np.zeros((len(fits), dims))
    x[fits] = pc.fill_null(column.filter(pa.array(fits)).flatten().cast(pa.float64()), 0.0).to_numpy().reshape(-1, dims)
    return x, fits


def best_of(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of each query, ties by key."""
    _, name = np.unique(key, return_inverse=True)
    order = np.lexsort((name, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
    return order[nth < k]


def _nearest(vectors: np.ndarray, items: DataFrame, k: int, min_score: float, key: str) -> DataFrame:
    """(q, key, score): the k best of every partition for each row of ``vectors``, by matrix products over Arrow batches."""
    schema = StructType([StructField("q", LongType()), items.schema[key], *StructType.fromDDL("score double").fields])
    norms = np.sqrt((vectors * vectors).sum(1))
    shared = items.sparkSession.sparkContext.broadcast((vectors.T.copy(), norms))  # QUERY_BYTES at most, or one query

    def run(batches):
        turned, qn = shared.value
        rows = max(1, SCORES // max(1, len(qn)))
        query, score, name = np.zeros(0, np.int64), np.zeros(0), None
        floor = np.full(len(qn), -np.inf)  # the k-th best so far
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                x, _ = _matrix(b.column("embedding"), len(turned))
                xn = np.sqrt((x * x).sum(1))
                use = np.flatnonzero(xn > 0)
                if not len(use):
                    continue
                xn, dot = xn[use], x[use] @ turned
                # few pairs are near the k best so far; what rounding may add is left room, and only these pairs are scored
                found = np.nonzero(dot > xn[:, None] * (qn * (2 * np.maximum(floor, min_score) - 1 - 4e-6))) if np.isfinite(floor).all() else None
                if found is None or len(found[0]) > 4 * k * len(qn):
                    cosine = dot / (qn * xn[:, None])
                    least = (1 + np.partition(cosine, len(use) - k, axis=0)[len(use) - k]) / 2 if len(use) > k else -np.inf
                    found = np.nonzero(cosine > 2 * np.maximum(np.maximum(least, floor), min_score) - 1 - 4e-6)
                i, j = found
                s = (1 + dot[i, j] / (qn[j] * xn[i])) / 2
                s = np.floor(s * 1e6 + 0.5) / 1e6  # rounded before it is ranked, so that ties are ties in every engine
                good = (s >= floor[j]) & (s >= min_score)
                i, j, s = i[good], j[good], s[good]
                own = pc.take(b.column(key), pa.array(use[i]))
                query, score = np.concatenate([query, j]), np.concatenate([score, s])
                name = own if name is None else pa.concat_arrays([name, own])
                best = best_of(query, score, name.to_numpy(zero_copy_only=False), k) if len(query) else query
                query, score, name = query[best], score[best], name.take(pa.array(best))
                full = np.bincount(query, minlength=len(qn)) == k
                lowest = np.full(len(qn), np.inf)
                np.minimum.at(lowest, query, score)
                floor = np.where(full, lowest, floor)
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array(query), name, pa.array(score)], names=schema.names)

    return items.select(key, "embedding").mapInArrow(run, schema)


def knn(queries: DataFrame, items: DataFrame, k: int, min_score: float = 0.0, key: str = "child_id", dims: int = DEFAULT.dims) -> DataFrame:
    """Exact cosine search, score (1 + cosine) / 2. Null vectors, those of another size and vectors of zeros match nothing.

    The vectors of the queries are one matrix, which goes to all tasks while it has QUERY_BYTES at most; more queries are dealt into
    blocks, each with a pass of its own over the items. A task hands on k rows a query.
    """
    spark, by = queries.sparkSession, keys_of(queries)
    blocks = max(1, -(-queries.count() * dims * 8 // QUERY_BYTES))
    found = None
    for i in range(blocks):
        part = queries.select(*by, "embedding")
        part = (part if blocks == 1 else part.where(F.pmod(F.xxhash64(*by), F.lit(blocks)) == i)).toArrow()
        vectors, _ = _matrix(part["embedding"], dims)
        use = np.flatnonzero((vectors * vectors).sum(1) > 0)
        names = part.select(by).take(pa.array(use)).append_column("q", pa.array(np.arange(len(use))))
        names = spark.createDataFrame(names, StructType([*(queries.schema[c] for c in by), StructField("q", LongType())]))
        scored = _nearest(vectors[use], items, k, min_score, key).join(F.broadcast(names), "q").drop("q")  # a block's queries
        found = scored if found is None else found.unionByName(scored)
    return top(found, k, key, by).withColumn("retriever", F.lit("knn"))


def long_words(text: str):
    """Stand-in for an expansion model: the words of five characters or more as a second wording."""
    return F.array(F.array_join(F.filter(tokens(text), lambda t: F.length(t) > 4), " "))


def expand(questions: DataFrame, cfg: Config = DEFAULT, expander=long_words) -> DataFrame:
    """query_id, variant, text: the question as asked (variant 0) and up to ``cfg.variants`` - 1 texts of ``expander``, a function
    from a column's name to an array of texts; null and blank ones are left out."""
    texts = F.array("text")
    if cfg.variants > 1:
        more = F.filter(F.coalesce(expander("text"), F.array().cast("array<string>")), lambda t: F.length(F.trim(t)) > 0)
        texts = F.concat(texts, F.slice(more, 1, cfg.variants - 1))
    return questions.select("query_id", F.posexplode(texts).alias("variant", "text"))
