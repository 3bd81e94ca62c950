"""BM25 over postings that are laid out by ranges of chunks.

A row of the index is a block of up to BLOCK chunks and TOKENS tokens with all of their postings, term by term, and for each term
the largest count and the smallest length among them. A search sends the terms of its questions to the blocks: a task multiplies
questions x terms by terms x chunks, block after block, and hands on k rows a question. The bounds of a block say which questions
can't get a better chunk from it than those the task has; these are left out. Statistics (chunks, tokens, chunks with a term) are
tables of their own, which add up over several indexes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..config import DEFAULT, Config
from ..functions.text import tokens
from ..sources import files

#: Chunks of a block at most, and tokens of its chunks (but for a longer one), so that long chunks make no larger rows.
BLOCK, TOKENS = 512, 1 << 17
#: Places of dead chunks that go to all tasks.
DEAD = 2_000_000
#: Bytes of questions' terms that go to the tasks at once; more questions take several passes over the blocks.
QUERY_BYTES = 16 << 20
#: (question, chunk) scores that a task holds at once, and found rows it holds before it keeps the best.
SCORES, HELD = 1 << 22, 1 << 16
ARRAYS = {"lengths": "array<int>", "terms": "array<string>", "starts": "array<int>", "chunks": "array<int>", "counts": "array<int>", "most": "array<int>", "least": "array<int>"}


def _lists(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of up to BLOCK rows and TOKENS tokens (``toks``); a row of more is a run of its own."""
    total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("toks")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    end = 0
    while end < batch.num_rows:
        at, before = end, total[end - 1] if end else 0
        end = min(at + BLOCK, max(at + 1, int(np.searchsorted(total, before + TOKENS, "right"))))
        yield batch.slice(at, end - at)


def blocks_of(children: DataFrame, key: str) -> DataFrame:
    """block (its first chunk's key), keys, lengths (in tokens), terms, starts (of each term's postings), chunks (their places in the
    block), counts, most, least. Chunks without tokens are in no block."""
    toks = children.select(key, tokens("text").alias("toks"))  # a filter on them would have Spark cut the texts twice
    kind = toks.schema[key].dataType
    schema = StructType([StructField("block", kind), StructField("keys", ArrayType(kind)), *StructType.fromDDL(", ".join(f"{c} {t}" for c, t in ARRAYS.items())).fields])

    def one(x, dtype=None):
        return pa.array([x], pa.list_(dtype)) if dtype else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                b = b.filter(pc.greater(pc.list_value_length(b.column("toks")), 0))
                if not b.num_rows:
                    continue
                length = pc.list_value_length(b.column("toks")).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = b.column("toks").flatten().dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                pairs, n = np.unique(rank[coded.indices.to_numpy()] * b.num_rows + np.repeat(np.arange(b.num_rows), length), return_counts=True)
                term, chunk = np.divmod(pairs, b.num_rows)
                starts = np.searchsorted(term, np.arange(len(order) + 1))
                ints = {"starts": starts, "chunks": chunk, "counts": n, "most": np.maximum.reduceat(n, starts[:-1]), "least": np.minimum.reduceat(length[chunk], starts[:-1])}
                cols = {"lengths": one(length.astype(np.int32), pa.int32()), "terms": one(coded.dictionary.take(pa.array(order)))} | {c: one(x.astype(np.int32), pa.int32()) for c, x in ints.items()}
                yield pa.RecordBatch.from_arrays([b.column(key).slice(0, 1), one(b.column(key)), *(cols[c] for c in ARRAYS)], names=schema.names)

    return toks.mapInArrow(run, schema)


def frequencies(blocks: DataFrame, dead: bool = False) -> DataFrame:
    """term, df, over all chunks of the blocks or over those whose places are in ``dead``."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                starts = _lists(b.column("starts"), i)
                n = np.diff(starts)
                if dead:
                    gone = np.isin(_lists(b.column("chunks"), i), _lists(b.column("dead"), i))
                    n = np.add.reduceat(gone.astype(np.int64), starts[:-1])
                terms = b.column("terms")[i].values
                yield pa.RecordBatch.from_arrays([terms.filter(pa.array(n > 0)), pa.array(n[n > 0].astype(np.int64))], names=["term", "df"])

    cols = ["terms", "starts", *(["chunks", "dead"] if dead else [])]
    return blocks.select(*cols).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass(frozen=True)
class Lexical:
    """Blocks, statistics by term (term, df) and in all; ``dead`` (block, dead): places of chunks that are no longer there, which
    the statistics don't count."""

    blocks: DataFrame
    terms: DataFrame
    docs: int
    tokens: int
    dead: DataFrame | None = None

    def plus(self, other: Lexical) -> Lexical:
        terms = self.terms.unionByName(other.terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        dead = [x.dead for x in (self, other) if x.dead is not None]
        return Lexical(self.blocks.unionByName(other.blocks), terms, self.docs + other.docs, self.tokens + other.tokens, dead[0].unionByName(dead[1]) if len(dead) == 2 else dead[0] if dead else None)


def build(children: DataFrame, key: str = "child_id", write: Callable[[DataFrame, str], DataFrame] = files.index) -> Lexical:
    """The index of chunks (``key``, text), written by ``write``. Texts are cut into tokens once."""
    blocks = write(blocks_of(children, key), "postings")
    total = blocks.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0]
    return Lexical(blocks, write(frequencies(blocks), "terms"), children.count(), total or 0)


def without(index: Lexical, keys: DataFrame, key: str, n: int, write: Callable[[DataFrame, str], DataFrame] = files.index) -> Lexical:
    """The index without the chunks of ``keys`` (``n`` of them, tokens or not); no text is read."""
    named = index.blocks.select("block", F.posexplode(F.arrays_zip("keys", "lengths")).alias("place", "x")).select("block", "place", F.col("x.keys").alias(key), "x.lengths")
    gone = named.join(keys.select(key).distinct(), key, "left_semi")
    if index.dead is not None:  # what has gone before isn't counted again
        gone = gone.join(index.dead.select("block", F.explode("dead").alias("place")), ["block", "place"], "left_anti")
    dead = write(gone.groupBy("block").agg(F.collect_list("place").alias("dead"), F.sum("lengths").alias("tokens")), "dead")  # BLOCK at most
    less = frequencies(index.blocks.join(_sent(dead.select("block", "dead")), "block"), True).select("term", (-F.col("df")).alias("df"))
    terms = write(index.terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), "terms")
    both = dead.select("block", "dead") if index.dead is None else index.dead.unionByName(dead.select("block", "dead"))
    return replace(index, terms=terms, docs=index.docs - n, tokens=index.tokens - (dead.agg(F.sum("tokens")).first()[0] or 0), dead=both)


def _sent(dead: DataFrame) -> DataFrame:
    """``dead`` as it is joined with the blocks: up to DEAD places go to all tasks, so that the blocks aren't shuffled."""
    n = dead.agg(F.sum(F.size("dead"))).first()[0] or 0
    return F.broadcast(dead) if n <= DEAD else dead


def _blocks(index: Lexical) -> DataFrame:
    if index.dead is None:
        return index.blocks.withColumn("dead", F.lit(None).cast("array<int>"))
    dead = files.index(index.dead.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("dead"))).alias("dead")), "all-dead")
    return index.blocks.join(_sent(dead), "block", "left")


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .., one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(start - (ends - n), n)


def _best(blocks: DataFrame, terms: pa.Table, nq: int, mean: float, docs: int, k: int, cfg: Config) -> DataFrame:
    """(q, key, score): the k best of every partition for each of ``nq`` questions; terms: q, term, df, weight."""
    from .retrieval import best_of

    coded = terms["term"].combine_chunks().dictionary_encode()
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    df = np.zeros(len(coded.dictionary))
    df[coded.indices.to_numpy()] = terms["df"].to_numpy()
    idf = np.log1p((docs - df + 0.5) / (df + 0.5))
    asked = terms["q"].to_numpy()[order]  # questions of each term, one term after the other
    first = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(df) + 1))
    weights = terms["weight"].to_numpy()[order]
    shared = blocks.sparkSession.sparkContext.broadcast((coded.dictionary, idf, asked, weights, first))  # QUERY_BYTES and the terms
    schema = StructType([StructField("q", LongType()), StructField("key", blocks.schema["keys"].dataType.elementType), *StructType.fromDDL("score double").fields])
    k1, b_ = cfg.bm25_k1, cfg.bm25_b

    def weight(n, length):
        return n * (k1 + 1) / (n + k1 * (1 - b_ + b_ * length / mean))

    def run(batches):
        vocabulary, idf, asked, boost, first = shared.value
        query, score, names = [], [], []
        floor = np.zeros(nq)  # the k-th best so far
        held = 0

        def reduced():
            q, s, name = np.concatenate(query), np.concatenate(score), pa.concat_arrays(names)
            best = best_of(q, s, name.to_numpy(zero_copy_only=False), k)
            q, s = q[best], s[best]
            full = np.bincount(q, minlength=nq) == k
            lowest = np.full(nq, np.inf)
            np.minimum.at(lowest, q, s)
            return q, s, name.take(pa.array(best)), np.where(full, lowest, 0.0)

        for batch in batches:
            for i in range(batch.num_rows):
                keys, lengths = batch.column("keys")[i].values, _lists(batch.column("lengths"), i)
                here = pc.fill_null(pc.index_in(batch.column("terms")[i].values, value_set=vocabulary), -1).to_numpy()
                use = np.flatnonzero(here >= 0)
                if not len(use):
                    continue
                term = here[use]
                n_asked = first[term + 1] - first[term]
                most = idf[term] * weight(_lists(batch.column("most"), i)[use], _lists(batch.column("least"), i)[use])
                at = _spans(first[term], n_asked)
                of, pair_boost = asked[at], boost[at]
                bound = np.bincount(of, np.repeat(most, n_asked) * pair_boost, nq)
                alive = (bound > 0) & (bound >= floor - 1e-6)
                live = np.flatnonzero(alive)
                number = np.cumsum(alive) - 1
                starts = _lists(batch.column("starts"), i)
                pair_term, pair_q = np.repeat(np.arange(len(use)), n_asked)[alive[of]], number[of[alive[of]]]
                pair_idf = idf[term][pair_term] * pair_boost[alive[of]]
                size = (starts[use + 1] - starts[use])[pair_term]
                at = _spans(starts[use][pair_term], size)
                chunk = _lists(batch.column("chunks"), i)
                value = weight(_lists(batch.column("counts"), i), lengths[chunk])
                dead = batch.column("dead")[i].values
                step = max(1, SCORES // len(lengths))
                for lo in range(0, len(live), step):
                    own = np.ones(len(at), bool) if len(live) <= step else np.repeat((pair_q >= lo) & (pair_q < lo + step), size)
                    m = min(step, len(live) - lo)
                    s = np.bincount((np.repeat(pair_q, size)[own] - lo) * len(lengths) + chunk[at[own]], np.repeat(pair_idf, size)[own] * value[at[own]], m * len(lengths)).reshape(m, -1)
                    if dead is not None:
                        s[:, dead.to_numpy()] = 0
                    least = floor[live[lo : lo + m]]
                    fresh = np.flatnonzero(least == 0)  # questions with less than k chunks so far
                    if len(fresh) and s.shape[1] > k:
                        least[fresh] = np.partition(s[fresh], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    qi, ci = np.nonzero(s > np.maximum(least - 2e-6, 0)[:, None])
                    if len(qi) > 4 * k * m and s.shape[1] > k:
                        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                        qi, ci = np.nonzero(s > np.maximum(least - 2e-6, 0)[:, None])
                    query.append(live[lo + qi])
                    score.append(np.floor(s[qi, ci] * 1e6 + 0.5) / 1e6)  # rounded before it is ranked, so that ties are ties in every engine
                    names.append(keys.take(pa.array(ci)))
                    held += len(qi)
                if held > max(HELD, 4 * k * nq) or floor.max() == 0 and held:
                    q, s, name, floor = reduced()
                    query, score, names, held = [q], [s], [name], 0
        if names:
            q, s, name, _ = reduced()
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), name, pa.array(s)], names=schema.names)

    return blocks.select("keys", *ARRAYS, "dead").mapInArrow(run, schema)


def search(queries: DataFrame, index: Lexical, by: list[str], key: str, k: int, cfg: Config = DEFAULT) -> DataFrame:
    """(*by, key, score) of the k best chunks of every task. Questions without a term of the index have no rows."""
    terms = queries.select(*by, F.explode(F.array_distinct(tokens("text"))).alias("term"), F.lit(1.0).alias("weight"))
    return weighted(terms, index, by, key, k, cfg)


def weighted(terms: DataFrame, index: Lexical, by: list[str], key: str, k: int, cfg: Config = DEFAULT) -> DataFrame:
    """`search` for questions that are given as terms with weights (*by, term, weight), each term once, weights above 0."""
    spark = terms.sparkSession
    schema = StructType([*(terms.schema[c] for c in by), StructField("key", index.blocks.schema["keys"].dataType.elementType), *StructType.fromDDL("score double").fields])
    terms = files.index(terms.join(index.terms, "term"), "asked-terms")
    passes = max(1, -(-terms.count() * 40 // QUERY_BYTES))
    mean, blocks, found = index.tokens / max(1, index.docs), _blocks(index), None
    for i in range(passes):
        part = (terms if passes == 1 else terms.where(F.pmod(F.xxhash64(*by), F.lit(passes)) == i)).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        seen, at, of = np.unique(np.array([str(x) for x in part.select(by).to_pylist()]), return_index=True, return_inverse=True)
        names = part.select(by).take(pa.array(at)).append_column("q", pa.array(np.arange(len(seen))))
        names = spark.createDataFrame(names, StructType([*(terms.schema[c] for c in by), StructField("q", LongType())]))
        own = _best(blocks, part.append_column("q", pa.array(of)), len(seen), mean, index.docs, k, cfg).join(F.broadcast(names), "q").drop("q")  # a pass's questions
        found = own if found is None else found.unionByName(own)
    found = spark.createDataFrame([], schema) if found is None else found.select(*schema.names)
    return found.withColumnRenamed("key", key)
