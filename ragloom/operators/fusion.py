"""Reciprocal-rank fusion, parent expansion, reranking and the ways back when a step has nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import tokens
from ..sources import files


def rrf(hits: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """query_id, text, score, child_id, parent_id: sums of 1 / (k + rank) by text over all lists of a question, one for each variant
    and retriever; the first list's chunk stands for a text."""
    hits = hits if "variant" in hits.columns else hits.withColumn("variant", F.lit(0))
    first = F.min(F.struct("variant", "retriever", "rank", "child_id", "parent_id")).alias("first")
    out = hits.groupBy("query_id", "text").agg(F.round(F.sum(F.lit(1.0) / (cfg.rrf_k + F.col("rank"))), 10).alias("score"), first)
    return out.select("query_id", "text", "score", "first.child_id", "first.parent_id")


def top_children(fused: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "child_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.top_children)


def expand_parents(best: DataFrame, parents: DataFrame) -> DataFrame:
    """query_id, parent_id, position, text, doc_id, source: parents once each, at their best child's rank; ids that are null or
    have no row are left out."""
    ids = files.few(best.where("parent_id IS NOT NULL").groupBy("query_id", "parent_id").agg(F.min("rank").alias("position")), "found-ids")
    return parents.select("parent_id", "text", "doc_id", "source").join(ids, "parent_id")


def overlap_score(question: str, text: str) -> Column:
    """Stand-in for a cross-encoder: Jaccard similarity of the token sets."""
    a, b = F.array_distinct(tokens(question)), F.array_distinct(tokens(text))
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.round(F.size(F.array_intersect(a, b)) / n, 6)).otherwise(0.0)


def rerank(found: DataFrame, questions: DataFrame, cfg: Config = DEFAULT, scorer=overlap_score) -> DataFrame:
    """Top parents by ``scorer`` (question column, text column) of the original question, ties in fused order.

    Equal segments (text, document, source) count once, at their first place and with their last score. A parent without a score
    is left out. If reranking is off, or the scorer gave no score at all for a question, its parents stay in fused order.
    """
    order, score = [F.asc("position"), F.asc("parent_id")], F.lit(None).cast("double")
    if cfg.rerank:
        found = found.join(questions.select("query_id", F.col("text").alias("question")), "query_id").withColumn("score", scorer("question", "text"))
        same = Window.partitionBy("query_id", "text", "doc_id", "source").orderBy("position", "parent_id")
        last = F.last("score", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        found = found.withColumns({"_n": F.row_number().over(same), "_scored": F.max(F.col("score").isNotNull()).over(Window.partitionBy("query_id")), "score": last})
        found = found.where(~F.col("_scored") | (F.col("_n") == 1) & F.col("score").isNotNull()).drop("_n", "_scored")
        score, order = F.col("score"), [F.desc("score"), *order]
    found = found.withColumn("score", score)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= cfg.top_parents)
    return found.select("query_id", "rank", "parent_id", "doc_id", "source", "text", "score")


def augment(best: DataFrame, parents: DataFrame, questions: DataFrame, cfg: Config = DEFAULT, scorer=overlap_score) -> DataFrame:
    """query_id, rank, chunk_id, text, score, kind: reranked parents, or all fused children of a query without any parent."""
    found = files.index(expand_parents(best, parents), "found")  # read twice
    full = rerank(found, questions, cfg, scorer).select("query_id", "rank", F.col("parent_id").alias("chunk_id"), "text", "score", F.lit("parent").alias("kind"))
    alone = best.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return full.unionByName(alone.select("query_id", "rank", F.col("child_id").alias("chunk_id"), "text", F.lit(None).cast("double").alias("score"), F.lit("child").alias("kind")))


NO_MATCH = "知识库中未检索到相关信息，请基于自身知识回答并提示用户信息可能不准确"  # fixed value


def search_text(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and the hits as one text, in rank order, with their sources; a fixed sentence if there are none."""
    item = F.concat(F.lit("[来源："), F.coalesce(F.col("doc_id").cast("string"), F.lit("未知")), F.lit("]\n"), F.col("text"))
    joined = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]), "\n\n---\n\n").alias("found"))
    return questions.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce("found", F.lit(NO_MATCH)).alias("answer"))


INJECT = "\n\nAnswer using the following information:\n"  # fixed value


def inject(questions: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, prompt: the question, followed by the texts found for it in rank order; alone if there are none."""
    ctx = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("ctx"))
    q = questions.select("query_id", "text").join(ctx, "query_id", "left")
    return q.select("query_id", F.when(F.col("ctx").isNull(), F.col("text")).otherwise(F.concat("text", F.lit(INJECT), "ctx")).alias("prompt"))
