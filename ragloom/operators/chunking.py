"""Documents to parent chunks to child chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import DEFAULT, Config
from ..functions.split import CHARS, TOKENS, chunks


def split(docs: DataFrame, most: int, overlap: int, measure: str = "chars") -> DataFrame:
    """One row per chunk of ``text``: the other columns, ordinal and text. ``measure``: chars or tokens (words). A text is cut in one
    pass; null and blank ones give no chunk."""
    m = {"chars": CHARS, "tokens": TOKENS}[measure]
    others = [c for c in docs.columns if c != "text"]
    schema = StructType([*(docs.schema[c] for c in others), StructField("ordinal", IntegerType()), StructField("text", StringType())])

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.names.index("text"))
            for lo in range(0, b.num_rows, ROWS):
                cut = [chunks(t, most, overlap, m) if t else [] for t in texts.slice(lo, ROWS).to_pylist()]
                n = np.array([len(c) for c in cut])
                row = pa.array(lo + np.repeat(np.arange(len(n)), n))
                ordinal = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                columns = [b.column(i).take(row) for i, c in enumerate(b.schema.names) if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ordinal.astype(np.int32)), pa.array([x for c in cut for x in c], pa.string())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in [*others, "text"])).mapInArrow(run, schema)


#: Texts that a task cuts before it hands on their chunks.
ROWS = 256


def parents(docs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """parent_id (doc_id#ordinal), ordinal, text, doc_id, source, and metadata if ``docs`` has such a map of strings. Null and empty
    texts give no chunk."""
    own = [c for c in ("metadata",) if c in docs.columns]
    cut = split(docs.select("doc_id", "source", "text", *own), cfg.parent_chars, cfg.parent_overlap)
    return cut.select(F.concat_ws("#", "doc_id", "ordinal").alias("parent_id"), "ordinal", "text", "doc_id", "source", *own)


def children(parents: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """child_id, parent_id, doc_id, ordinal, text, metadata: all of the parent's, with source, parentId and docId set over it."""
    own = F.create_map(F.lit("source"), F.col("source").cast("string"), F.lit("parentId"), F.col("parent_id"), F.lit("docId"), F.col("doc_id").cast("string"))
    if "metadata" in parents.columns:
        rest = F.map_filter("metadata", lambda k, v: ~k.isin("source", "parentId", "docId"))
        own = F.map_concat(F.coalesce(rest, F.create_map().cast("map<string,string>")), own)
    cut = split(parents.select("parent_id", "doc_id", own.alias("metadata"), "text"), cfg.child_chars, cfg.child_overlap)
    return cut.select(F.concat_ws("#", "parent_id", "ordinal").alias("child_id"), "parent_id", "doc_id", "ordinal", "text", "metadata")


def stats(docs: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """(key, value): documents, parents, children."""
    count = lambda df, key: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(key).alias("key"), "value")
    return count(docs, "documents").unionByName(count(parents, "parents")).unionByName(count(children, "children"))
