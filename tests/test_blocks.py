"""Rows and row groups of the index stay small, however many and long the chunks are."""

import glob
import random

import pyarrow.parquet as pq

from ragloom.operators import lexical
from ragloom.sources import files


def test_blocks_and_row_groups_are_bounded(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(200_000 if i == 7 else rng.randrange(0, 6_000)))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    index = lexical.build(docs, "doc_id", lambda df, name: files.written(df, f"{tmp_path}/{name}"))
    sizes = [(len(r["lengths"]), sum(r["lengths"])) for r in index.blocks.select("lengths").collect()]
    assert sum(n for n, _ in sizes) == sum(1 for _, t in rows if t) and max(n for n, _ in sizes) <= lexical.BLOCK
    assert sorted(t for _, t in sizes)[-2] <= lexical.TOKENS and max(t for _, t in sizes) == 200_000
    groups = [m.row_group(i) for p in glob.glob(f"{tmp_path}/postings/*.parquet") for m in [pq.ParquetFile(p).metadata] for i in range(m.num_row_groups)]
    assert len(groups) > 1 and max(sum(g.column(c).num_values for c in range(g.num_columns)) for g in groups) < 5_000_000  # what a reader holds at once
