"""Tasks hold bounded pieces of texts that are cut into tokens once."""

import pyarrow as pa
from pyspark.sql import functions as F

from ragloom.functions.text import tokens
from ragloom.operators import lexical, retrieval


def test_pieces_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TOKENS", 10)
    toks = [["a"] * 4, None, [], ["b"] * 7, ["c"] * 30, ["d"], ["e"] * 9]
    cut = [p.column("toks").to_pylist() for p in lexical.pieces(pa.RecordBatch.from_pydict({"toks": pa.array(toks, pa.list_(pa.string()))}))]
    assert sum(cut, []) == toks and all(sum(len(t or []) for t in p) <= 10 or len(p) == 1 for p in cut)
    rows = [(1, "b a B"), (2, None), (3, "..."), (4, "a")]
    found = retrieval.postings(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()
    assert sorted(map(tuple, found)) == [(1, "a", 1, 3), (1, "b", 2, 3), (4, "a", 1, 1)]


def test_han_characters_are_tokens_of_their_own(spark):
    df = spark.createDataFrame([("中文abc中1２é x_y 〇鿽",), (None,), ("",)], "text string")
    old = F.regexp_extract_all(F.regexp_replace(F.lower("text"), r"([\x{4e00}-\x{9fff}])", " $1 "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    assert df.where(~tokens("text").eqNullSafe(old)).count() == 0
    assert df.select(tokens("text")).first()[0][:4] == ["中", "文", "abc", "中"]
