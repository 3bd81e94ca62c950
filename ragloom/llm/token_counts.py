"""Token counts by a map-side two-tier lookup.

Pass 1 finds the frequent pre-token spans: each partition counts its spans in a bounded table, the bounded tables (never the
spans of the rows) are merged in a tree, and the driver gets at most ``tiers`` small tables. Pass 2 looks every span of every
text up in the broadcast table of frequent spans' lengths; misses are encoded by the tokenizer library once per worker and
kept in a bounded worker cache. Rows are never shuffled.
"""

from __future__ import annotations

import base64
import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, small_batches, tokenizer_bytes
from .spans import SPECIAL, SpanCache, frequent_parts, trim, values

#: Entries of the broadcast table, and of each partition's summary.
FREQUENT, SUMMARY = 16_384, 4_096
#: The published pattern of this vocabulary's pre-tokens (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_worker: dict = {}


def frequent_spans(docs: DataFrame, text: str = "text", frequent: int = FREQUENT, tiers: int = 16) -> list[str]:
    """The spans that are frequent over all texts, most frequent first (lossy counting: a rare span may be missed)."""
    small_batches(docs.sparkSession)

    def summarise(batches):
        counts: Counter = Counter()
        for b in blocks(batches):
            frequent_parts(b.column("text").to_pylist(), counts, SUMMARY)
        trim(counts, SUMMARY)
        yield pa.RecordBatch.from_pydict({"counts": [json.dumps(counts)]}, schema=pa.schema([("counts", pa.string())]))

    def merge(batches):
        counts: Counter = Counter()
        for b in batches:
            for x in b.column("counts").to_pylist():
                counts.update(json.loads(x))
                trim(counts, 4 * frequent)
        trim(counts, frequent)
        yield pa.RecordBatch.from_pydict({"counts": [json.dumps(counts)]}, schema=pa.schema([("counts", pa.string())]))

    found = docs.select(F.col(text).alias("text")).mapInArrow(summarise, "counts string")
    total: Counter = Counter()
    for row in found.repartition(tiers).mapInArrow(merge, "counts string").toLocalIterator():
        total.update(json.loads(row[0]))
    clean = [(n, p) for p, n in total.items() if (body := p.removeprefix("\n")) and not body[0].isspace() and not body[-1].isspace()]
    return [p for _, p in sorted(clean, key=lambda x: (-x[0], x[1]))[:frequent]]


class ByteTokenizer:
    """Ids as the tokenizers library gives them. Spans of plain letters go to a quicker library with the same vocabulary."""

    def __init__(self, model: bytes, ranks: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.quick = tiktoken.Encoding("spans", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.whole = Tokenizer.from_str(model.decode())

    def ids(self, s: str) -> list[int]:
        return self.quick.encode_ordinary(s) if max(s) < "\u0250" else self.whole.encode(s, add_special_tokens=False).ids

    def length(self, s: str) -> int:
        return len(self.ids(s))


def byte_tokenizer_files(folder: str | None = None) -> tuple[bytes, bytes]:
    return tokenizer_bytes("byte_bpe_50k.json", folder), tokenizer_bytes("byte_bpe_50k.tiktoken", folder)


def lengths(model: tuple[bytes, bytes], spans: list[str]) -> dict[str, int]:
    tok = ByteTokenizer(*model)
    return {p: tok.length(p if p[0] == "\n" else " " + p) for p in spans}


def _cache(model: tuple[bytes, bytes], table: dict[str, int]) -> SpanCache:
    key = hash((model, frozenset(table.items())))
    if _worker.get("key") != key:
        _worker.update(key=key, cache=SpanCache(ByteTokenizer(*model).length, table))
    return _worker["cache"]


def count(cache: SpanCache, text: str | None) -> int:
    if not text:
        return 0
    pieces = text.split(SPECIAL) if SPECIAL in text else (text,)
    return sum(sum(values(cache, x)) for x in pieces) + len(pieces) - 1


def token_counts(docs: DataFrame, model: tuple[bytes, bytes], id_col: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens; a null id stays null; repeated rows give repeated rows; other columns are
    not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    table = spark.sparkContext.broadcast(lengths(model, frequent_spans(docs)))

    def run(batches):
        cache = None
        for b in blocks(batches):
            cache = cache or _cache(model, table.value)
            texts = b.column("text").to_pylist()
            n = [count(cache, t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), byte_tokenizer_files())
