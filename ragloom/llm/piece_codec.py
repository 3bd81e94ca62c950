"""Encoding and decoding with a merge-type piece model by a prefix table.

For every prefix of a span the table keeps the unique last token of that prefix's encoding. Candidates are the pieces that an
Aho-Corasick automaton finds ending there; one fits if it starts the span and encodes to itself, or if the pair of the last
token of the shorter prefix and the candidate encodes to just that pair. Ids are then read backwards from the end.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, small_batches, tokenizer_bytes
from .spans import TAIL, SpanCache, Uneven, parts_of

MARK = "▁"
_worker: dict = {}


class PieceCodec:
    def __init__(self, model: bytes, most: int = 600_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_id = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id_byte = {i: bytes([b]) for b, i in self.bytes_id.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.rank = {i: -sp.get_score(i) for i in plain}
        if any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece of this model goes over a word start")
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.text[i], (len(self.text[i]), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.size = list(map(len, self.text))
        self.shown = [str(i) for i in range(n)]
        self.raw = {str(i): self.id_byte.get(i) or t.replace(MARK, " ").encode() for i, t in enumerate(self.text)}
        self.stands = [i in self.id_byte or i in self.rank and self.merged(t) == [i] for i, t in enumerate(self.text)]
        apart = not any(t[k - 1].isalpha() and t[k] in TAIL for t in self.id for k in range(1, len(t)))
        self.cache = SpanCache(self._value, None, most, "{},{}".format if apart else None)

    def merged(self, s: str) -> list[int]:
        """The model's merges done one by one, for the strings of one or two pieces that the tests need."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return [self.id[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether the two pieces' text encodes to just the two."""
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        ok = self.pairs[a << 20 | b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return ok

    def encode_span(self, s: str) -> list[int]:
        """Ids of a string with marks for blanks. A character without a piece is spelt in bytes and joins with nothing."""
        n = len(s)
        last = [-1] * (n + 1)  # the last token of s[:i]; -1: a character without a piece
        seen = self.pairs.get
        for end, (size, i) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - size] if end > size else -1
            if before < 0:
                if self.stands[i]:
                    last[end] = i
            elif (ok := seen(before << 20 | i)) or ok is None and self.fits(before, i):
                last[end] = i
        ids: list[int] = []
        while n:
            i = last[n]
            if i < 0:
                ids.extend(self.bytes_id[b] for b in reversed(s[n - 1].encode()))
                n -= 1
            else:
                ids.append(i)
                n -= self.size[i]
        ids.reverse()
        return ids

    def _value(self, s: str) -> str:
        return ",".join([self.shown[i] for i in self.encode_span(s.replace(" ", MARK))])

    def ids_text(self, text: str | None) -> str:
        """Decimal ids joined by commas; the encoder puts a blank before a text that isn't empty."""
        if not text:
            return ""
        text = text.replace(MARK, " ")
        try:
            return ",".join([self.cache[x] for x in parts_of(text)])
        except Uneven:
            return ",".join([self.cache.span(s) for s in re.findall(" *[^ \n]+| *\n| +$", " " + text)])

    def decoded(self, ids: list[str]) -> bytes:
        """UTF-8 of the pieces with marks as blanks, without the blank that the encoder put first."""
        out = b"".join([self.raw[i] for i in ids])
        return out[1:] if ids and self.raw[ids[0]][:1] == b" " else out

    def row(self, text: str | None) -> tuple[int, str, str]:
        joined = self.ids_text(text)
        ids = joined.split(",") if joined else []
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.ids_text(text).split(",") if i]

    def decode(self, ids: list[int]) -> str:
        return self.decoded([self.shown[i] for i in ids]).decode("utf-8", "replace")


def codec(model: bytes) -> PieceCodec:
    if _worker.get("model") != model:
        _worker.update(model=model, codec=PieceCodec(model))
    return _worker["codec"]


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ids (array) of every text; null and empty texts have no ids; repeated rows stay repeated."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codec(model).encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def piece_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256. A map without a shuffle.

    Null texts count as empty, with no ids; other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in blocks(batches):
            c = codec(model)
            rows = [c.row(t) for t in b.column("text").to_pylist()]
            n, ids, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), tokenizer_bytes("piece_bpe_32k.model"))
