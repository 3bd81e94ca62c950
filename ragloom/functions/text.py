"""Column expressions over text: tokens, hash embedding, templates."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = "[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+"
#: Unicode white space but for no-break spaces, spelt so that Java and RE2 agree.
BLANK = r"^[\x09-\x0d\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]*$"
TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


def tokens(col: str | Column) -> Column:
    """Lower-cased runs of letters and digits; each Han character is a token of its own."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+|[\p{L}\p{N}&&[\x{4e00}-\x{9fff}]]"), F.lit(0))


def bucket(token: str, dims: int) -> int:
    """The dimension a token counts in: the first 32 bits of its MD5 modulo ``dims``."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dims


#: Terms whose hashes a worker remembers; beyond them it begins anew.
REMEMBERED = 200_000
_hashes: dict[str, int] = {}


def buckets(terms: pa.Array, dims: int) -> np.ndarray:
    """`bucket` of each of the terms. Batches share most of their words, so a worker hashes a term once, not once a batch."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    found = []
    for t in terms.to_pylist():
        h = _hashes.get(t)
        if h is None:
            h = _hashes[t] = bucket(t, 1 << 32)
        found.append(h)
    return np.array(found, np.int64) % dims


def hash_embedding(col: str | Column, dims: int = 64) -> Column:
    """Counts of hashed tokens, a stand-in for an embedding model that every engine can compute. Batches of token lists are
    counted at once; a null text has a null vector."""

    @F.arrow_udf("array<double>")
    def count(toks: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64)
        terms = toks.flatten().dictionary_encode()
        of = buckets(terms.dictionary, dims)
        at = np.repeat(np.arange(len(length)), length) * dims + of[terms.indices.to_numpy()]
        values = np.bincount(at, minlength=len(length) * dims).astype(np.float64)
        offsets = pa.array(np.arange(len(length) + 1) * dims, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(values), mask=toks.is_null())

    return count(tokens(col))


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, TRIM, "")


def render(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` holes filled in order."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value.cast("string"))
    return out


def conversation_id(uuid: Column) -> Column:
    """First six hex digits modulo a million (many to one)."""
    return F.conv(F.substring(F.regexp_replace(uuid, "-", ""), 1, 6), 16, 10).cast("long") % 1_000_000


def get_or(counts: Column, key: str, default: int = 0) -> Column:
    """A count of a map, or the default for a key it hasn't."""
    return F.coalesce(F.try_element_at(counts, F.lit(key)), F.lit(default))


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts as one, counts of a key in both added up."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
