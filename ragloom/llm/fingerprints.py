"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever it hits the block size's trigger; each chunk gives one of 64
symbols of the signature. A fingerprint is ``block:signature:signature at twice the block``; block sizes are 3 * 2**k, the
largest that gives a signature of 32 symbols or more, from a first guess by length. Fingerprints are compared at the block
sizes they have in common, by edit distance of the signatures.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, materialise, partitions, small_batches

SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
SMALLEST, LONGEST, ROLL, COMMON = 3, 64, 7, 4
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_tables: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_tables.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _tables[base] = np.multiply.accumulate(p)
    return _tables[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprint(text: str | None) -> str:
    """Null counts as empty, whose fingerprint is ``3::``."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    x = data.astype(np.uint32)
    roll = x.copy()
    for k in range(1, ROLL):  # the byte k places back, turned by its place
        roll[k:] += x[: max(0, n - k)] * np.uint32((31**k) & 0xFFFFFFFF)
    roll = ((roll * np.uint32(0x9E3779B1)) ^ (roll >> np.uint32(15))) * np.uint32(0x85EBCA77)
    roll ^= roll >> np.uint32(13)
    guess = SMALLEST
    while guess * LONGEST < n:
        guess *= 2
    marks = np.flatnonzero(roll % np.uint32(SMALLEST) == SMALLEST - 1)
    hit = roll[marks] // np.uint32(SMALLEST)  # ends at block 3 * 2**k: also the last k bits of the rest are 0
    weighted = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(pow(_BASE, -1, 1 << 64), n), dtype=np.uint64)

    def signature(block: int) -> str:
        k = (block // SMALLEST).bit_length() - 1
        ends = marks[(hit & np.uint32((1 << k) - 1)) == 0]
        ends = ends[: LONGEST - 1]
        ends = np.append(ends, n - 1) if not len(ends) or ends[-1] != n - 1 else ends
        sums = np.diff(weighted[ends], prepend=np.uint64(0)) * _power(_BASE, n)[ends]  # the same wherever a chunk stands
        return SYMBOLS[(_mix(sums) >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    block = guess
    while True:
        first = signature(block)
        if len(first) >= LONGEST // 2 or block == SMALLEST:
            return f"{block}:{first}:{signature(2 * block)}"
        block //= 2


def distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time in the bits of a number."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pos, neg, d = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | neg
        h = ((eq & pos) + pos ^ pos) | eq
        hp = neg | ~(h | pos) & full
        hn = pos & h
        if hp & top:
            d += 1
        elif hn & top:
            d -= 1
        hp = hp << 1 | 1
        pos = (hn << 1 | ~(x | hp) & full) & full
        neg = hp & x & full
    return d


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    size = min(COMMON, len(a), len(b))
    if not size or not {a[i : i + size] for i in range(len(a) - size + 1)} & {b[i : i + size] for i in range(len(b) - size + 1)}:
        return 0.0  # no run of chunks in common: what else agrees is chance
    return 1.0 - distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where no block size is in common."""
    if a == b:
        return 1.0
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_alike(a1, b1), _alike(a2, b2) if min(len(a2), len(b2)) >= 8 else 0.0)
    return _alike(a2, b1) if 2 * p == q else _alike(a1, b2) if p == 2 * q else 0.0


def edited(text: str, other: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "


def _row(doc, text: str, mark: str, after: str, after_mark: str) -> tuple:
    changed = edited(text, after)
    changed_mark = fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, after_mark)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text against its edited form and against the next text in descending id order (after the last: the first).

    One row per input row. Null texts count as empty, a null id comes last, rows with equal ids follow each other by a hash of
    their text, a single document follows itself, an empty table gives an empty result. Texts are shuffled once, into ranges of
    ids; in each range the rows but the last see their neighbour, and the last rows, one per range, meet the first rows of the
    ranges behind them in a small join.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = docs.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("rng"))
    names = [*_COLUMNS, "role", "rng", "text"]

    def run(batches):
        before = None  # the row that waits for its neighbour
        types = None
        for b in blocks(batches):
            types = types or [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]
            out = []
            for doc, t, rng in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("rng").to_pylist(), strict=True):
                mark = fingerprint(t)
                if before is None:
                    out.append((doc, None, None, mark, None, None, None, "head", rng, t))
                else:
                    out.append((*_row(*before[:3], t, mark), None, None, None))
                before = doc, t, mark, rng
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if before is not None:
            doc, t, mark, rng = before
            last = (doc, None, None, mark, None, None, None, "last", rng, t)
            yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip(last, types, strict=True)], names=names)

    seen = materialise(dealt.mapInArrow(run, f"doc_id {kind}, {_SCHEMA} role string, rng int, text string"), "neighbours")
    ends = seen.where("role IS NOT NULL")
    ranges = sorted(r[0] for r in ends.where("role = 'head'").select("rng").collect())  # one number for each partition
    done = seen.where("role IS NULL").select(*_COLUMNS)
    if not ranges:
        return done
    follow = spark.createDataFrame([(r, ranges[(i + 1) % len(ranges)]) for i, r in enumerate(ranges)], "rng int, nxt int")
    heads = ends.where("role = 'head'").select(F.col("rng").alias("nxt"), F.col("text").alias("after"), F.col("fingerprint").alias("after_mark"))
    last = ends.where("role = 'last'").select("doc_id", "text", "fingerprint", "rng").join(follow, "rng").join(heads, "nxt")

    def close(batches):
        for b in blocks(batches):
            rows = [_row(*x) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "after", "after_mark")), strict=True)]
            types = [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], names=_COLUMNS)

    return done.unionByName(last.mapInArrow(close, f"doc_id {kind}, {_SCHEMA.rstrip(', ')}"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fingerprint of every text; a map without a shuffle."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t) for t in b.column("text").to_pylist()])], names=["doc_id", "fingerprint"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
