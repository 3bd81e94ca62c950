"""Packing documents into windows by minimum bin slack.

Each document is cut into full windows and a remainder. Only the histogram of remainder lengths (at most ``window`` numbers)
goes to the driver. There a bitset subset-sum over the multiset of lengths left finds, with the largest length fixed as seed,
the fill closest to the window; the counts of each length are backtracked, and the pattern is repeated as often as the
histogram allows, so a plan has at most about as many patterns as there are lengths, whatever the corpus. Rows find their
place by their rank among equal lengths. Windows that stay short are closed up, so that a remainder may be cut at a window's
end, and the very last window is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import array
import sys
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, documents, materialise, small_batches
from .spans import SPECIAL, SpanCache, values
from .token_counts import ByteTokenizer, byte_tokenizer_files

WINDOW, END = 1024, 0
#: Groups in which ranks and running sums are taken.
GROUPS = 1024
#: Documents whose pieces are cut and that are looked up by broadcast; beyond it they are joined.
FEW = 10_000
_worker: dict = {}


def _packed(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _cache(model) -> SpanCache:
    key = hash(model)
    if _worker.get("key") != key:
        tok = ByteTokenizer(*model)
        _worker.update(key=key, cache=SpanCache(lambda s: _packed(tok.ids(s)), most=500_000), special=_packed([tok.whole.token_to_id(SPECIAL)]))
    return _worker["cache"]


def id_bytes(model, text: str | None) -> bytes:
    """Little-endian ids of a text and the end id."""
    cache = _cache(model)
    if not text:
        return _packed([END])
    if SPECIAL in text:
        return _worker["special"].join([b"".join(values(cache, x)) for x in text.split(SPECIAL)]) + _packed([END])
    return b"".join(values(cache, text)) + _packed([END])


def fill(counts: list[int], capacity: int) -> dict[int, int]:
    """How many of each length to take: the largest length left is one of them, and the sum is as close to capacity as any."""
    seed = max(n for n, c in enumerate(counts) if c)
    room = capacity - seed
    left = counts.copy()
    left[seed] -= 1
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in range(min(seed, room), 0, -1):
        c = min(left[n], room // n)
        k = 1
        while c:  # binary splitting of the count
            k = min(k, c)
            steps.append((n, k, bits))
            bits |= bits << n * k & mask
            c -= k
            k *= 2
        if bits >> room & 1:
            break
    at = bits.bit_length() - 1
    taken = {seed: 1}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] = taken.get(n, 0) + k
            at -= n * k
    return taken


def plan(histogram: dict[int, int], capacity: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """[(repeats, {length: count})] that uses up the histogram of lengths below the capacity."""
    counts = [histogram.get(n, 0) for n in range(capacity + 1)]
    out = []
    while any(counts):
        taken = fill(counts, capacity)
        times = min(counts[n] // c for n, c in taken.items())
        for n, c in taken.items():
            counts[n] -= times * c
        out.append((times, taken))
    return out


class Places:
    """rank among equal lengths -> position in the line of all remainders. Patterns that fill their window stand first, so
    only what slack is left moves later remainders over a window's end."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]], capacity: int):
        self.runs: dict[int, list] = {}
        self.starts: dict[int, list[int]] = {}
        first = 0
        for total, times, taken in sorted(((sum(n * c for n, c in taken.items()), times, taken) for times, taken in patterns), key=lambda x: x[0] != capacity):
            offset = 0
            for n, c in sorted(taken.items(), reverse=True):
                starts, runs = self.starts.setdefault(n, [0]), self.runs.setdefault(n, [])
                runs.append((starts[-1], c, first + offset, total))
                starts.append(starts[-1] + c * times)
                offset += n * c
            first += total * times
        self.total, self.capacity = first, capacity
        last = first // capacity * capacity
        self.tail = [last + x for x in power_cuts(first - last)] + [first]

    def __call__(self, length: int, rank: int) -> int:
        start, c, first, total = self.runs[length][bisect_right(self.starts[length], rank) - 1]
        return first + (rank - start) // c * total + (rank - start) % c * length

    def pieces(self, at: int, length: int):
        """(sequence, offset, length) of what lies at a position of the line; the short last window is cut at powers of two."""
        end = at + length
        while at < end:
            window = at // self.capacity
            if at < self.tail[0]:
                stop, seq, begin = min(end, (window + 1) * self.capacity), window, window * self.capacity
            else:
                k = bisect_right(self.tail, at) - 1
                stop, seq, begin = min(end, self.tail[k + 1]), window + k, self.tail[k]
            yield seq, at - begin, stop - at
            at = stop

    @property
    def sequences(self) -> int:
        return self.tail[0] // self.capacity + len(self.tail) - 1


def power_cuts(total: int) -> list[int]:
    """Starts of the powers of two that make up a total, largest first."""
    cuts, at = [], 0
    for b in range(total.bit_length() - 1, -1, -1):
        if total >> b & 1:
            cuts.append(at)
            at += 1 << b
    return cuts


def pack(docs: DataFrame, model, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Every input row is packed, repeated ones too; other columns are not read; an
    empty table gives an empty result. Sequence numbers: windows of remainders first, then the full windows of long documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("check"))

    def measure(batches):
        for b in blocks(batches):
            n, crcs = [], []
            for t in b.column("text").to_pylist():
                ids = id_bytes(model, t)
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("check"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "check", "n", "crcs"])

    measured = materialise(docs.mapInArrow(measure, f"doc_id {kind}, check long, n long, crcs array<long>"), "lengths").withColumn("grp", F.pmod("check", F.lit(GROUPS)).cast("int"))
    rest = (F.col("n") % window).cast("int").alias("rest")
    # ranks: within (length, group), then groups one after the other; both tables below are bounded by window * GROUPS
    by = measured.groupBy(rest, "grp").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    offsets = by.withColumns({"before": F.sum("rows").over(Window.partitionBy("rest").orderBy("grp")) - F.col("rows")})
    per_group = by.groupBy("grp").agg(F.sum("full").alias("full")).collect()  # GROUPS rows at most
    histogram = {r["rest"]: r["rows"] for r in by.where("rest > 0").groupBy("rest").agg(F.sum("rows").alias("rows")).collect()}
    places = Places(plan(histogram, window), window)
    base, run = {}, places.sequences
    for r in sorted(per_group, key=lambda r: r["grp"]):
        base[r["grp"]] = run
        run += r["full"]
    shared = spark.sparkContext.broadcast((places, base))
    order = ["doc_id", "check"]
    ranked = (
        measured.withColumn("rest", rest)
        .withColumns({"rank": F.row_number().over(Window.partitionBy("grp", "rest").orderBy(*order)) - 1, "ahead": F.sum(F.floor(F.col("n") / window)).over(Window.partitionBy("grp").orderBy(*order, "rest").rowsBetween(Window.unboundedPreceding, -1))})
        .join(offsets.select("grp", "rest", "before"), ["grp", "rest"])
        .select("doc_id", "check", "grp", "n", "crcs", (F.col("rank") + F.col("before")).alias("rank"), F.coalesce("ahead", F.lit(0)).cast("long").alias("ahead"))
    )
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, check long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "check"]

    def place(batches):
        """Pieces; the parts of a remainder that a cut goes through come without a CRC."""
        where, first = shared.value
        for b in batches:
            out = []
            for doc, check, grp, n, crcs, rank, ahead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "check", "grp", "n", "crcs", "rank", "ahead")), strict=True):
                full, tail = divmod(n, window)
                for k in range(full):
                    out.append((doc, k * window, window, crcs[k], n, first[grp] + ahead + k, 0, check))
                if tail:
                    start = full * window
                    for seq, offset, length in where.pieces(where(tail, rank), tail):
                        out.append((doc, start, length, crcs[full] if length == tail else None, n, seq, offset, check))
                        start += length
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 8, [b.schema.field("doc_id").type, *[pa.int64()] * 7], strict=True)], names=names)

    pieces = materialise(ranked.mapInArrow(place, schema), "pieces")
    whole, cut = pieces.where("ids_crc32 IS NOT NULL"), pieces.where("ids_crc32 IS NULL")
    few = cut.limit(FEW + 1).count()
    if not few:
        return whole.drop("check")

    def fix(batches):
        for b in blocks(batches):
            cols = {c: b.column(c).to_pylist() for c in ("text", "start", "length")}
            crc = []
            for t, s, m in zip(*cols.values(), strict=True):
                ids = id_bytes(model, t)
                crc.append(zlib.crc32(ids[4 * s : 4 * (s + m)]))
            yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if c == "ids_crc32" else b.column(c) for c in names], names=names)

    keys = cut.select("check").distinct()
    texts = docs.join(F.broadcast(keys) if few <= FEW else keys, "check", "left_semi").groupBy("check").agg(F.first("text", ignorenulls=True).alias("text"))
    return whole.unionByName(cut.join(texts, "check").mapInArrow(fix, schema)).drop("check")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), byte_tokenizer_files())
