"""Exact deduplication by a tree-merge of sorted digest runs.

Rows are dealt to ``2**rounds`` slots. Each slot first makes a run: its distinct digests, sorted, each with its smallest rank
(the largest id ranks first) and its count. In round r the slots that differ in bit r of their number exchange halves of their
runs: afterwards each holds only digests whose bit r equals its own, merged from both, so no slot ever gathers the whole
corpus. After the last round a slot holds its share of the digest space merged from all rows. ``fan`` rounds are taken in one
step, as a multiway merge of ``2**fan`` runs: they are read in digest order and equal neighbours become one entry, a batch at a
time. Keys are (SHA-256, byte length, 64-bit hash): two texts merge only if all three agree, at every level. The survivors go
back down to the runs that hold them, one entry for each slot and digest, so a text that a third of all rows share is spread
over all slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, partitions

KEY = ["digest", "n_bytes", "check"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    norm = normalised(F.col(text))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("t")).select("doc_id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("check"))


def _bits(n: int) -> Column:
    """The first n bits of the digest as a number."""
    return F.shiftright(F.conv(F.hex(F.substring(F.col("digest"), 1, 4)), 16, 10).cast("long"), 32 - n) if n else F.lit(0).cast("long")


def _folded(t: pa.Table) -> pa.Table:
    """Equal neighbours of a sorted table as one row: the first, which has the largest id, with the sum of the sizes."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = False
        for c in ["slot", *KEY]:
            new[1:] |= pa.compute.not_equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)).to_numpy()
    at = np.flatnonzero(new)
    sizes = np.add.reduceat(t["size"].to_numpy(), at)
    i = t.schema.get_field_index("size")
    return t.take(pa.array(at)).set_column(i, t.schema.field(i), pa.array(sizes))


def merge(runs: DataFrame) -> DataFrame:
    """(slot, digest, keep, size) rows -> one sorted run for each slot, each digest in it once."""
    names = ["slot", *KEY, "keep", "size"]
    dealt = runs.select(*names).repartition(max(partitions(runs.sparkSession), 1), "slot").sortWithinPartitions("slot", *KEY, F.desc_nulls_last("keep"))

    def run(batches):
        held = None  # the last entry, which may go on in the next batch
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                t = _folded(pa.concat_tables([held, t]) if held is not None else t)
                held = t.slice(t.num_rows - 1)
                yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def merge_runs(runs: DataFrame, rounds: int, fan: int = 3) -> DataFrame:
    """Runs of 2**rounds slots -> the survivors, each digest once."""
    done = 0
    while done < rounds:
        done += min(fan, rounds - done)
        group = F.shiftleft(F.shiftright("slot", done), done)  # the slots that have exchanged so far are one group ...
        owner = group.bitwiseOR(_bits(done).cast("int"))  # ... in which each owns a range of digests
        runs = merge(runs.withColumn("slot", owner))
    return runs.select(*KEY, "keep", "size")


def _rounds(spark: SparkSession) -> int:
    """Some four slots for each partition, so that partitions get about as many slots each."""
    return min(17, max(3, (4 * partitions(spark) - 1).bit_length()))


def _rows(docs: DataFrame, id_col: str, text: str, rounds: int) -> DataFrame:
    rows = digests(docs, id_col, text)
    return rows.withColumns({"slot": F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << rounds)).cast("int"), "keep": F.col("doc_id"), "size": F.lit(1).cast("long")})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    Null and empty texts are equal. Of rows that repeat an id as well as the text all carry kept = true; a null id never stays
    while its group has another. Long texts are hashed where they lie. Other columns are not read, so their names don't matter;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rounds = rounds or _rounds(spark)
    tmp, out = Scratch(spark), Scratch(spark)
    rows = out.table(_rows(docs, id_col, text, rounds), "digests")
    runs = tmp.table(merge(rows), "runs")
    best = tmp.table(merge_runs(runs, rounds), "survivors")
    entries = out.table(runs.select("slot", *KEY).join(best, KEY), "entries")
    tmp.drop()
    found = rows.drop("keep", "size").join(entries, ["slot", *KEY])
    return found.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """The rows that stay, one for each text, with all their columns, whatever these are called. Judged as by `exact_groups`.

    The digest that a survivor won by is not computed again: its row is the one of that id, byte length and 64-bit hash.
    """
    rounds = rounds or _rounds(docs.sparkSession)
    best = merge_runs(merge(_rows(docs, id_col, text, rounds)), rounds).select("keep", "n_bytes", "check")
    best = Scratch(docs.sparkSession).table(best, "survivors")
    norm = normalised(F.col(text))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.octet_length(norm).cast("long").alias("n_bytes"), F.xxhash64(norm).alias("check"))
    w, b = whole.alias("w"), best.alias("b")
    same = F.col("w.doc_id").eqNullSafe(F.col("b.keep")) & (F.col("w.n_bytes") == F.col("b.n_bytes")) & (F.col("w.check") == F.col("b.check"))
    # the key holds the id, so a frequent text is no hot key
    return w.join(b, same, "left_semi").groupBy("doc_id", "n_bytes", "check").agg(F.first("row").alias("row")).select("row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP9_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
