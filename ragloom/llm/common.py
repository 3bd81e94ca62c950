"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows that one Arrow batch carries to a Python worker; long texts make larger batches too big for small executors.
ARROW_ROWS = 1000
#: Bytes that an Arrow batch carries, but for a longer row, and bytes of text that Python code holds at once.
BLOCK_BYTES = 4 << 20
TOKENIZER_DIR = "/opt/tokenizers"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_bytes(name: str, folder: str | None = None) -> bytes:
    """The vocabulary file itself, read on the driver and sent with the closure: executors need no copy on their disks."""
    with open(os.path.join(folder or os.environ.get("TOKENIZER_DIR", TOKENIZER_DIR), name), "rb") as f:
        return f.read()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset (tests) a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="ragloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors, gives the planner true sizes."""
    return Scratch(df.sparkSession).table(df, tag)


class Scratch:
    """Intermediate tables of one operator in the shared folder. ``drop`` deletes those that nothing left to run reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.paths[tag] = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags or [*self.paths]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(tag))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))


def schema_of(**columns: str | DataType) -> StructType:
    """A schema by column; types as DDL text or as they are, so that fields of any name can be in them."""
    return StructType([StructField(n, DataType.fromDDL(t) if isinstance(t, str) else t) for n, t in columns.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attached(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each value of ``on`` (null is one); neither side is broadcast.

    A key may hold any share of ``rows``: a row has a slot, a hash of the columns ``by``, and the table's row goes to those pairs of
    key and slot that there are. A key's rows so meet it in up to four tasks a partition. ``rows`` is read twice.
    """
    same = lambda a, b, cols: [a[c].eqNullSafe(b[f"_{c}"]) for c in cols]
    renamed = lambda df, cols: df.withColumnsRenamed({c: f"_{c}" for c in cols})
    rows = rows.withColumn("slot_", F.pmod(F.xxhash64(*by), F.lit(4 * partitions(rows.sparkSession))))
    keys, table = rows.select(*on, "slot_").distinct(), renamed(table, on)
    placed = keys.join(table.hint("merge"), same(keys, table, on)).drop(*(f"_{c}" for c in on))
    placed = renamed(placed, [*on, "slot_"])
    return rows.join(placed.hint("merge"), same(rows, placed, [*on, "slot_"]), how).drop("slot_", *(f"_{c}" for c in [*on, "slot_"]))


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def crc_mod(column: str, m: int):
    """crc32 of an id as text, modulo m: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m
