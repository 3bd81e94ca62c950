"""Streaming forms: memory bounded to the last n messages of a conversation, and incremental ingest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources import snapshots

MESSAGES = "conv_id long, turn long, role string, text string"
KEPT = "messages array<struct<turn: bigint, role: string, text: string>>"


def read_messages(spark: SparkSession, path: str, glob: str = "conversations.parquet") -> DataFrame:
    return read_table(spark, path, glob, MESSAGES)


def read_table(spark: SparkSession, path: str, name: str, schema: StructType | str) -> DataFrame:
    """A stored table as a stream: the part files of the folder ``name`` in ``path``, or the files in ``path`` that match ``name``."""
    rows = spark.readStream.schema(schema)
    fs, at = snapshots.at(spark, f"{path}/{name}")
    if fs.exists(at) and fs.getFileStatus(at).isDirectory():
        return rows.parquet(f"{path}/{name}")
    return rows.option("pathGlobFilter", name).parquet(path)


def bounded(messages: list[tuple], n: int) -> list[tuple]:
    """Of (turn, role, text) messages the latest system one and the last n - 1 others, or the last n without one, in order; those of a
    null turn are the oldest."""
    messages = sorted(messages, key=_place)
    system = [m for m in messages if m[1] == "system"][-1:]
    others = [m for m in messages if m[1] != "system"]
    room = n - len(system)
    return sorted(system + (others[-room:] if room > 0 else []), key=_place)


def _place(message: tuple) -> tuple:
    """Messages without a turn come before all others."""
    return message[0] is not None, message[0] or 0


def coded(messages: DataFrame) -> DataFrame:
    """Null turns as 0 and marked in ``no_turn``: a null among numbers would have pandas make all of them floats."""
    return messages.withColumns({"turn": F.coalesce("turn", F.lit(0)), "no_turn": F.col("turn").isNull()})


def decoded(pdf: pd.DataFrame) -> list[tuple]:
    """(turn, role, text) of rows of `coded` messages."""
    rows = pdf[["turn", "no_turn", "role", "text"]].itertuples(index=False, name=None)
    return [(None if null else int(t), None if pd.isna(r) else r, None if pd.isna(x) else x) for t, null, r, x in rows]


def bounded_memory(messages: DataFrame, n: int) -> DataFrame:
    """After each batch, (conv_id, seen, messages kept) of the conversations it touched; the state holds n messages a conversation.
    `memory.window` of all messages so far gives the same."""

    def update(key, batches, state: GroupState):
        seen, kept = state.get if state.exists else (0, [])
        kept = [tuple(m) for m in kept]
        for pdf in batches:
            seen += len(pdf)
            kept = bounded(kept + decoded(pdf), n)
        state.update((seen, kept))
        yield pd.DataFrame({"conv_id": [key[0]], "seen": [seen], "messages": [[dict(zip(("turn", "role", "text"), m, strict=True)) for m in kept]]})

    return coded(messages).groupBy("conv_id").applyInPandasWithState(update, f"conv_id long, seen long, {KEPT}", f"seen long, {KEPT}", "update", GroupStateTimeout.NoTimeout)


def run_to_table(df: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """All that is there now, written batch by batch to a table in a shared folder; ``epoch`` is a row's batch."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/epoch={epoch}")  # the same batch again overwrites itself

    df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema.add("epoch", "long")).option("basePath", f"{path}/table").parquet(f"{path}/table")


def latest(updates: DataFrame, key: str) -> DataFrame:
    """The last row of each key of a table of updates."""
    row = F.max_by(F.struct(*(c for c in updates.columns if c not in (key, "epoch"))), "epoch").alias("row")
    return updates.groupBy(key).agg(row).select(key, "row.*")


def ingest(docs: DataFrame, pipeline, path: str) -> DataFrame:
    """Incremental ingest: each micro-batch of documents goes through ``pipeline`` and is added to the table, which is returned. What was
    ingested before is not read again by a later call with the same path."""
    spark = docs.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{path}/table/epoch={epoch}")

    docs.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table").drop("epoch")


def feed(docs: DataFrame, base, path: str) -> None:
    """Incremental ingest into a knowledge base (`operators.segments.Base`): each micro-batch of new documents becomes a segment, once,
    also if the batch is run again after a failure; segments merge as they add up."""

    def each(batch: DataFrame, epoch: int) -> None:
        if base.append(batch, (path, epoch)):
            while base.merge():
                pass

    docs.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
