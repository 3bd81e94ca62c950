"""Conversation memory as a table: bounded windows, whole-list replace, delete, JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MESSAGE = "array<struct<turn: bigint, role: string, text: string>>"


def window(messages: DataFrame, n: int, key: str = "conv_id") -> DataFrame:
    """The latest system row and the last n - 1 others, or the last n rows without one."""
    system = F.col("role") == "system"
    w = Window.partitionBy(key, system).orderBy(F.desc("turn"))
    has = F.max(system.cast("int")).over(Window.partitionBy(key))
    ranked = messages.withColumns({"_rn": F.row_number().over(w), "_has": has})
    return ranked.where(F.when(system, F.col("_rn") == 1).otherwise(F.col("_rn") <= n - F.col("_has"))).drop("_rn", "_has")


def to_json(messages: DataFrame) -> DataFrame:
    """conv_id and all of its messages, in turn order, as one JSON text."""
    return messages.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("content"))


def from_json(blobs: DataFrame) -> DataFrame:
    return blobs.select("conv_id", F.inline(F.from_json("content", MESSAGE)))


def upsert(store: DataFrame, new: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each conversation in ``new`` replaces the stored one as a whole. Write the result to another path than it is read from."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(store: DataFrame, ids: DataFrame, key: str = "conv_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def get(store: DataFrame, conv_id) -> DataFrame:
    """Messages of one conversation in order; no rows, never null, for an unknown one."""
    return store.where(F.col("conv_id") == conv_id).orderBy("turn")


def shared_window(messages: DataFrame, n: int, *order: str) -> DataFrame:
    """`window` of one memory that all messages share, in the order of the columns ``order``: two top-k queries, so that no task
    sorts all rows."""
    down = [F.desc(c) for c in order]
    system = F.col("role") == "system"
    last = messages.where(system).orderBy(*down).limit(1)
    others = messages.where(~system | F.col("role").isNull()).orderBy(*down).limit(n)
    few = others.withColumn("_system", F.lit(0)).unionByName(last.withColumn("_system", F.lit(1)))  # n + 1 rows at most
    nth = F.row_number().over(Window.orderBy(F.desc("_system"), *down))
    return few.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n", "_system")


def suffix(parts: DataFrame, whole: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds ``delta``: what the text ``whole`` has beyond that of the row before it, as a client shows a growing answer."""
    before = F.coalesce(F.length(F.lag(whole).over(Window.partitionBy(key).orderBy(order))), F.lit(0))
    return parts.withColumn("delta", F.substring(F.col(whole), before + 1, F.length(whole)))
