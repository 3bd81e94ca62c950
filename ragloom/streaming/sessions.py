"""Conversation memory as stream state that ends: a list of messages per conversation, and a timer that drops it when nothing more comes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import KEPT, bounded, coded, decoded

OUT = f"conv_id long, seen long, {KEPT}, ended boolean"
#: Lists and timers need this state store; with timers a stream that ends would wait for them in empty batches for ever.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class _Memory(StatefulProcessor):
    """State: the last messages, how many there were, and one timer."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "turn long, role string, text string")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, seen = list(self.kept.get()), self.seen.get()[0] if self.seen.exists() else 0
        for pdf in rows:
            seen += len(pdf)
            kept = bounded([tuple(m) for m in kept] + decoded(pdf), self.n)
        self.kept.put(kept)
        self.seen.update((seen,))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, seen, kept, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        self.kept.clear()
        self.seen.clear()
        yield self._row(key, seen, [], True)

    @staticmethod
    def _row(key, seen: int, kept: list[tuple], ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "seen": [seen], "messages": [[dict(zip(("turn", "role", "text"), m, strict=True)) for m in kept]], "ended": [ended]})

    def close(self) -> None:
        pass


def timed_memory(messages: DataFrame, n: int, idle_ms: int | None = None) -> DataFrame:
    """After each batch, (conv_id, seen, messages, ended) of the conversations it touched: `memory.window` of all messages so far. A
    conversation to which nothing came for ``idle_ms`` of processing time is given out once more, without messages and ended, in
    the first batch after that; a later message begins it anew. Messages of a null conversation are one conversation's."""
    return coded(messages).groupBy("conv_id").transformWithStateInPandas(_Memory(n, idle_ms), OUT, "Update", "None" if idle_ms is None else "ProcessingTime")


@contextmanager
def settings(spark: SparkSession):
    """SETTINGS for queries that are started meanwhile; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def memory_table(messages: DataFrame, n: int, path: str, idle_ms: int | None = None) -> DataFrame:
    """Runs `timed_memory` over all that is there now; returns the current messages (conv_id, seen, messages) of the conversations that
    haven't ended. A later call with the same path goes on from there."""
    from .state import latest, run_to_table

    with settings(messages.sparkSession):
        updates = run_to_table(timed_memory(messages, n, idle_ms), path)
    return latest(updates, "conv_id").where(~F.col("ended")).drop("ended")
