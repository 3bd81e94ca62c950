"""Stream memory of messages without a turn."""

from ragloom.operators import memory
from ragloom.streaming import sessions, state

ROWS = [(1, None, "user", "a"), (1, 2**60 + 1, "user", "b"), (1, 3, "system", None), (1, 4, "user", "c"), (None, 1, "user", "d"), (None, None, "user", "e"), (2, None, "user", None)]


def _same(spark, tmp_path, rows, keep):
    """Two batches, each with null turns, give what `memory.window` gives of all messages: null turns first, the others to the last digit."""
    source = str(tmp_path / "in")
    for k in range(2):
        spark.createDataFrame(rows[k::2], state.MESSAGES).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(state.MESSAGES).option("maxFilesPerTrigger", 1).parquet(source)
    got = sorted(((r.conv_id, m.turn, m.role, m.text) for r in keep(stream).collect() for m in r.messages), key=str)
    assert got == sorted(map(tuple, memory.window(spark.read.schema(state.MESSAGES).parquet(source), 3).select("conv_id", "turn", "role", "text").collect()), key=str)
    assert (1, 2**60 + 1, "user", "b") in got and (None, None, "user", "e") in got


def test_state(spark, tmp_path):
    _same(spark, tmp_path, ROWS, lambda m: state.latest(state.run_to_table(state.bounded_memory(m, 3), str(tmp_path / "mem")), "conv_id"))


def test_timed(spark, tmp_path):
    _same(spark, tmp_path, ROWS, lambda m: sessions.memory_table(m, 3, str(tmp_path / "mem"), 600_000))
