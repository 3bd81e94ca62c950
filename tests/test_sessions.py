"""Stream memory with timers: over batches and restarts, and when a conversation ends."""

import time

from ragloom.streaming import sessions, state


def test_memory_goes_on_after_a_restart_and_ends(spark, tmp_path):
    rows = [(c, t, "system" if t in (0, 5) else "user", f"{c}-{t}") for c in range(3) for t in range(4 + 3 * c)]
    source, path = str(tmp_path / "in"), str(tmp_path / "mem")

    def add(rows):
        spark.createDataFrame(rows, state.MESSAGES).coalesce(1).write.mode("append").parquet(source)

    def run(idle_ms=600_000):
        stream = spark.readStream.schema(state.MESSAGES).option("maxFilesPerTrigger", 1).parquet(source)
        return {r.conv_id: (r.seen, [tuple(m) for m in r.messages]) for r in sessions.memory_table(stream, 4, path, idle_ms).collect()}

    def want(rows):
        return {c: (sum(r[0] == c for r in rows), state.bounded([r[1:] for r in rows if r[0] == c], 4)) for c in {r[0] for r in rows}}

    add([r for r in rows if r[1] % 2 == 0])
    assert run() == want([r for r in rows if r[1] % 2 == 0])
    add([r for r in rows if r[1] % 2 == 1])
    assert run(1) == want(rows)  # from the checkpoint; the timers are short now
    time.sleep(0.1)
    add([(9, 0, None, None)])
    assert run() == {9: (1, [(0, None, None)])}  # all others have ended
    add([(1, 50, "user", "again")])
    assert run() == {9: (1, [(0, None, None)]), 1: (1, [(50, "user", "again")])}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"  # the session's own setting
