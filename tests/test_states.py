"""The stateful streams against their batch twins, cut into micro-batches in several ways."""

import pytest
from pyspark.sql import functions as F

from caseflow.streaming import states

EVENTS = "case_id long, step string, status string, message string, ts string"


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, folder, batches, beat="2024-06-01", **settings):
    """The history of a stream that meets ``batches`` one by one, and a heartbeat at the end."""
    last = [frame(spark, [(None, None, None, None, beat)])] if beat else []
    for b in [*batches, *last]:
        b.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        states.keep_history(f"{folder}/out", spark.readStream.schema(b.schema).parquet(f"{folder}/in"), f"{folder}/cp", **settings).awaitTermination()
    return sorted(map(tuple, states.read_history(spark, f"{folder}/out").collect()), key=str)


ROWS = [
    (1, "a", "running", "m1", "2024-01-01 00:00:00"), (1, "b", "success", "m2", "2024-01-01 00:05:00"), (1, "c", "running", "m3", "2024-01-01 01:00:00"), (1, "d", "retry", "m4", "2024-01-01 02:00:00"), (1, "d", "retry", "m5", "2024-01-01 02:00:00.000001"),
    (2, None, "running", None, "2024-01-01 00:00:00"), (2, "x", "running", "z", "2024-01-01 00:00:00"), (2, None, None, "y", "2024-01-01 00:00:00"), (2, None, "running", None, "2024-01-01 00:10:00"), (2, "e", "error", "m", "2024-01-01 00:20:01"),
    (3, "a", "retry", "m", "2024-01-01 00:00:00"), (3, "a", "retry", "m", "2024-01-01 00:00:00"), (3, "b", "success", "m", "2024-01-20 00:00:00"), (4, "z", "running", "m", "2024-01-31 03:00:00"),
]


@pytest.mark.parametrize("cuts", [[14], [1, 3, 14]])
def test_history_is_the_same_however_it_arrives(spark, tmp_path, cuts):
    rows = sorted(ROWS, key=lambda r: r[4])
    batches = [frame(spark, rows[a:b]) for a, b in zip([0, *cuts], cuts)]
    want = sorted(map(tuple, states.case_history(frame(spark, ROWS)).collect()), key=str)
    assert run(spark, str(tmp_path), batches) == want
    by_case = {(r[0], r[1]): r for r in want}
    assert by_case[1, 4][4:] == ("error", "no update for 10 minutes", 0, "timeout") and by_case[1, 6][6] == 2
    assert [r[1] for r in want if r[0] == 3] == [1, 1, 2]  # forgotten after a week, then counted anew


def test_late_rows_go_and_the_unfinished_waits(spark, tmp_path):
    first = frame(spark, [(1, "a", "running", "m", "2024-01-01 10:00:00"), (2, "a", "success", "m", "2024-01-01 12:00:00")])
    second = frame(spark, [(1, "late", "success", "m", "2024-01-01 09:00:00"), (1, "b", "success", "m", "2024-01-01 12:30:00")])
    got = run(spark, str(tmp_path), [first, second], beat=None)
    assert [(r[0], r[3], r[7]) for r in got] == [(1, "a", "event"), (1, "a", "timeout"), (2, "a", "event")]  # 12:30 isn't final yet
    current = {r["case_id"]: r["status"] for r in states.current_states(states.read_history(spark, f"{tmp_path}/out")).collect()}
    assert current == {1: "error", 2: "success"}


def test_retries_meet_their_outcomes(spark, tmp_path):
    asked = frame(spark, [(1, "s", "retry", "r1", "2024-01-01 00:00:00"), (1, "s", "retry", "r2", "2024-01-01 00:50:00"), (2, "s", "retry", "r3", "2024-01-01 00:00:00"), (3, "s", "retry", "r4", "2024-01-02 00:00:00")])
    ended = frame(spark, [(1, "s", "success", "e1", "2024-01-01 01:00:00"), (1, "s", "error", "e2", "2024-01-01 00:00:00"), (2, "s", "success", "e3", "2024-01-01 01:00:01")])
    want = sorted(map(tuple, states.retry_outcomes(asked, ended).collect()), key=str)
    assert [(r[2], r[4]) for r in want] == [("r1", "success"), ("r2", "success"), ("r3", None), ("r4", None)]
    for a, e in zip(states.replay(asked, f"{tmp_path}/asked"), states.replay(ended, f"{tmp_path}/ended")):
        stream = lambda path: spark.readStream.schema(asked.schema).parquet(path)
        states.keep_outcomes(f"{tmp_path}/out", stream(a), stream(e), f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == want


def test_what_is_held_is_a_row_per_key_and_the_waiting_events(spark, tmp_path):
    """10,000 keys: no call and no state access for each; a key past its retention leaves, and the others stay."""
    rows = spark.range(10_000).select(F.col("id").alias("case_id"), F.lit("s").alias("step"), F.lit("success").alias("status"), F.lit("m").alias("message"), F.when(F.col("id") < 4000, F.lit("2024-01-01 00:00:00")).otherwise(F.lit("2024-01-09 00:00:00")).cast("timestamp").alias("ts"))
    last = frame(spark, [(k, "t", "success", "m", "2024-01-09 00:05:00") for k in (1, 5000)])
    got = run(spark, str(tmp_path), [rows, last], beat=None)
    assert len(got) == 10_000 and {r[1] for r in got} == {1}
    held = spark.read.parquet(f"{tmp_path}/cp-states/batch=1")
    assert {r["cause"]: r["count"] for r in held.groupBy("cause").count().collect()} == {"event": 6000, "waiting": 2, "mark": 1}
    assert sorted(run(spark, str(tmp_path), []), key=lambda r: r[1])[-1][:2] == (5000, 2)  # a heartbeat makes the waiting ones final
