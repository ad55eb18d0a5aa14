"""The states of all keys in event time, as a job of windows over each micro-batch.

A key's events wait in a table until the watermark has passed them, so that they are final, and then become its
history in order, numbered from 1. The watermark does the rest: a running key without an event for ``minutes`` of event
time gets an error of its own, at the time when it was due, and a key without events for ``days`` is forgotten.
What comes out depends on the events alone, not on how they were cut into micro-batches: ``case_history`` is the
batch twin with the same rows.

What is held per key is one row and the events of the watermark's delay, never its history. A micro-batch reads and
writes what is held once, beside its own events, and overwrites itself when it is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseflow.sources.shared import drop_folder, numbered_folders

#: A change of a key's state: ``cause`` is "event", or "timeout" for errors of our own.
CHANGE = "case_id long, n long, ts timestamp, step string, status string, message string, attempts long, cause string"
#: Heartbeats belong to no case, but they move the watermark: the time in this condition keeps it above that.
_HAS_CASE = "case_id IS NOT NULL OR ts < TIMESTAMP '0001-01-01 00:00:00'"


def _in_order(*first: str) -> list[Column]:
    """Events by time, step, status and message; unknown ones first."""
    return [*map(F.col, first), *(F.asc_nulls_first(c) for c in ("ts", "step", "status", "message"))]


def _numbered(rows: DataFrame, last: DataFrame, mark: Column | None, minutes: int, days: int) -> DataFrame:
    """CHANGE of final events that follow the ``last`` changes of their keys, up to the watermark (null: of all time)."""
    wait, key = F.expr(f"INTERVAL {minutes} MINUTES"), Window.partitionBy("case_id")
    events = rows.select("case_id", F.lit(None).cast("long").alias("n"), "ts", "step", "status", "message", F.lit(None).cast("long").alias("attempts"), F.lit("event").alias("cause"), F.lit(1).alias("new"))
    in_order = key.orderBy(*_in_order("new"))
    met = events.unionByName(last.withColumn("new", F.lit(0))).withColumns({"next": F.lead("ts").over(in_order), "k": F.row_number().over(in_order)})
    silent = F.col("next").isNull() if mark is None else F.col("next").isNull() & (F.col("ts") + wait <= mark)
    late = met.where((F.col("status") == "running") & (silent | (F.col("next") > F.col("ts") + wait)))
    late = late.withColumns({"ts": F.col("ts") + wait, "status": F.lit("error"), "message": F.lit(f"no update for {minutes} minutes"), "cause": F.lit("timeout"), "new": F.lit(1)})
    every = key.orderBy("k", "cause")
    fresh = F.col("ts") > F.lag("ts").over(every) + F.expr(f"INTERVAL {days} DAYS")
    parted = met.unionByName(late).withColumn("life", F.sum(F.coalesce(fresh, F.lit(False)).cast("int")).over(every))
    life = Window.partitionBy("case_id", "life").orderBy("k", "cause")
    held = lambda c: F.coalesce(F.max(F.when(F.col("new") == 0, F.col(c))).over(life), F.lit(0))
    retry = (F.col("status") == "retry") & (F.col("cause") == "event") & (F.col("new") == 1)
    n = F.count_if(F.col("new") == 1).over(life) + held("n")
    attempts = F.count_if(retry).over(life) + held("attempts")
    return parted.select("case_id", n.alias("n"), "ts", "step", "status", "message", attempts.alias("attempts"), "cause", "new").where("new = 1").drop("new")


def keep_history(target: str, events: DataFrame, checkpoint: str, minutes: int = 10, days: int = 7, delay: str = "1 minute", trigger: dict | None = None) -> StreamingQuery:
    """Append the changes CHANGE of a stream of (case_id, ts, step, status, message) to the table ``target``, each once.

    Rows that are ``delay`` behind the latest of the micro-batches before are dropped.
    """
    top = f"{checkpoint.rstrip('/')}-states"

    def take(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, [n for n in numbered_folders(top) if n < number]
        held = spark.read.schema(CHANGE).parquet(f"{top}/batch={done[-1]}") if done else spark.createDataFrame([], CHANGE)
        passed = held.where("cause = 'mark'").select(F.unix_micros("ts")).first()
        latest = batch.agg(F.unix_micros(F.date_trunc("millisecond", F.max("ts")) - F.expr(f"INTERVAL {delay}"))).first()
        marks = [r[0] for r in (passed, latest) if r and r[0] is not None]
        if not marks:  # no event so far
            return
        mark, before = F.timestamp_micros(F.lit(max(marks))), F.timestamp_micros(F.lit(passed[0] if passed else None).cast("long"))
        columns = ["case_id", "ts", "step", "status", "message"]
        rows = batch.select(columns).where("case_id IS NOT NULL").where(before.isNull() | F.col("ts").isNull() | (F.col("ts") > before))
        rows = rows.unionByName(held.where("cause = 'waiting'").select(columns))
        last = held.where("cause IN ('event', 'timeout')")
        _numbered(rows.where(F.col("ts").isNull() | (F.col("ts") <= mark)), last, mark, minutes, days).write.mode("overwrite").parquet(f"{target}/batch={number}")
        names = [c.split()[0] for c in CHANGE.split(", ")]
        new = last.unionByName(spark.read.schema(CHANGE).parquet(f"{target}/batch={number}"))
        new = new.groupBy("case_id").agg(F.max_by(F.struct(*(c for c in names if c != "case_id")), F.struct("ts", "n")).alias("r")).select("case_id", "r.*")
        new = new.where(F.coalesce(F.col("status") == "running", F.lit(False)) | F.col("ts").isNull() | (F.col("ts") + F.expr(f"INTERVAL {days} DAYS") > mark))
        none = {"n": F.lit(None).cast("long"), "attempts": F.lit(None).cast("long")}
        later = rows.where(F.col("ts") > mark).withColumns({**none, "cause": F.lit("waiting")})
        beat = spark.range(1).select(F.lit(None).cast("long").alias("case_id"), mark.alias("ts"), *(F.lit(None).cast("string").alias(c) for c in columns[2:])).withColumns({**none, "cause": F.lit("mark")})
        new.select(names).unionByName(later.select(names)).unionByName(beat.select(names)).write.mode("overwrite").parquet(f"{top}/batch={number}")
        for n in done[:-1]:
            drop_folder(f"{top}/batch={n}")

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_history(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(CHANGE).parquet(target).select(*(c.split()[0] for c in CHANGE.split(", ")))


def current_states(changes: DataFrame) -> DataFrame:
    """The last change of each key; a key that came back after its retention counts anew."""
    last = F.struct("ts", "n")
    return changes.groupBy("case_id").agg(*(F.max_by(c, last).alias(c) for c in ("status", "step", "message", "attempts", "n")), F.max("ts").alias("updated_at"))


def case_history(events: DataFrame, minutes: int = 10, days: int = 7) -> DataFrame:
    """The rows CHANGE of a table of events, as ``keep_history`` has them once the watermark has passed everything."""
    return _numbered(events.where("case_id is not null"), events.sparkSession.createDataFrame([], CHANGE), None, minutes, days)


# ---- retries and how they ended


def retry_outcomes(requests: DataFrame, outcomes: DataFrame, within: str = "1 hour", delay: str = "1 minute") -> DataFrame:
    """(case_id, asked_at, request, ended_at, status): each retry with what ended within ``within`` after it, or nulls.

    On streams an interval join under two watermarks: a request leaves the state, unanswered, when both have passed its interval.
    """
    marked = lambda rows: rows.withWatermark("ts", delay) if rows.isStreaming else rows
    r = marked(requests).select("case_id", F.col("ts").alias("asked_at"), F.col("message").alias("request"))
    o = marked(outcomes).select(F.col("case_id").alias("o_case_id"), F.col("ts").alias("ended_at"), "status")
    # keys within structs, so that no filter on them is pushed below the watermark, where heartbeats are needed
    same = F.expr(f"named_struct('k', case_id) = named_struct('k', o_case_id) AND ended_at > asked_at AND ended_at <= asked_at + INTERVAL {within}")
    return r.join(o, same, "leftOuter").drop("o_case_id").where(_HAS_CASE.replace(" ts ", " asked_at "))


def keep_outcomes(target: str, requests: DataFrame, outcomes: DataFrame, checkpoint: str, within: str = "1 hour", delay: str = "1 minute", trigger: dict | None = None) -> StreamingQuery:
    """Append ``retry_outcomes`` of two streams to the table ``target``; heartbeats (rows without a case) stay out."""
    out = retry_outcomes(requests, outcomes, within, delay).writeStream.outputMode("append")
    return out.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay(table: DataFrame, folder: str, at: str = "ts", slices: int = 2, beyond: str = "60 days") -> Iterator[str]:
    """Write a table as the files of a stream, oldest first, pausing behind each slice of time so that the stream can take it in.

    Last comes a row that has a time only (a heartbeat), ``beyond`` the latest, so the stream ends with everything final.
    """
    s = F.col(at).cast("timestamp").cast("double")
    cuts = [None, *(table.select(s.alias("s")).approxQuantile("s", [k / slices for k in range(1, slices)], 0.01) if slices > 1 else []), None]
    for a, b in zip(cuts, cuts[1:]):
        inside = (F.lit(True) if a is None else s > a) & (F.lit(True) if b is None else s <= b)
        table.where(inside).write.mode("append").parquet(folder)
        yield folder
    beat = table.agg((F.max(at) + F.expr(f"INTERVAL {beyond}")).alias(at))
    beat.select(*(F.col(at) if c == at else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns)).write.mode("append").parquet(folder)
    yield folder
