"""Streams: status per case, arriving documents, activity logs. Each has a batch twin with the same result."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseflow.functions import text as T
from caseflow.operators.quality import baseline_fill
from caseflow.operators.worklog import TERMINAL, batch_outcome, item_status_matrix
from caseflow.sources.keyed import KeyedTable
from caseflow.sources.shared import drop_folder, numbered_folders

# ---- batch twins


def latest_state(events: DataFrame, key: str = "case_id", at: str = "ts") -> DataFrame:
    """Latest state and number of events of each key; ties go to the larger step, then message."""
    order = F.struct(at, "step", "message")
    return events.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max_by("step", order).alias("step"), F.max_by("message", order).alias("message"), F.max(at).alias("updated_at"), F.count("*").alias("n_events"))


def history(events: DataFrame, key: str = "case_id", at: str = "ts") -> DataFrame:
    """The events of each key in order."""
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, "step", "status", "message"))).alias("history"))


def stuck_states(states: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Running states without an update become errors."""
    late = (F.col("status") == "running") & (F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return states.withColumn("message", F.when(late, F.lit(f"no update for {minutes} minutes")).otherwise(F.col("message"))).withColumn("status", F.when(late, "error").otherwise(F.col("status")))


def retained(states: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Without terminal states that are older."""
    return states.where(~(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS"))))


def attempts(events: DataFrame, key: str = "case_id") -> DataFrame:
    """Retries of each key and whether it stands at error."""
    return events.groupBy(key).agg(F.count_if(F.col("status") == "retry").alias("attempts"), F.max_by("status", F.struct("ts", "step", "message")).alias("status"))


LOG_LINE = r"\[([A-Z_]+)\]\[(START|END|ERROR)\]\s*([^|]*)\|?\s*(.*)$"


def parse_activity(lines: DataFrame, line: str = "line", at: str = "ts") -> DataFrame:
    """Action, phase, text, key=value pairs and duration of activity lines; other lines go."""
    pairs = F.str_to_map(F.regexp_replace(F.regexp_extract(line, LOG_LINE, 4), r"\s*\|\s*", "|"), F.lit(r"\|"), F.lit("="))
    rows = lines.select(at, F.regexp_extract(line, LOG_LINE, 1).alias("action"), F.regexp_extract(line, LOG_LINE, 2).alias("phase"), F.trim(F.regexp_extract(line, LOG_LINE, 3)).alias("text"), pairs.alias("fields"))
    return rows.where("action <> ''").withColumn("duration_ms", F.regexp_extract(F.coalesce(F.try_element_at("fields", F.lit("duration")), F.lit("")), r"(\d+)", 1)).withColumn("duration_ms", F.expr("try_cast(duration_ms as bigint)"))


def activity_metrics(activity: DataFrame, width: str = "5 minutes", at: str = "ts", watermark: str | None = "10 minutes") -> DataFrame:
    """Counts, errors and durations per action and window."""
    rows = activity.withWatermark(at, watermark) if watermark and activity.isStreaming else activity
    out = rows.groupBy(F.window(at, width).alias("w"), "action").agg(F.count("*").alias("n"), F.count_if(F.col("phase") == "ERROR").alias("errors"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    return out.select(F.col("w.start").alias("window_start"), "action", "n", "errors", "total_ms", "max_ms")


def deduplicated(rows: DataFrame, keys: list[str], at: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """The first row of each key (by the other columns, where times are equal); as a stream, within the watermark."""
    if rows.isStreaming:
        return rows.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)
    order = [at, *(c for c in rows.columns if c != at and c not in keys and "map<" not in rows.schema[c].dataType.simpleString())]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


# ---- streams


STATE = "case_id long, status string, step string, message string, updated_at timestamp, n_events long"


def state_stream(events: DataFrame, minutes: int = 10, days: int = 7) -> DataFrame:
    """A row per change of a key's state; a running key without events for ``minutes`` of event time ends in error.

    The state of a key is one row, kept in the state store; its history is the stream of events itself. What isn't
    running leaves the store ``days`` after its last event.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, step, message, at, n = state.get
            state.remove()
            if status == "running":
                yield pd.DataFrame({"case_id": [key[0]], "status": ["error"], "step": [step], "message": [f"no update for {minutes} minutes"], "updated_at": [pd.Timestamp(at, unit="us")], "n_events": [n]})
            return
        status, step, message, at, n = state.get if state.exists else (None, "", "", -1, 0)
        for b in batches:
            texts = {c: b[c].where(b[c].notna(), "") for c in ("step", "message")}  # unknown ones come first
            for r in b.assign(**texts).sort_values(["ts", "step", "message"]).itertuples():
                when = r.ts.value // 1000
                n += 1
                if (when, r.step, r.message) >= (at, step, message):
                    status, step, message, at = r.status, r.step, r.message, when
        state.update((status, step, message, at, n))
        state.setTimeoutTimestamp(max(at // 1000 + (minutes if status == "running" else days * 1440) * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"case_id": [key[0]], "status": [status], "step": [step], "message": [message], "updated_at": [pd.Timestamp(at, unit="us")], "n_events": [n]})

    keyed = events.withWatermark("ts", "1 minute").groupBy("case_id")
    return keyed.applyInPandasWithState(run, STATE, "status string, step string, message string, at long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def _merged(states: DataFrame) -> DataFrame:
    order = F.struct("updated_at", "step", "message")
    return states.groupBy("case_id").agg(*(F.max_by(c, order).alias(c) for c in ("status", "step", "message")), F.max("updated_at").alias("updated_at"), F.sum("n_events").alias("n_events"))


def read_states(spark: SparkSession, target: str, days: int | None = 7, before: int | None = None) -> DataFrame:
    """The states that ``merge_states`` keeps in ``target`` (of batches below ``before``).

    Terminal states that are ``days`` older than the latest update are left out (none, if ``days`` is null).
    """
    below = lambda numbers: [n for n in numbers if before is None or n < before]
    base = below(numbered_folders(f"{target}/base"))[-1:]
    deltas = [n for n in below(numbered_folders(f"{target}/delta")) if not base or n > base[0]]
    tables = [f"{target}/base/batch={n}" for n in base] + [f"{target}/delta/batch={n}" for n in deltas]
    states = _merged(spark.read.schema(STATE).parquet(*tables)) if tables else spark.createDataFrame([], STATE)
    if days is None:
        return states
    now = states.agg(F.max("updated_at").alias("__now"))
    return retained(states.join(F.broadcast(now), F.lit(True)), F.col("__now"), days).drop("__now")  # now: one row


def merge_states(target: str, events: DataFrame, checkpoint: str, trigger: dict | None = None, days: int | None = 7, compact_every: int = 10) -> StreamingQuery:
    """A table of latest states, read by ``read_states``.

    A micro-batch adds its own latest states as one small table; every ``compact_every`` batches these and the last base
    become a new base without states that are past retention, and what the base before the last one needed goes. So the
    work of a batch follows its events, the disk follows the states, and a repeated batch overwrites itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest_state(batch).write.mode("overwrite").parquet(f"{target}/delta/batch={number}")
        if (number + 1) % compact_every:
            return
        held = numbered_folders(f"{target}/base")
        older = [n for n in held if n < number]
        both = read_states(spark, target, None, number).unionByName(spark.read.schema(STATE).parquet(f"{target}/delta/batch={number}"))
        states = _merged(both)
        if days is not None:
            now = states.agg(F.max("updated_at").alias("__now"))
            states = retained(states.join(F.broadcast(now), F.lit(True)), F.col("__now"), days).drop("__now")
        states.write.mode("overwrite").parquet(f"{target}/base/batch={number}")
        for n in older[:-1]:
            drop_folder(f"{target}/base/batch={n}")
        for n in numbered_folders(f"{target}/delta"):
            if older and n <= older[-1]:
                drop_folder(f"{target}/delta/batch={n}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# ---- arriving documents


#: Documents of a group in which failing ones are looked for first, about; the most groups; parts into which a failing one is dealt, as a power of two; groups tried at once.
GROUP, GROUPS, PARTS, AT_ONCE = 16, 1 << 14, 2, 16
_LOST = ("ExecutorLostFailure", "FetchFailed", "cancelled", "CANCELLED", "OutOfMemory")
#: What moves rows between partitions; tables that are broadcast don't.
_MOVES = re.compile(r"(?<!Broadcast)(?:Exchange|CollectLimit|TakeOrderedAndProject)\b")


def settle(batch: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, key: str = "doc_id") -> None:
    """T4: write ``extract`` of a batch to ``path`` with ``status`` and ``reason``: documents that fail are rows of their own.

    All goes well in one job. If it fails, the batch is written once, its documents are dealt into groups by a hash of the
    key, and failing groups are dealt into parts until a failing one is one document; the others are written in one job. The
    groups of a level are partitions of one frame, so it is planned once, and each is tried by a job of one task: about ten
    such jobs for one bad document, however many there are. An extraction that moves rows between partitions is planned for
    each group. A failure that is the cluster's is raised, so the batch is tried again.
    """
    aside, spark = f"{path.rstrip('/')}-aside".replace("batch=", "pieces-"), batch.sparkSession
    schema = extract(batch.where("false")).schema
    ready = lambda rows: extract(rows).select("*", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("reason"))

    def error_of(work: Callable[[], object]) -> str | None:
        try:
            work()
        except Exception as error:  # whatever the extraction raises
            if any(w in str(error) for w in _LOST):
                raise
            return _reason(error)

    if error_of(lambda: ready(batch).write.mode("overwrite").parquet(path)) is None:
        return
    batch.withColumn("__hash", F.xxhash64(key)).write.mode("overwrite").parquet(f"{aside}/rows")
    rows = spark.read.parquet(f"{aside}/rows")
    hashes = rows.select("__hash").distinct()

    def tried(place: Column, groups: list[int]) -> list[str | None]:
        """For each group, why it fails, or null."""
        count = len(groups)
        at = spark.createDataFrame([(g, k) for k, g in enumerate(groups)], "group long, place int")
        laid = rows.withColumn("group", place).join(F.broadcast(at), "group").repartitionById(count, "place")
        made = extract(laid.select(*batch.columns))
        if len(_MOVES.findall(made._jdf.queryExecution().executedPlan().toString())) == 1:  # our own
            sizes = made.select(F.array(*(F.octet_length(F.col(f"`{c}`").cast("string")) for c in made.columns))).rdd  # every value is made; little leaves the JVM
            count_rows = lambda part: [sum(1 for _ in part)]  # noqa: E731  travels by value: workers needn't import this module
            one = lambda k: error_of(lambda: spark.sparkContext.runJob(sizes, count_rows, [k]))
        else:
            one = lambda k: error_of(lambda: extract(laid.where(F.col("place") == k).select(*batch.columns)).write.format("noop").mode("overwrite").save())
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(inheritable_thread_target(one), range(count)))

    bits = min(GROUPS, max(1, hashes.count() // GROUP)).bit_length() - 1
    failed, above, inside = [], {}, hashes
    while True:
        # groups of this level: their documents, or the only one's hash; a failing group whose documents all stay together needn't be tried
        place = F.pmod("__hash", F.lit(1 << bits))
        level = [r.asDict() for r in inside.groupBy(place.alias("group")).agg(F.count("*").alias("n"), F.min("__hash").alias("hash")).collect()]
        over = {g["group"]: above[g["group"] & (1 << bits - PARTS) - 1] for g in level} if above else {}
        ask = [g["group"] for g in level if not over or g["n"] < over[g["group"]][0]]
        reasons = {g: reason for g, (_, reason) in over.items()} | (dict(zip(ask, tried(place, ask))) if ask else {})
        bad = [g for g in level if reasons[g["group"]] is not None]
        failed += [(g["hash"], reasons[g["group"]]) for g in bad if g["n"] == 1]
        above = {g["group"]: (g["n"], reasons[g["group"]]) for g in bad if g["n"] > 1}
        if not above:
            break
        still = spark.createDataFrame([(g,) for g in above], "group long")
        inside = hashes.withColumn("group", place).join(F.broadcast(still), "group", "left_semi").select("__hash")
        bits += PARTS

    reasons = spark.createDataFrame(failed, "__hash long, reason string")  # a row for each document that fails
    good = rows.join(F.broadcast(reasons), "__hash", "left_anti").select(*batch.columns)
    ready(good).write.mode("overwrite").parquet(path)
    none = spark.createDataFrame([], schema).select("*", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("reason"))
    out = rows.select(key, "__hash").distinct().join(reasons, "__hash").select(key, F.lit("error").alias("status"), "reason")
    none.unionByName(out, allowMissingColumns=True).write.mode("append").parquet(path)
    drop_folder(aside)


def _reason(error: Exception) -> str:
    cause = error.java_exception.getCause() if isinstance(error, Py4JJavaError) else None
    text = str(cause.getMessage()) if cause is not None else str(error)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    said = [x for x in lines if not x.startswith(("at ", "File ", "Traceback", "An exception was thrown", "JVM stacktrace"))]
    return (said or lines or [type(error).__name__])[0][:300]


def arriving_documents(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, trigger: dict | None = None, key: str = "doc_id") -> StreamingQuery:
    """T4: each micro-batch of pages becomes rows in ``target``, ready or in error; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        settle(batch, extract, f"{target}/batch={number}", key)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def retry_failed(spark: SparkSession, target: str, pages: DataFrame, extract: Callable[[DataFrame], DataFrame], number: int, key: str = "doc_id") -> None:
    """Extract again what stands at error, from its pages alone; retry ``number`` (from 1) overwrites itself."""
    asked = settled_documents(spark, target, key, before=number).where("status = 'error'").select(key)
    settle(pages.join(asked, key, "left_semi"), extract, f"{target}-retries/batch={number}", key)


def settled_rows(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """All rows of all attempts: ``batch``, and ``attempt``, which is 0 for the stream's own and counts retries (below ``before``)."""
    rows = spark.read.option("mergeSchema", "true").parquet(target).withColumn("attempt", F.lit(0))
    for n in numbered_folders(f"{target}-retries"):
        if before is None or n < before:
            again = spark.read.parquet(f"{target}-retries/batch={n}").withColumns({"batch": F.lit(None).cast("int"), "attempt": F.lit(n)})
            rows = rows.unionByName(again, allowMissingColumns=True)
    return rows


def settled_documents(spark: SparkSession, target: str, key: str = "doc_id", before: int | None = None) -> DataFrame:
    """(key, batch, attempt, status, reason): each document as its last attempt left it."""
    by_attempt = settled_rows(spark, target, before).groupBy(key, "attempt").agg(F.max("batch").alias("batch"), F.when(F.count_if(F.col("status") == "error") > 0, "error").otherwise("ready").alias("status"), F.max("reason").alias("reason"))
    return by_attempt.groupBy(key).agg(F.max("batch").alias("batch"), F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status"), F.max_by("reason", "attempt").alias("reason"))


def batch_counts(documents: DataFrame) -> DataFrame:
    """T4, A3, A4: of ``settled_documents`` how many of each batch are ready or failed, and what came of it."""
    return batch_outcome(item_status_matrix(documents.withColumnRenamed("batch", "batch_id")))


def late_enrichment(table: KeyedTable, arriving: DataFrame, fields: list[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """T5: late values fill blanks of existing cases; a batch rewrites only the partitions of the keys that it brings."""

    def merged(cases: DataFrame, late: DataFrame) -> DataFrame:
        # what stays blank stays as it was, whether its partition is touched or not
        kept = cases.withColumns({f"__was_{f}": F.col(f) for f in fields})
        filled = baseline_fill(kept, late, fields, table.key)
        return filled.withColumns({f: F.coalesce(f, f"__was_{f}") for f in fields}).select(*cases.columns)

    def fill(batch: DataFrame, number: int) -> None:
        one = batch.groupBy(table.key).agg(*(F.min(T.unblank(f)).alias(f) for f in fields))
        table.change(number, one, merged)

    return arriving.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
