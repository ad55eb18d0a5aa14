"""Work tracking: batches, items, queues, status, retention and retry.

Every rule about "now" takes ``now``; every order ends in a tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.operators.match import first_by, small
from caseflow.sources.shared import work_path

DONE, FAILED = ("completed", "success"), ("error", "failed")
TERMINAL = DONE + FAILED


# ---- filters and projections


def scope_to_owner(df: DataFrame, owner_id: int, is_admin: bool = False) -> DataFrame:
    """P1"""
    return df if is_admin else df.where(F.col("owner_id") == owner_id)


def search(df: DataFrame, columns: list[str], term: str | None) -> DataFrame:
    """P2"""
    return df.where(T.ilike_any(columns, term))


def stuck(items: DataFrame, now: Column, minutes: int = 10, at: str = "updated_at") -> DataFrame:
    """P5: running and not updated since."""
    return items.where((F.col("status") == "running") & (F.col(at) < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def expired(df: DataFrame, statuses: tuple[str, ...], now: Column, days: int = 7, at: str = "updated_at", paths: tuple[str, ...] = ()) -> DataFrame:
    """Terminal and older; with ``paths``, only rows that still have one."""
    old = F.col("status").isin(*statuses) & (F.col(at) < now - F.expr(f"INTERVAL {days} DAYS"))
    return df.where(old & F.coalesce(*paths).isNotNull() if paths else old)


def select_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows with these ids, the ids that no row has)."""
    wanted = ids.select(key).distinct()
    return df.join(wanted, key, "left_semi"), wanted.join(df.select(key), key, "left_anti")


def retry_eligible(items: DataFrame, workers: int, by: str = "batch_id") -> DataFrame:
    """Failed or ready, with a case, while fewer than ``workers`` are running in the batch."""
    running = F.count_if(F.col("status") == "running").over(Window.partitionBy(by))
    return items.withColumn("running", running).where(F.col("status").isin("error", "ready") & F.col("case_id").isNotNull() & (F.col("running") < workers))


def enqueue_eligible(batches: DataFrame, items: DataFrame, statuses: tuple[str, ...] = ("ready", "partial_completed")) -> DataFrame:
    """Not queued, of these statuses, with a ready item."""
    ready = items.where(F.col("status") == "ready").select("batch_id")
    return batches.where(F.col("queue_position").isNull() & F.col("status").isin(*statuses)).join(ready, "batch_id", "left_semi")


def reset(df: DataFrame, ids: DataFrame, key: str, values: dict[str, object]) -> DataFrame:
    """Columns set to values for the given ids; everything else stays."""
    chosen = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    met = df.join(chosen, key, "left")
    return met.withColumns({c: F.when(F.col("__hit"), F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}).drop("__hit")


PROTECTED = ("case_id", "owner_id", "created_at", "updated_at")


def update_field(df: DataFrame, key: str, key_value, column: str, value, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """One column of one row; protected and unknown columns are errors."""
    if column in protected or column not in df.columns:
        raise ValueError(f"{column!r} can't be changed")
    return df.withColumn(column, F.when(F.col(key) == key_value, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def set_field(spark, table, number: int, key_value, column: str, value, protected: tuple[str, ...] = PROTECTED) -> list[int]:
    """P15 on a table kept by key: only the partition of that row is rewritten; ``number`` names the change."""
    kind = table.read(spark).schema[table.key].dataType
    row = spark.range(1).select(F.lit(key_value).cast(kind).alias(table.key))
    update_field(table.read(spark), table.key, key_value, column, value, protected)  # what may not be changed is an error before anything is written
    return table.change(number, row, lambda rows, _: update_field(rows, table.key, key_value, column, value, protected))


# ---- joins


def effective_status(status: Column, case_status: Column) -> Column:
    """A case that has ended or runs speaks for itself."""
    return F.when(case_status.isin("success", "error", "processing"), case_status).otherwise(status)


def item_status_view(items: DataFrame, cases: DataFrame, status: DataFrame) -> DataFrame:
    """Items with their case and its latest status."""
    c = cases.select("case_id", "external_status", "cliente")
    s = status.select("case_id", F.col("status").alias("robot_status"), F.col("message").alias("robot_message"))
    met = items.join(c, "case_id", "left").join(s, "case_id", "left")
    return met.withColumn("effective", effective_status(F.coalesce("robot_status", "status"), F.col("external_status")))


def sync_items(items: DataFrame, cases: DataFrame) -> DataFrame:
    """A running item whose case has ended takes the case's state."""
    met = items.join(cases.select("case_id", F.col("external_status").alias("__x")), "case_id", "left")
    return met.withColumn("status", F.when((F.col("status") == "running") & F.col("__x").isin("success", "error"), F.col("__x")).otherwise(F.col("status"))).drop("__x")


def delete_batches(ids: DataFrame, batches: DataFrame, items: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batches, items, cases) without the given batches, their items, and the cases of those."""
    gone = ids.select("batch_id").distinct()
    dead_cases = items.join(gone, "batch_id", "left_semi").select("case_id").where("case_id is not null")
    return batches.join(gone, "batch_id", "left_anti"), items.join(gone, "batch_id", "left_anti"), cases.join(dead_cases, "case_id", "left_anti")


def first_item_per_case(items: DataFrame) -> DataFrame:
    """J9"""
    return first_by(items.where("case_id is not null"), ["case_id"], F.col("item_id"))


def annex_requests(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests (doc_type, total_pages) with the statistics of their type and size bucket."""
    stats = annex_stats(history)
    return requests.withColumn("bucket", T.size_bucket("total_pages")).join(small(stats), ["doc_type", "bucket"], "left")


def needed_docs(df: DataFrame, field_docs: DataFrame, key: str = "case_id", missing: str = "missing") -> DataFrame:
    """The document types that hold a case's missing fields."""
    asked = df.select(key, F.explode(missing).alias("field"))
    return asked.join(small(field_docs.select("field", "doc_type")), "field").groupBy(key).agg(F.array_sort(F.collect_set("doc_type")).alias("doc_types"))


# ---- aggregates


def case_counts(cases: DataFrame, owner_id: int) -> DataFrame:
    """A1"""
    return cases.agg(F.count("*").alias("total"), F.count_if(F.col("owner_id") == owner_id).alias("own"))


def item_status_matrix(items: DataFrame) -> DataFrame:
    """A3: items of each state per batch."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return items.groupBy("batch_id").agg(F.count("*").alias("total"), n("ready").alias("ready"), n("running").alias("running"), n(*DONE).alias("done"), n(*FAILED).alias("failed"))


def batch_outcome(matrix: DataFrame) -> DataFrame:
    """Outcome of extraction, whether the run has ended, and its outcome."""
    ok = F.col("total") - F.col("failed")
    ended = F.col("done") + F.col("failed") == F.col("total")
    return matrix.withColumns(
        {
            "extraction": F.when(F.col("failed") == 0, "ready").when(ok > 0, "partial_ready").otherwise("error"),
            "all_done": ended,
            "run": F.when(~ended, "running").when(F.col("failed") == 0, "completed").otherwise("partial_completed"),
        }
    )


def progress(done: Column, total: Column) -> Column:
    """A5: whole percent, 0 of nothing."""
    return F.coalesce(F.floor(100 * done / F.nullif(total, F.lit(0))), F.lit(0)).cast("int")


def annex_stats(history: DataFrame) -> DataFrame:
    """Places of annexes per type and size bucket."""
    r = F.col("page_ratio") if "page_ratio" in history.columns else T.page_ratio("page_number", "total_pages")
    return history.withColumn("__r", r).groupBy("doc_type", T.size_bucket("total_pages").alias("bucket")).agg(F.avg("__r").alias("mean_ratio"), F.min("__r").alias("min_ratio"), F.max("__r").alias("max_ratio"), F.count("*").alias("samples"))


def annex_summary(history: DataFrame) -> DataFrame:
    """A7"""
    r = F.col("page_ratio") if "page_ratio" in history.columns else T.page_ratio("page_number", "total_pages")
    return history.groupBy("doc_type").agg(F.count("*").alias("n"), F.avg(r).alias("mean_ratio"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in a total order.

    The sorted rows are written once; a place is that within its partition plus the rows of the partitions before, so no
    task sees more than its partition, and one row per partition.
    """
    spark = rows.sparkSession
    at = work_path(spark, "numbered")
    rows.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")).write.parquet(at)
    held = spark.read.parquet(at)
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = held.join(F.broadcast(sizes.select("__part", "__first", before.alias("__before"))), "__part")
    return met.withColumn(name, F.col("__before") + F.col("__id") - F.col("__first") + 1).drop("__part", "__id", "__first", "__before")


def enqueue(batches: DataFrame, entries: DataFrame) -> DataFrame:
    """Positions behind the last one for new entries, in their order."""
    last = batches.agg(F.coalesce(F.max("queue_position"), F.lit(0)).alias("__last"))
    rows = numbered(entries, "queued_at", "batch_id", name="__n").join(F.broadcast(last), F.lit(True))  # last: one row
    return rows.withColumn("queue_position", (F.col("__last") + F.col("__n")).cast("int")).drop("__last", "__n")


# ---- windows and orders


def latest_case(cases: DataFrame, keys: list[str] | None = None, number: str = "numero_processo") -> DataFrame:
    """The last updated case with a number, overall or per key."""
    rows = cases.where(~T.blank(number))
    return first_by(rows, keys, F.desc("updated_at"), F.desc("case_id")) if keys else rows.orderBy(F.desc("updated_at"), F.desc("case_id")).limit(1)


def resequence_queue(batches: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Positions without gaps, in the old order, after removal."""
    rows = batches.join(removed.select("batch_id"), "batch_id", "left_anti") if removed is not None else batches
    queued = numbered(rows.where("queue_position is not null"), "queue_position", "batch_id", name="__n").withColumn("queue_position", F.col("__n").cast("int")).drop("__n")
    return queued.unionByName(rows.where("queue_position is null"))


def next_in_queue(batches: DataFrame, statuses: tuple[str, ...] = ("queued", "ready")) -> DataFrame:
    """W3"""
    return batches.where(F.col("queue_position").isNotNull() & F.col("status").isin(*statuses)).orderBy("queue_position", "batch_id").limit(1)


#: How much a source of evidence is trusted.
CONFIDENCE = {"bookmark": 1.0, "toc": 0.9, "ocr": 0.7}


def best_evidence(rows: DataFrame) -> DataFrame:
    """Per case and type the row of highest confidence, the earliest of equals."""
    known = F.col("confidence") if "confidence" in rows.columns else F.lit(None).cast("double")
    by_source = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    rows = rows.withColumn("confidence", F.coalesce(known, by_source[F.col("source")], F.lit(0.5)))
    return first_by(rows, ["case_id", "doc_type"], F.desc("confidence"), F.col("arrival"), F.col("page_number"))


def recent(df: DataFrame, n: int = 10, at: str = "created_at", key: str = "case_id") -> DataFrame:
    """O1, O7"""
    return df.orderBy(F.desc(at), F.desc(key)).limit(n)


def page_of(df: DataFrame, page: int, size: int = 20, at: str = "created_at", key: str = "case_id") -> DataFrame:
    """O2"""
    return df.orderBy(F.desc(at), F.desc(key)).offset((page - 1) * size).limit(size)


def batch_order(by_queue: bool = False) -> list[Column]:
    """O3: newest first, or by the queue, then date; unknown last."""
    return [*([F.asc_nulls_last("queue_position"), F.asc("queued_at")] if by_queue else [F.desc("queued_at")]), F.asc("batch_id")]


def item_order(by: str = "file_size") -> list[Column]:
    """Lightest first, unknown last."""
    return [F.asc_nulls_last(by), F.asc("item_id")]


def batches_in_order(batches: DataFrame, by_queue: bool = False) -> DataFrame:
    return batches.orderBy(*batch_order(by_queue))


def items_in_order(items: DataFrame, by: str = "file_size") -> DataFrame:
    return items.orderBy(*item_order(by))


def data_weight(fields: list[str], long_fields: dict[str, tuple[int, int]] = {}) -> Column:  # noqa: B006
    """Filled fields, and extra points for fields longer than a bound: {field: (characters, points)}."""
    filled = sum(((~T.blank(f)).cast("int") for f in fields), F.lit(0))
    extra = [F.when(F.length(f) > n, p).otherwise(0) for f, (n, p) in long_fields.items()]
    return sum(extra, filled)


def most_incomplete(df: DataFrame, fields: list[str], n: int = 20, key: str = "case_id") -> DataFrame:
    """O6"""
    return df.withColumn("n_missing", sum((T.blank(f).cast("int") for f in fields), F.lit(0))).where("n_missing > 0").orderBy(F.desc("n_missing"), key).limit(n)


def retry(items: DataFrame, ids: DataFrame) -> DataFrame:
    """One more attempt, no error, ready again."""
    chosen = ids.select("item_id").distinct().withColumn("__hit", F.lit(True))
    met = items.join(chosen, "item_id", "left")
    return met.withColumns({"attempt_count": F.when(F.col("__hit"), F.coalesce("attempt_count", F.lit(0)) + 1).otherwise(F.col("attempt_count")), "last_error": F.when(F.col("__hit"), None).otherwise(F.col("last_error")), "status": F.when(F.col("__hit"), "ready").otherwise(F.col("status"))}).drop("__hit")
