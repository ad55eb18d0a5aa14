"""Registered queries of the stateful streams, each equal to SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import rules
from caseflow.packs import labour_br
from caseflow.plans.catalogue import _EVENTS, _events, query, t
from caseflow.plans.more import _place
from caseflow.sources.keyed import KeyedTable
from caseflow.sources.shared import stream_of
from caseflow.streaming import jobs, states


def _stream(spark, like, folder: str):
    return spark.readStream.schema(like.schema).parquet(folder)


_HISTORY = f"""(WITH o AS (SELECT case_id, ts, step, status, message, lead(ts) OVER w AS next, row_number() OVER w AS k FROM {_EVENTS} WINDOW w AS (PARTITION BY case_id ORDER BY ts, step, status, message)),
 u AS (SELECT case_id, ts, step, status, message, k, 'event' AS cause FROM o
   UNION ALL SELECT case_id, ts + INTERVAL 10 MINUTE, step, 'error', 'no update for 10 minutes', k, 'timeout' FROM o WHERE status = 'running' AND (next IS NULL OR next > ts + INTERVAL 10 MINUTE)),
 g AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY case_id ORDER BY k, cause) + INTERVAL 1 DAY, false) AS fresh FROM u),
 l AS (SELECT *, sum(fresh::int) OVER (PARTITION BY case_id ORDER BY k, cause) AS life FROM g)
 SELECT case_id, row_number() OVER w AS n, ts, step, status, message, cast(sum((status = 'retry')::int) OVER w AS bigint) AS attempts, cause FROM l WINDOW w AS (PARTITION BY case_id, life ORDER BY k, cause))"""


def _history(spark, sf_dir):
    events, at = _events(t(spark, sf_dir, "events")), _place(spark, "history")
    for folder in states.replay(events, f"{at}/events"):
        states.keep_history(f"{at}/rows", _stream(spark, events, folder), f"{at}/checkpoint", days=1).awaitTermination()
    return states.read_history(spark, f"{at}/rows")


@query(f"SELECT * FROM {_HISTORY}")
def streamed_history(spark, sf_dir):
    """The ordered history of every key, with time-outs, numbers that begin again after retention, and retries counted."""
    return _history(spark, sf_dir)


@query(f"SELECT case_id, arg_max(status, (ts, n)) AS status, arg_max(step, (ts, n)) AS step, arg_max(attempts, (ts, n)) AS attempts, max(ts) AS updated_at FROM {_HISTORY} GROUP BY case_id")
def streamed_current(spark, sf_dir):
    """Where each key stands at the end of the stream."""
    return states.current_states(_history(spark, sf_dir)).select("case_id", "status", "step", "attempts", "updated_at")


@query(f"SELECT * FROM {_HISTORY}")
def case_histories(spark, sf_dir):
    """The batch twin"""
    return states.case_history(_events(t(spark, sf_dir, "events")), days=1)


@query(
    f"""
SELECT r.case_id, r.ts AS asked_at, r.message AS request, o.ts AS ended_at, o.status FROM {_EVENTS} r
LEFT JOIN {_EVENTS} o ON o.case_id = r.case_id AND o.status IN ('completed', 'error') AND o.ts > r.ts AND o.ts <= r.ts + INTERVAL 12 HOUR WHERE r.status = 'retry'"""
)
def streamed_retries(spark, sf_dir):
    """Retries joined with what ended within twelve hours, as two streams."""
    e, at = _events(t(spark, sf_dir, "events")), _place(spark, "outcomes")
    both = e.where("status = 'retry'"), e.where(F.col("status").isin("completed", "error"))
    for asked, ended in zip(states.replay(both[0], f"{at}/asked"), states.replay(both[1], f"{at}/ended")):
        states.keep_outcomes(f"{at}/rows", _stream(spark, e, asked), _stream(spark, e, ended), f"{at}/checkpoint", within="12 HOURS").awaitTermination()
    return spark.read.parquet(f"{at}/rows")


@query(
    """
WITH u AS (SELECT o_custkey, min(nullif(trim(o_orderpriority), '')) AS p FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE coalesce(p, ' ') END AS label FROM customer LEFT JOIN u ON o_custkey = c_custkey"""
)
def late_labels(spark, sf_dir):
    """T5: labels that arrive for customers fill those that are blank; the table is changed by key."""
    at, name = _place(spark, "labels"), "orders"
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE ' ' END").alias("label"))
    table = KeyedTable(f"{at}/table", "c_custkey", 8).create(rows)
    late = stream_of(t(spark, sf_dir, name), f"{sf_dir}/{name}.parquet").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("label"))
    jobs.late_enrichment(table, late, ["label"], f"{at}/checkpoint").awaitTermination()
    return table.read(spark)


@query("SELECT conv_id AS doc_id, CASE WHEN conv_id % 100 = 7 THEN 'error' ELSE 'ready' END AS status, count(*) FILTER (conv_id % 100 <> 7 AND role = 'user') AS found FROM conversations GROUP BY 1, 2")
def settled_turns(spark, sf_dir):
    """T4: conversations arrive and are extracted; in some, one turn raises an error, which costs their document alone."""
    at, name = _place(spark, "settled"), "conversations"
    turns = stream_of(t(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")
    pages = turns.select(F.col("conv_id").alias("doc_id"), "turn", "role", F.when(F.col("role") == "user", F.lit("Distribuído em 05.03.2024")).otherwise(F.lit("nada")).alias("text"))

    def work(batch):
        seen = F.when((F.col("doc_id") % 100 == 7) & (F.col("turn") == 0), F.raise_error(F.lit("unreadable"))).otherwise(F.col("text"))
        return rules.extract(batch.select("doc_id", "turn", seen.alias("text")), labour_br.PACK, fields=["filing_date"], keep=("doc_id", "turn"), provenance=False)

    jobs.arriving_documents(pages, work, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    found = jobs.settled_rows(spark, f"{at}/rows").groupBy("doc_id").agg(F.count("filing_date").alias("found"))
    return jobs.settled_documents(spark, f"{at}/rows").join(found, "doc_id").select("doc_id", "status", "found")
