"""Failing documents are found by small jobs of one plan, not by a plan each."""

from pyspark.sql import functions as F

from caseflow.streaming import jobs


def _settled(spark, rows, work, at):
    calls = []

    def counted(batch):
        calls.append(1)
        return work(batch)

    jobs.settle(rows, counted, f"{at}/rows/batch=0")
    got = {r["doc_id"]: (r["status"], "unreadable" in (r["reason"] or "")) for r in jobs.settled_documents(spark, f"{at}/rows").collect()}
    return got, len(calls)


def _raises(every):
    return F.when((F.col("doc_id") % every == 0) & (F.col("turn") == 1), F.raise_error(F.lit("unreadable"))).otherwise(F.lit("x"))


def test_an_extraction_is_planned_once_a_level(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") / 3).cast("long").alias("doc_id"), (F.col("id") % 3).alias("turn"))
    got, plans = _settled(spark, rows, lambda b: b.select("doc_id", "turn", _raises(6).alias("text")), tmp_path)
    assert got == {k: ("error", True) if k % 6 == 0 else ("ready", False) for k in range(300)}
    assert plans < 12  # not some for each of the fifty that fail
    ready = jobs.settled_rows(spark, str(tmp_path / "rows")).where("status = 'ready'")
    assert ready.count() == 750 and ready.where("text = 'x'").count() == 750


def test_extractions_that_move_rows(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") / 3).cast("long").alias("doc_id"), (F.col("id") % 3).alias("turn"))
    got, _ = _settled(spark, rows, lambda b: b.withColumn("text", _raises(7)).groupBy("doc_id").agg(F.max("text").alias("text")), tmp_path)
    assert got == {k: ("error", True) if k % 7 == 0 else ("ready", False) for k in range(20)}
