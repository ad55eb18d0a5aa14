"""Tables changed by key, and batches of documents of which some fail."""

import os

import pytest
from pyspark.sql import functions as F

from caseflow.operators import worklog
from caseflow.sources.keyed import KeyedTable
from caseflow.streaming import jobs

CASES = "case_id long, v string, w string"


def files(table):
    return {d: sorted(os.listdir(f"{table.path}/rows/{d}")) for d in os.listdir(f"{table.path}/rows") if d.startswith("__part")}


def made(spark, path, n=200, parts=16):
    rows = spark.range(n).select(F.col("id").alias("case_id"), F.when(F.col("id") % 2 == 0, F.lit(" ")).otherwise("old").alias("v"), F.lit("w").alias("w"))
    return KeyedTable(str(path), "case_id", parts).create(rows)


def test_a_change_rewrites_only_its_partitions(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    before = files(table)
    new = spark.createDataFrame([(4, "new", "x"), (1000, "fresh", None)], CASES)
    touched = table.upsert(1, new)
    after = files(table)
    assert 1 <= len(touched) <= 2 and {d for d in before if before[d] != after[d]} == {f"__part={p}" for p in touched}
    rows = {r["case_id"]: (r["v"], r["w"]) for r in table.read(spark).collect()}
    assert len(rows) == 201 and rows[4] == ("new", "x") and rows[1000] == ("fresh", None) and rows[3] == ("old", "w")
    plan = table.read(spark, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_repeated_change_changes_nothing(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.upsert(1, spark.createDataFrame([(4, "one", "x")], CASES))
    table.upsert(2, spark.createDataFrame([(4, "two", "x")], CASES))
    state = files(table)
    assert table.upsert(1, spark.createDataFrame([(4, "one", "x")], CASES)) == [] and files(table) == state
    assert table.upsert(3, spark.createDataFrame([], CASES)) == [] and files(table) == state


def test_a_change_that_stopped_is_taken_up(spark, tmp_path, monkeypatch):
    from caseflow.sources import keyed

    table = made(spark, tmp_path / "t")
    monkeypatch.setattr(keyed, "drop_folder", lambda path: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        table.upsert(1, spark.createDataFrame([(5, "v1", "x")], CASES))
    monkeypatch.undo()
    os.remove(f"{table.path}/done/change=1/_SUCCESS")  # as if it stopped in the middle of putting partitions in place
    part = next(d for d in files(table) if os.path.isdir(f"{table.path}/aside/change=1/{d}"))
    for f in os.listdir(f"{table.path}/rows/{part}"):
        os.remove(f"{table.path}/rows/{part}/{f}")
    # the rows come from what was written aside, not from the damaged table
    table.upsert(1, spark.createDataFrame([(5, "other", "x")], CASES))
    rows = {r["case_id"]: r["v"] for r in table.read(spark).collect()}
    assert len(rows) == 200 and rows[5] == "v1"


def test_late_values_fill_blanks_alone(spark, tmp_path):
    table = made(spark, tmp_path / "t", parts=4)
    late = spark.createDataFrame([(2, "late"), (2, " "), (3, "never"), (999, "none")], "case_id long, v string")
    late.coalesce(1).write.parquet(str(tmp_path / "late"))
    before = files(table)
    jobs.late_enrichment(table, spark.readStream.schema(late.schema).parquet(str(tmp_path / "late")), ["v"], str(tmp_path / "cp")).awaitTermination()
    rows = {r["case_id"]: r["v"] for r in table.read(spark).collect()}
    assert len(rows) == 200 and rows[2] == "late" and rows[3] == "old" and {v for k, v in rows.items() if k % 2 == 0 and k != 2} == {" "}
    assert sum(before[d] != x for d, x in files(table).items()) <= 3


def test_one_field_by_key(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    touched = worklog.set_field(spark, table, 1, 7, "v", "changed")
    assert len(touched) == 1 and {r["case_id"] for r in table.read(spark).where("v = 'changed'").collect()} == {7}
    with pytest.raises(ValueError):
        worklog.set_field(spark, table, 2, 7, "case_id", 1)


# ---- documents that fail


def work(poison):
    def extract(pages):
        bad = F.col("text").isin(*poison)
        return pages.select("doc_id", "page_no", F.when(bad, F.raise_error(F.lit("no such page"))).otherwise(F.upper("text")).alias("found"))

    return extract


def pages_of(spark, n=60):
    return spark.range(n).select((F.col("id") / 2).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("page_no"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


@pytest.mark.parametrize("poison", [["t7"], ["t0", "t1", "t31"]])
def test_failing_documents_are_rows_of_their_own(spark, tmp_path, poison):
    pages, target = pages_of(spark), str(tmp_path / "rows")
    pages.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    jobs.arriving_documents(stream(), work(poison), target, str(tmp_path / "cp")).awaitTermination()
    bad = {int(p[1:]) // 2 for p in poison}
    docs = {r["doc_id"]: r for r in jobs.settled_documents(spark, target).collect()}
    assert {k for k, r in docs.items() if r["status"] == "error"} == bad and len(docs) == 30
    assert all("no such page" in docs[k]["reason"] for k in bad)
    assert jobs.settled_rows(spark, target).where("status = 'ready'").count() == 60 - 2 * len(bad)
    counts = jobs.batch_counts(jobs.settled_documents(spark, target)).first()
    assert (counts["total"], counts["failed"], counts["extraction"]) == (30, len(bad), "partial_ready")
    jobs.settle(pages, work(poison), f"{target}/batch=0")  # a repeated batch
    assert jobs.settled_rows(spark, target).count() == 60 - 2 * len(bad) + len(bad)
    jobs.retry_failed(spark, target, pages, work(poison[1:]), 1)
    jobs.retry_failed(spark, target, pages, work([]), 2)
    after = {r["doc_id"]: (r["status"], r["attempt"]) for r in jobs.settled_documents(spark, target).collect()}
    assert {s for s, _ in after.values()} == {"ready"} and {k for k, (_, a) in after.items() if a} == bad
    assert jobs.batch_counts(jobs.settled_documents(spark, target)).first()["extraction"] == "ready"


def test_no_documents(spark, tmp_path):
    jobs.settle(pages_of(spark, 0), work([]), str(tmp_path / "rows/batch=0"))
    assert jobs.settled_documents(spark, str(tmp_path / "rows")).count() == 0
