"""Sources, sinks and streams."""

import json

import pytest
from conftest import canonical
from pyspark.sql import functions as F

from caseflow.operators import rules
from caseflow.packs import labour_br
from caseflow.plans import cases
from caseflow.sources import tables
from caseflow.streaming import jobs


def test_catalogues(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"_note": {}, "acme": {"nome_cliente": "Acme", "partes": ["Acme SA", "Acme Ltda"], "celula": "C1"}}))
    assert sorted(map(tuple, tables.load_catalog(spark, str(tmp_path / "c.json")).collect())) == [("Acme Ltda", "Acme", "C1", 1), ("Acme SA", "Acme", "C1", 0)]
    (tmp_path / "r.json").write_text(json.dumps({"_x": {}, "13": {"estado": "Paraíba", "uf": "PB", "trt_nome": "TRT13", "variantes": ["pb"]}}))
    row = tables.load_region_map(spark, str(tmp_path / "r.json")).first()
    assert (row["code"], row["ufs"]) == ("13", ["PB"])
    (tmp_path / "o.json").write_text(json.dumps([{"value": "1", "text": "Ação Única"}]))
    options = tables.load_options(spark, str(tmp_path / "o.json"))
    assert options.first()["normalized"] == "acao unica"
    many = spark.createDataFrame([(k, str(9 - k), f"Opção {k}") for k in range(9)], "ordinal int, value string, text string").repartition(4)
    tables.save_options(many, str(tmp_path / "saved"))
    back = tables.load_options(spark, str(tmp_path / "saved")).orderBy("ordinal").collect()
    assert [tuple(r) for r in back] == [(k, str(9 - k), f"Opção {k}", f"opcao {k}") for k in range(9)]
    tables.save_options(tables.load_options(spark, str(tmp_path / "saved")), str(tmp_path / "again"))
    assert tables.load_options(spark, str(tmp_path / "again")).orderBy("ordinal").collect() == back
    two = {"b": {"partes": ["x", "y"]}, "a": {"partes": ["z"]}}
    (tmp_path / "two.json").write_text(json.dumps(two))
    assert [r["name"] for r in tables.load_catalog(spark, str(tmp_path / "two.json")).orderBy("ordinal").collect()] == ["x", "y", "z"]


def test_page_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("[PÁGINA 1]\none\n[PÁGINA 2]\ntwo")
    assert [(r["page_no"], r["text"]) for r in tables.read_page_files(spark, str(tmp_path)).orderBy("page_no").collect()] == [(1, "one"), (2, "two")]
    assert tables.file_listing(spark, str(tmp_path)).first()["length"] > 0


def test_cases_report_and_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, " x ", None)], "case_id int, cliente string, instancia string")
    tables.write_cases(df, str(tmp_path / "cases"))
    row = spark.read.parquet(str(tmp_path / "cases")).first()
    assert (row["instancia"], row["celula"], row["sistema_eletronico"]) == ("Primeira Instância", " x ", "PJE")
    assert tables.project_payload(df, {"client": "cliente"}, upper=("client",)).first()["client"] == "X"
    tables.write_report(df.withColumn("file", F.lit("f")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["data"]["case_id"] == 1


def _pages(spark):
    rows = [(1, 1, "Vara do Trabalho\nDistribuído em 05.03.2024", 10), (1, 2, "foi admitido em 01/02/2018\nfoi demitido sem justa causa em 05/06/2023", 10), (2, 1, "salário base: R$ 2.802,3", 10), (3, 1, None, None)]
    return spark.createDataFrame(rows, tables.SCHEMAS["page_text"])


def test_full_extraction(spark):
    out = {r["doc_id"]: r for r in cases.extract_cases(_pages(spark), labour_br.PACK, F.lit("2025-01-01").cast("date")).collect()}
    assert len(out) == 3
    assert (str(out[1]["hire_date"]), str(out[1]["dismissal_date"]), str(out[1]["filing_date"])) == ("2018-02-01", "2023-06-05", "2024-03-05")
    assert str(out[2]["salary_value"]) == "2802.30"


def test_reextraction_fills_blanks_only(spark):
    rows = spark.createDataFrame([(1, None, "kept"), (2, None, None)], "doc_id long, filing_date string, salary string")
    plan = spark.createDataFrame([(1, "form", [1]), (2, "form", [1])], "doc_id long, kind string, pages array<int>")
    out = cases.reextract(rows, _pages(spark), plan, labour_br.PACK, {"filing_date": "form", "salary": "form"})
    assert sorted(map(tuple, out.collect())) == [(1, "05/03/2024", "kept"), (2, None, "R$ 2.802,30")]


def _events(spark):
    rows = [(1, "a", "running", "m1", "2024-01-01 00:00:00"), (1, "b", "success", "m2", "2024-01-01 00:05:00"), (2, "a", "running", "m1", "2024-01-01 00:00:00"), (3, "z", "running", "m", "2024-01-01 03:00:00")]
    return spark.createDataFrame(rows, "case_id long, step string, status string, message string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_merged_stream_equals_batch(spark, tmp_path):
    e = _events(spark)
    e.where("message = 'm1'").write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    jobs.merge_states(str(tmp_path / "out"), stream, str(tmp_path / "cp")).awaitTermination()
    e.where("message <> 'm1'").write.parquet(str(tmp_path / "in/2"))
    jobs.merge_states(str(tmp_path / "out"), stream, str(tmp_path / "cp")).awaitTermination()
    got, want = jobs.read_states(spark, str(tmp_path / "out"), None), jobs.latest_state(e)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical([tuple(r) for r in want.collect()], want.columns)


def test_states_are_compacted_and_retained(spark, tmp_path):
    import os

    every = [(k, "s", "success" if k % 2 else "running", "m", f"2024-01-{k + 1:02d} 00:00:00") for k in range(20)]
    schema = "case_id long, step string, status string, message string, ts string"
    e = spark.createDataFrame(every, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(20):
        e.where(F.col("case_id") == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.merge_states(str(tmp_path / "out"), stream, str(tmp_path / "cp"), compact_every=4).awaitTermination()
    want = jobs.retained(jobs.latest_state(e), F.lit("2024-01-20").cast("timestamp"))
    got = jobs.read_states(spark, str(tmp_path / "out"))
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical([tuple(r) for r in want.collect()], want.columns)
    held = spark.read.parquet(*[f.path for f in os.scandir(tmp_path / "out/base") if f.name == "batch=19"])
    assert held.count() == want.count() and len(os.listdir(tmp_path / "out/base")) == 2 and len(os.listdir(tmp_path / "out/delta")) <= 8


def test_duplicates_of_one_time_have_a_first(spark):
    rows = [(1, "b", "2024-01-01"), (1, "a", "2024-01-01"), (1, "c", "2024-01-02"), (2, "z", "2024-01-01")]
    df = spark.createDataFrame(rows, "k int, v string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["k"], r["v"]) for r in jobs.deduplicated(df, ["k"]).collect()) == [(1, "a"), (2, "z")]


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from caseflow.sources import shared

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_work_tables_can_be_cleared(spark, tmp_path):
    import os

    from caseflow.operators.worklog import numbered
    from caseflow.sources import shared

    shared.clear_work()
    rows = numbered(spark.range(10), F.desc("id"))
    at = shared._made[-1].removeprefix("file:")
    rows.write.parquet(str(tmp_path / "out"))
    assert os.path.isdir(at) and shared.clear_work() == 1 and not os.path.exists(at) and shared.clear_work() == 0
    assert {(r["id"], r["place"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(k, 10 - k) for k in range(10)}


def test_state_stream_times_out(spark, tmp_path):
    e = _events(spark)
    for k, part in enumerate((e.where("case_id < 3"), e.where("case_id = 3"), e.where("case_id = 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = jobs.state_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: seen.extend(map(tuple, b.select("case_id", "status").collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert (1, "success") in seen and (2, "running") in seen and (2, "error") in seen
    assert (1, "error") not in seen


def test_arriving_documents_and_late_values(spark, tmp_path):
    p = _pages(spark)
    p.write.parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "pages"))
    jobs.arriving_documents(stream, lambda b: rules.extract(b, labour_br.PACK, fields=["filing_date"], keep=("doc_id", "page_no")), str(tmp_path / "rows"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rows")).where("filing_date = '05/03/2024'").count() == 1
    assert {r["status"] for r in jobs.settled_documents(spark, str(tmp_path / "rows")).collect()} == {"ready"}


def test_conversations_share_files(spark, sf_dir):
    """page files don't grow to one for each conversation."""
    from caseflow.plans import more

    rows = more.page_files(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert 0 < len(rows.inputFiles()) <= spark.sparkContext.defaultParallelism < docs == rows.select("doc_id").distinct().count()
