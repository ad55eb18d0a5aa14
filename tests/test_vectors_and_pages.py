"""The vector table against full scans; page files read in ranges against whole files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import vectors
from caseflow.operators.vectors import VectorTable
from caseflow.sources import pages, tables


def clustered(spark, n=2000, dims=8, centres=20):
    rng = random.Random(4)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    rows = [(k, [m + rng.gauss(0, 0.15) for m in middle[k % centres]]) for k in range(n)]
    return spark.createDataFrame(rows + [(90001, None), (90002, [0.0] * dims), (90003, [1.0, 2.0]), (90004, [float("nan")] * dims)], "vec_id long, embedding array<float>")


def scan(rows, queries, n=5):
    import numpy as np

    held = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows.collect() if r["embedding"] and len(r["embedding"]) == 8}
    held = {k: v / np.linalg.norm(v) for k, v in held.items() if np.isfinite(v).all() and v.any()}
    ids = sorted(held)
    m = np.array([held[i] for i in ids])
    out = {}
    for q in queries:
        s = m @ held[q]
        out[q] = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != q][:n]
    return out


@pytest.mark.parametrize("most", [1_000_000, 120])
def test_lists_reach_the_recall_and_spare_most_rows(spark, tmp_path, most):
    rows = clustered(spark)
    table = VectorTable(str(tmp_path / "t"), lists=12, most=most).create(rows)
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    assert table.rows(spark).count() == 2000
    assert table.rows(spark).groupBy("list").count().agg(F.max("count")).first()[0] <= max(most, 12 * 120) and table.centres(spark).count() == table.rows(spark).select("list").distinct().count()
    asked = [k for k in range(0, 2000, 100)]
    want = scan(rows, asked)
    every = {}
    for r in table.search(queries, probes=1 << 20).orderBy("query_id", "rank").collect():
        every.setdefault(r["query_id"], []).append(r["key"])
    assert every == want
    table = table.calibrated(queries, 0.95)
    got = {(r["query_id"], r["key"]) for r in table.search(queries).collect()}
    recall = sum((q, k) in got for q, ks in want.items() for k in ks) / sum(map(len, want.values()))
    assert recall >= 0.9 and table.share_read(queries) < 0.4
    if most == 120:
        assert any("-" in r["list"] for r in table.centres(spark).collect())  # large lists were split again
    one = table.rows(spark, ["000"])._jdf.queryExecution().executedPlan().toString()
    assert "list" in one.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("share, block, narrow", [(4, 50, 96), (2, 10_000, 96), (4, 50, 4)])
def test_bounded_scores_lose_no_neighbour(spark, tmp_path, monkeypatch, share, block, narrow):
    """Many copies of one vector, so ties lie on the bound; the pairs meet in blocks, by a join without lambdas where vectors are narrow."""
    for name, value in {"SHARE": share, "BLOCK": block, "NARROW": narrow}.items():
        monkeypatch.setattr(vectors, name, value)
    rows = clustered(spark, 600).withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.array(*(F.lit(float(k)).cast("float") for k in range(1, 9)))).otherwise(F.col("embedding")))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    found = VectorTable(str(tmp_path / "t"), lists=4).create(rows).search(queries, probes=1 << 20)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["key"])
    assert got == scan(rows, range(0, 600, 20))
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ShuffledHashJoin" in x and "least" in x]
    assert joins and all(("lambda" in x) == (narrow < 8) for x in joins)


def test_few_or_no_vectors(spark, tmp_path):
    rows = clustered(spark, 3)
    table = VectorTable(str(tmp_path / "t")).create(rows)
    q = spark.createDataFrame([(0, [1.0] * 8)], "query_id long, q array<double>")
    assert [r["key"] for r in table.search(q, skip_self=False).orderBy("rank").collect()] != [] and table.rows(spark).count() == 3


# ---- pages


def text_of(rng, n):
    out = ["before any page "] if rng.random() < 0.5 else []
    for k in range(n):
        out.append(f"[P{rng.choice('ÁA')}GINA {k + 1}]\n" + rng.choice(["", "x", "é日𝒳 [PÁGINA y] ", "word " * rng.randrange(400)]) + rng.choice(["", "\n", " \t"]))
    return "".join(out)


def test_ranges_give_the_pages_of_whole_files(spark, tmp_path):
    rng = random.Random(8)
    for k in range(6):
        (tmp_path / f"f{k}.txt").write_text(text_of(rng, rng.randrange(40)))
    (tmp_path / "_hidden").write_text("[PÁGINA 1] no")
    want = sorted((os.path.basename(r["path"]), r["page_no"], r["text"]) for r in tables.read_page_files(spark, f"{tmp_path}/f*.txt").collect())
    for size in (7, 100, 1000, 1 << 20):
        got = [(os.path.basename(p), no, x) for k in range(6) for a in range(0, os.path.getsize(tmp_path / f"f{k}.txt"), size) for p, no, x in pages.pages_in(str(tmp_path / f"f{k}.txt"), a, a + size, block=rng.choice([300, 1000, 1 << 20]))]
        assert sorted(got) == want
    got = pages.read_pages(spark, str(tmp_path), rangeBytes="500")
    assert sorted((os.path.basename(r["path"]), r["page_no"], r["text"]) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() > 6


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    """64 MB, one page in it longer than a range."""
    with open(tmp_path / "big.txt", "w") as f:
        for k in range(4000):
            f.write(f"[PÁGINA {k + 1}]\n" + f"{k} " * (2000 if k != 17 else 4_000_000))
    rows = pages.read_pages(spark, str(tmp_path / "big.txt"), rangeBytes=str(4 << 20))
    assert rows.rdd.getNumPartitions() >= 8
    out = rows.select("page_no", F.length("text").alias("n"), F.left("text", F.lit(8)).alias("head")).orderBy("page_no").collect()
    assert [r["page_no"] for r in out] == list(range(1, 4001))
    assert all(r["n"] == (len(str(k)) + 1) * (2000 if k != 17 else 4_000_000) - 1 and r["head"].split()[0] == str(k) for k, r in enumerate(out))


def test_pages_as_a_stream(spark, tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    for k in range(3):
        (top / f"{k}.txt").write_text(f"[PÁGINA 1] a{k} [PÁGINA 2] b{k}")
        stream = pages.read_pages(spark, str(top), stream=True)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]
