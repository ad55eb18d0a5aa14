"""Plain searches before regexes: never stricter than the regex, and there for the rules of the labour pack."""

import re

from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.functions.grammar import signs
from caseflow.packs import labour_br
from caseflow.streaming import jobs


def test_signs_of_patterns():
    assert signs(r"(?iu)(?:dat[ao]|Prazo)\s+de\s") == (("dat", "prazo"), ("de",))
    assert signs(r"(?:abc)?\d+") == () and signs(r"a|bcd") == () and signs(r"(?:abc|\d)") == () and signs(r"[ab]cde(?=fgh)") == (("cde",),)
    assert signs(r"(ab+c){2}") == () and signs(r"(abc){0,2}x") == () and signs(r"\p{M}abc") == ()
    assert sum(bool(signs(r.pattern)) for r in labour_br.PACK.rules if r.pattern) > 70


def test_no_match_is_lost(spark):
    patterns = [r.pattern for r in labour_br.PACK.rules if r.pattern] + [labour_br.I + p for p in (*labour_br.JOB, *(p for p, _ in labour_br.DISMISSAL), *(m for m, _ in T.BROKEN_MONTHS))]
    texts = [
        "Data de distribuİção: 01/02/2024\nvalor da causa: R$ 10,00\nPıS/PASEP: 12345678901", "foı admitida em 03/04/2020, e diſpensado sem juſta causa em 05/06/2021", "AUDIÊNCIA UNA designada em 01/02/2024 às 9:30, prazo de 5 dias",
        "CTPS nº 12345 série 12, Carteira de trabalho 55555", "ABRİL mar ço JUNHO ja nei ro", "comarca de João Pessoa - PB; exercia a função de pedreiro", "Kelvin: K", "", "período: de 01/02/2020 a 03/04/2021",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", T.caseless("t"))
    lost = [F.count_if(F.col("t").rlike(p) & ~T.may_match(F.col("low"), p)).alias(f"c{k}") for k, p in enumerate(patterns)]
    found = [F.count_if(F.col("t").rlike(p)).alias(f"f{k}") for k, p in enumerate(patterns)]
    got = rows.agg(*lost, *found).first().asDict()
    assert not any(v for k, v in got.items() if k[0] == "c") and sum(v > 0 for k, v in got.items() if k[0] == "f") > 20


def test_every_failing_document_is_found(spark, tmp_path):
    """As many failing documents as there may be: a batch isn't given up after so many jobs."""
    rows = spark.range(300).select(F.col("id").alias("doc_id"))
    work = lambda b: b.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.raise_error(F.lit("unreadable"))).otherwise(F.lit("x")).alias("text"))
    jobs.settle(rows, work, str(tmp_path / "rows/batch=0"))
    got = {r["doc_id"]: (r["status"], "unreadable" in (r["reason"] or "")) for r in jobs.settled_documents(spark, str(tmp_path / "rows")).collect()}
    assert got == {k: ("error", True) if k % 5 == 0 else ("ready", False) for k in range(300)}
