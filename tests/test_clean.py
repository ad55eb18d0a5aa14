"""Cleaned texts: made once for all sources of a pack, and months repaired as by one regex after the other."""

import itertools

from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.operators import rules
from caseflow.packs import labour_br


def test_sources_share_the_cleaned_text(spark):
    docs = spark.createDataFrame([(1, "Distribuído em 05.03.2024\nsalário base: R$ 2.802,30\nPIS: 12345678901")], "doc_id long, text string")
    out = rules.extract(docs, labour_br.PACK, fields=["filing_date", "salary", "pis"], provenance=False)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[–—]") == 1
    assert tuple(out.first()) == (1, "05/03/2024", "R$ 2.802,30", "123.45678.90-1")


def test_months_are_repaired_as_by_one_regex_after_the_other(spark):
    words = ["ja nei ro", "JAN\teiro", "mar ço", "MARÇO", "mar\nc o", "ma io", "salário", "ju\r\nnho", "JU LHO", "Kelvin", "ab rıl", "a go ſto", "seTem bro", "de zem\x0bbro", "ou tu bro", "agora", "ma", "io", "ju", "fe ve rei ro", "no vem bro", ""]
    rows = spark.createDataFrame([(f"{a} {b}",) for a, b in itertools.product(words, words)] + [(f"{a}{b}",) for a, b in itertools.product(words, words)], "t string")
    plain = T.replace_all("t", ("[–—]", "-"), (r"\n{3,}", "\n\n"), *((f"(?iu){p}", m) for p, m in T.BROKEN_MONTHS), (" {2,}", " "), ("(?m)^ +| +$", ""))
    assert rows.where(~T.clean_text("t").eqNullSafe(F.trim(plain))).count() == 0
