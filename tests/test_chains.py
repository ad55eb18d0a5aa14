"""Greedy walks by pointer doubling against the plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from caseflow.functions import chains as C
from caseflow.operators import structure


def plain_spaced(positions, gap):
    kept = []
    for k, p in enumerate(positions):
        if not kept or p - positions[kept[-1]] > gap:
            kept.append(k)
    return kept


def plain_chunks(sizes, budget, overlap):
    """(first, end, total) as a fold over the items packs them."""
    done, at, used = [], [], 0
    for k, n in enumerate(sizes):
        if at and used + n > budget:
            done.append(at)
            at = [*at[-overlap:], k] if overlap else [k]
            used = sum(sizes[i] for i in at)
        else:
            at.append(k)
            used += n
    return [(c[0], c[-1] + 1, sum(sizes[i] for i in c)) for c in [*done, *([at] if at else [])]]


def test_walks_equal_the_loops(spark):
    rng = random.Random(3)
    lists = [[], [5], [0, 0, 0], [0, 50, 190, 260, 900, 1000]] + [sorted(rng.randrange(3000) for _ in range(rng.randrange(90))) for _ in range(60)]
    sizes = [[], [7], [900], [1, 900, 1]] + [[rng.choice([1, 5, 30, 300]) for _ in range(rng.randrange(70))] for _ in range(60)]
    rows = spark.createDataFrame(list(zip(lists, sizes)), "p array<int>, n array<int>")
    for gap, budget, overlap in ((200, 100, 2), (0, 300, 0), (1000, 40, 1), (17, 1, 3)):
        got = rows.select("p", "n", C.spaced(F.col("p"), gap).alias("kept"), C.packed(F.col("n"), budget, overlap).alias("packs"), C.prefix_sums(F.col("n")).alias("sums")).collect()
        for r in got:
            assert r.kept == plain_spaced(r.p, gap)
            assert [tuple(x) for x in r.packs or []] == plain_chunks(r.n, budget, overlap)
            assert r.sums == [sum(r.n[:k]) for k in range(len(r.n) + 1)]


@pytest.mark.parametrize("text", [None, "", " . ", "one", "one. two three.  . four"])
def test_chunks_of_short_texts(spark, text):
    rows = structure.chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), budget=2).orderBy("chunk_no").collect()
    words = [s for s in ((text or "").strip() + " ").replace(".  .", ".").split(". ") if s.strip(" .")]
    assert len(rows) == len(plain_chunks([len(w.split()) for w in words], 2, 2))


def test_a_very_long_text_takes_seconds(spark):
    """200,000 sentences, and as many breaks: the cost must not be the square of their number."""
    rng = random.Random(9)
    sizes = [rng.randrange(1, 12) for _ in range(200_000)]
    text = ". ".join(" ".join(["w"] * n) for n in sizes)
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    structure.chunks(docs.limit(0), budget=200).count()
    began = time.time()
    rows = structure.chunks(docs, budget=200).orderBy("chunk_no").select("token_count", F.length("content").alias("n")).collect()
    want = plain_chunks(sizes, 200, 2)
    assert [r.token_count for r in rows] == [t for _, _, t in want]
    assert [r.n for r in rows] == [2 * t - (e - a) + 2 * (e - a - 1) for a, e, t in want]
    breaks = spark.range(1).select(structure.thin_breaks(F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda k: k * 7), 20).alias("b")).first()["b"]
    assert breaks == list(range(0, 1_400_000, 21))
    assert time.time() - began < 60
