"""Neighbours against brute force; extraction by held-out pages."""

from functools import lru_cache

import numpy as np
import pytest
from golden_pages import GOLDEN, SPARSE
from pyspark.sql import functions as F

from caseflow.llm import html_extract, neighbours


def brute(ids, x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        out[q] = [ids[i] for i in np.lexsort((ids, -np.round(s, 12)))[:k]]
    return out


def test_recall_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 5)
    got = {}
    for r in neighbours.query(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(int(k), rng.normal(size=8).tolist()) for k in range(100)]
    copies = [(1000 + k, good[0][1]) for k in range(40)]
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 7), (2004, [None] + [1.0] * 7), (None, [1.0] * 8), (2005, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(good + copies + bad, "vec_id long, embedding array<double>").withColumn("bucket", F.lit("clash"))
    out = neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    first = [r for r in out if r["query_id"] == 0]
    assert [r["vec_id"] for r in first] == [1000, 1001, 1002, 1003, 1004] and [r["rank"] for r in first] == [1, 2, 3, 4, 5]
    assert {r["query_id"] for r in out} == {0, 50, 1000}
    assert [r["vec_id"] for r in out if r["query_id"] == 1000] == [0, 1001, 1002, 1003, 1004]
    assert all(r["vec_id"] < 2000 for r in out)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema)
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.search(two, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert neighbours.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0


def test_rows_that_repeat_an_id_hide_no_other(spark):
    same, rng = [1.0, 2.0, 3.0], np.random.default_rng(4)
    rows = [(0, same)] + [(10, same)] * 9 + [(k, same) for k in (11, 12, 13, 14, 15)] + [(100 + k, rng.normal(size=3).tolist()) for k in range(20)]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [10, 11, 12, 13, 14]


def test_lots_are_bounded_and_change_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = neighbours.Settings(bucket_rows=64, lot_queries=5, lot_visits=40)
    got = [sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 4 == 0, s).collect())) for s in (neighbours.Settings(bucket_rows=64), small)]
    assert got[0] == got[1] and len(got[0]) == 500
    visits = F.transform(F.sequence(F.lit(1), F.col("id") % 3 + 1), lambda x: F.struct(x.alias("bucket"), F.lit(0).alias("part")))
    asked = spark.range(20_000).select((F.col("id") % 2).cast("int").alias("block"), F.col("id").alias("query_id"), visits.alias("visits"))
    dealt, loads = neighbours.in_lots(asked, neighbours.Settings(lot_queries=1000, lot_visits=1500))
    sizes = dealt.groupBy("block", "lot").agg(F.count("*").alias("n"), F.sum(F.size("visits")).alias("v")).collect()
    assert sum(r["n"] for r in sizes) == 20_000 and max(r["n"] for r in sizes) < 1300 and max(r["v"] for r in sizes) < 1950
    assert {(r["block"], r["lots"]) for r in loads.collect()} == {(0, 14), (1, 14)}


def test_calibration_visits_fewer_rows_and_keeps_recall(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.15 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = neighbours.Settings()
    index = neighbours.classes(df, s.k, "vec_id", "embedding")
    sample = df.where("vec_id % 150 = 1").selectExpr("vec_id AS query_id", "embedding AS qv").toPandas()
    choice = neighbours.calibrate(index, 3000, 16, sample, s)
    assert choice.recall >= 0.95 and choice.share < 0.15 and choice.functions > 0
    want, got = brute(np.arange(3000), x, range(0, 3000, 150), 5), {}
    for r in neighbours.search(df, F.col("vec_id") % 150 == 0, s).collect():  # queries that calibration didn't see
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def test_probes_start_at_home_and_differ():
    h = neighbours.Hashing(6, 5, neighbours.Settings())
    p = h.project(np.ones((1, 6)) / np.sqrt(6))[0, 0]
    slots = h.probes(p, 60)
    assert (slots[0] == np.floor(p)).all() and len({tuple(s) for s in slots}) == len(slots) == 60
    cost = [sum(min((p[i] - np.floor(p[i])) ** 2 if d < 0 else (np.floor(p[i]) + 1 - p[i]) ** 2, 9) * (d != 0) for i, d in enumerate(s - np.floor(p))) for s in slots]
    assert cost == sorted(cost)


@pytest.fixture(scope="module")
def chain():
    return trained()


def test_held_out_pages(chain):
    right = wrong = missed = 0
    for page, truth in html_extract.labelled_pages(150, seed=977):
        found = chain.label(html_extract.features_of(html_extract.blocks_of(page)))
        right += sum(a and b for a, b in zip(found, truth))
        wrong += sum(a and not b for a, b in zip(found, truth))
        missed += sum(b and not a for a, b in zip(found, truth))
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_articles_of_the_table(spark, sf_dir, chain):
    import html
    import re

    rows = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), chain, keep=("page_id", "url", "html")).collect()
    same = 0
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", p).replace("<b>", ""))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        same += r["text"] == "\n\n".join(filter(None, parts))
        assert r["n_chars"] == len(r["text"])
    assert same / len(rows) >= 0.95


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (None, []),
        ("", []),
        ("plain", ["plain"]),
        ("<p>a&amp;b &#233;&nbsp;x\n\n y<br>z</p>", ["a&b é x y z"]),
        ("<p>one<p>two<div>three", ["one", "two", "three"]),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", ["yes"]),
        ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ("<b><p>x</b>y</p>", ["xy"]),
        ("<head><title>t</title></head><body>a < b</body>", ["a < b"]),
        ("<p title='<p>'>q</p></div></section>", ["q"]),
        ("<p title=it's>One</p><p>Don't</p><p>x</p>", ["One", "Don't", "x"]),
        ("<p>x<y is text</p><p>a <b c", ["x<y is text", "a"]),
        ("<P CLASS = 'a' ID=b/>1</P><p a=\"1\"b='2'c>2</p >3<!-->4<!-- -- > --!>5</>6</ p>7<?php x ?>8<!x>9", ["1", "2", "3456789"]),
        ("&amp;lt; &lt;p&gt; &am<b>p;</b>", ["&lt; <p> &amp;"]),
        ("<a><div>in</div></a>out", ["in", "out"]),
        ("<svg><title>no</title><text>no</text></svg>yes<select><option>no</select>", ["yes"]),
        ("<noscript><p>no</p></noscript><iframe><p>no</iframe><x-card>a<i>b</i></x-card>c", ["ab", "c"]),
    ],
)
def test_blocks(page, blocks):
    assert [b.text for b in html_extract.blocks_of(page)] == blocks


@pytest.mark.parametrize(
    ("raw", "left"),
    [
        ("<script>for(i=0;i<n;i++){f(i)}</script>", []),
        ("<SCRIPT>if(a<b){x='</scripted>'}</Script >", []),
        ("<script>var a = '<!--';</script>", []),
        ("<script><!--\nf(i<n)\n//--></script>", []),
        ("<script><!-- <script>f()</script> no --></script>", []),
        ("<script>a = '<!-->'; b = '<script>'</script>", []),
        ("<style>a::before{content:'<b'}<!-- p{}</style>", []),
        ("<textarea>1 <b 2</textarea><title>x <y <!-- z</title>", []),
        ("<script>i<n</script", None),
        ("<style>never closed <p>", None),
    ],
)
def test_raw_text_ends_at_its_own_end_tag(raw, left):
    blocks = [b.text for b in html_extract.blocks_of(f"<p>before</p>{raw}<article><p>Main text</p></article>")]
    assert blocks == (["before"] if left is None else ["before", "Main text"])


@pytest.mark.parametrize("junk", ["<a ", "<y ", "</", "<b>", "<div><b>x</b>", "<div class=abc>x", "<a x='", "<!--", "<p>x<", "<a><div></a>x", "<svg>x</b>", "<body>x<head>", "<script>", "&#", "word "])
def test_a_megabyte_takes_seconds(junk):
    import time

    began = time.perf_counter()
    html_extract.main_text(junk * (1_000_000 // len(junk)), CHAIN_OF_ONE)
    assert time.perf_counter() - began < 20  # about 3 s; what is not linear takes minutes


CHAIN_OF_ONE = html_extract.Chain({"in=div": 0, "name=abc": 1, "stop": 2}, np.zeros((3, 2)))


def test_known_words_change_no_label(chain):
    for page, _ in html_extract.labelled_pages(60, seed=31):
        every = chain.label(html_extract.features_of(html_extract.blocks_of(page)))
        assert chain.label(html_extract.features_of(html_extract.blocks_of(page, chain.known))) == every


@pytest.mark.parametrize("name", list(GOLDEN))
def test_pages_written_by_hand(name):
    page, want = GOLDEN[name]
    assert html_extract.main_text(page, trained()).split("\n\n") == want


@pytest.mark.parametrize("name", list(SPARSE))
def test_pages_that_say_little_of_their_parts(name):
    page, want = SPARSE[name]
    assert html_extract.main_text(page, trained()).split("\n\n") == want


@pytest.mark.parametrize(("seen", "unseen"), [((88, 12, 0), (0, 0, 100)), ((88, 0, 12), (0, 100, 0))])
def test_families_of_layouts_that_training_never_saw(seen, unseen):
    chain = html_extract.train(html_extract.Settings(), html_extract.labelled_pages(1200, families=seen))
    found = hits = wanted = 0
    for page, labels in html_extract.labelled_pages(300, seed=99, families=unseen):
        got = chain.label(html_extract.features_of(html_extract.blocks_of(page, chain.known)))
        found, wanted, hits = found + sum(got), wanted + sum(labels), hits + sum(a and b for a, b in zip(got, labels))
    assert hits / found > 0.95 and hits / wanted > 0.95


@lru_cache(1)
def trained():
    return html_extract.train()


def test_pages_with_scripts_keep_their_text(spark, chain):
    article = "<article><h1>Title of it</h1><p>" + "A sentence with words, and more. " * 30 + "</p></article>"
    rows = [(k, "u", f"<html><body>{script}{article}<footer>© x</footer></body></html>") for k, script in enumerate(["", "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>var a = '<!--';</script>"])]
    out = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), chain).collect()}
    assert len(out[0]) > 900 and out[0] == out[1] == out[2]


def test_no_pages(spark, chain):
    none = html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), chain)
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]


def test_edge_pages(spark, chain):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<nav><a href=x>menu</a></nav>"), (3, "u", "<article><h1>Title of it</h1><p>" + "A sentence with words, and more. " * 3000 + "</p></article><footer>© x</footer>")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")), chain).collect()
    assert [r["text"] for r in out[:3]] == ["", "", ""] and out[3]["n_chars"] > 90_000 and "©" not in out[3]["text"]


def test_chain_path_is_the_best(chain):
    import itertools

    for page, _ in html_extract.labelled_pages(40, seed=5):
        rows = html_extract.features_of(html_extract.blocks_of(page))[:9]

        def total(path):
            s = chain.start[path[0]] + sum(chain.step[a, b] for a, b in zip(path, path[1:]))
            return s + sum(chain.weights[chain.index[f], y] for row, y in zip(rows, path) for f in row if f in chain.index)

        assert total(chain.label(rows)) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=len(rows)))))
