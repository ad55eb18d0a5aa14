"""Joins by an index against the same joins over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from caseflow.functions import text as T
from caseflow.operators import contain, match


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [100_000, 3])
def test_contained_patterns_equal_all_pairs(spark, few):
    rng = random.Random(few)
    word = lambda n: "".join(rng.choices("ABÇ ½𝒳\n.", k=n))
    texts = [(k, word(rng.randrange(120))) for k in range(300)] + [(900, None), (901, ""), (902, "A" * 5000)]
    patterns = [(word(rng.randrange(12)), k % 50) for k in range(300)] + [("", 1), ("A" * 300, 2), (None, 3)]
    t = spark.createDataFrame(texts, "key int, body string").repartition(3)
    p = spark.createDataFrame(patterns, "pattern string, payload int")
    got = contain.contained(t, p, few=few, share=2)
    found = set(map(tuple, got.collect()))
    assert found == {(k, x, y) for k, b in texts if b for x, y in patterns if x and x in b}
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert contain.contained(t, p.where("false")).count() == contain.contained(t.where("false"), p).count() == 0


def test_long_alias_lists_need_no_bound(spark):
    """200,000 aliases: an error before, now a join by q-grams."""
    aliases = spark.range(200_000).select(F.concat(F.lit("Client "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" SA")).alias("alias"), F.col("id").cast("string").alias("label"), F.col("id").alias("ordinal"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("party: client "), F.lpad((F.col("id") * 37).cast("string"), 6, "0"), F.lit(" sa, of somewhere")).alias("party"), F.lit("client 000007 SA").alias("text"))
    got = match.alias_containment(docs, aliases, {"party": 3}, whole="text")
    assert "NestedLoop" not in plan_of(got)
    rows = {r["doc_id"]: (r["label"], r["score"]) for r in got.collect()}
    assert rows == {k: (str(k * 37), 3) for k in range(300)}


@pytest.mark.parametrize("few", [100_000, 3])
@pytest.mark.parametrize("per_text", [0, 1, 1000])
def test_contained_phrases_equal_all_pairs(spark, few, per_text):
    """Patterns with inner words, frequent and rare, cut within words; all keyed by words, some, or none."""
    rng = random.Random(per_text)
    vocabulary = ["DE", "DA", "X", "", "SÃO", "𝒳Y", "A\tB", *("".join(rng.choices("ABC", k=4)) for _ in range(40))]
    phrase = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [(k, phrase(rng.randrange(30))) for k in range(200)] + [(900, None), (901, ""), (902, " "), (903, "DE " * 3000)]
    cut = lambda b: b[(s := rng.randrange(len(b) + 1)) : s + rng.randrange(1, 25)]
    patterns = [(cut(rng.choice(texts[:200])[1]), k % 7 or None) for k in range(200)] + [(phrase(3), 1) for _ in range(50)] + [(" DE DE ", 1), (" ", 2), ("  ", None), (None, 3)]
    t = spark.createDataFrame(texts, "key int, body string").repartition(3)
    p = spark.createDataFrame(patterns, "pattern string, payload int")
    got = contain.contained(t, p, few=few, share=2, per_text=per_text)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(k, x, y) for k, b in texts if b for x, y in patterns if x and x in b}
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_frequent_words_key_no_pattern(spark):
    """Aliases that share their inner word are keyed by q-grams; those with a rare one by it, and then no q-grams are made."""
    t = spark.range(64).select(F.col("id").alias("key"), F.concat(F.lit("OF K"), F.lpad("id", 6, "0"), F.lit(" TRADING COMPANY")).alias("body"))
    common = spark.range(3000).select(F.concat(F.lit("K"), F.lpad("id", 6, "0"), F.lit(" TRADING COMP")).alias("pattern"), F.col("id").alias("payload"))
    index, by_words, sizes = contain.index_of(t, common, 5, 1)
    assert not by_words and sizes == [5] and index.count() == 3000
    rare = spark.range(3000).select(F.concat(F.lit("F K"), F.lpad("id", 6, "0"), F.lit(" TRAD")).alias("pattern"), F.col("id").alias("payload"))
    index, by_words, sizes = contain.index_of(t, rare, 5, 1)
    assert by_words and sizes == [] and {r["gram"] for r in index.collect()} == {f"K{k:06d}" for k in range(3000)}
    for p in (common, rare):
        assert {tuple(r) for r in contain.contained(t, p, share=1).select("key", "payload").collect()} == {(k, k) for k in range(64)}


def test_contained_passages_make_each_body_once(spark, sf_dir):
    """A text is folded where it is read, in one scan, and its body isn't exchanged; before, three scans folded it and a join sorted it."""
    got = queries()["contained_passages"](spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("doc_id:bigint,text:string") == 1 and "SortMergeJoin" not in plan


def test_letters_equal_the_regex(spark):
    every = [(chr(k) + "a" + chr(k) * 2 + "Z",) for k in [*range(0x300), 0xFF21, 0x1E9E, 0x212A, 0x1D4B3, 0xFFFD]] + [("",), (None,), ("".join(map(chr, range(0x400))),)]
    df = spark.createDataFrame(every, "x string")
    assert df.where(~T.letters("x").eqNullSafe(F.regexp_replace("x", "[^a-zA-Z ]", " "))).count() == 0


@pytest.mark.parametrize("threshold, preferred", [(28, ()), (28, ("acao",)), (5, ("bolt", "x")), (60, ())])
def test_best_option_equals_all_pairs(spark, threshold, preferred):
    rng = random.Random(threshold)
    words = ["ação", "de", "cobrança", "1ª", "segunda", "vara", "bolt", "red", "x", "ab", "reac", "primeiro", "a"]
    phrase = lambda: " ".join(rng.choices(words, k=rng.randrange(6)))
    options = spark.createDataFrame([(str(k % 30), phrase(), k) for k in range(80)], "value string, text string, ordinal int")
    asked = spark.createDataFrame([(phrase(),) for _ in range(150)] + [(None,), ("",), ("ac",)], "wanted string").distinct()
    every = asked.select(F.coalesce("wanted", F.lit("")).alias("w")).distinct().crossJoin(options).withColumn("score", match.option_score("w", "text", preferred))
    want = match.first_by(every, ["w"], F.desc("score"), F.col("ordinal")).where(F.col("score") >= threshold)
    want = {r["w"]: (r["value"], r["text"], r["score"]) for r in want.collect()}
    got = match.best_option(asked, options, "wanted", [], threshold, preferred)
    assert {r["wanted"] or "": tuple(r[1:]) for r in got.collect() if r["option_value"]} == want
    pairs = match.option_candidates(asked.select(F.coalesce("wanted", F.lit("")).alias("wanted")).distinct(), options.select(F.struct("ordinal", "value", "text").alias("option")), threshold, preferred)
    assert pairs.count() < every.count()


def test_few_pairs_of_a_long_catalogue_are_scored(spark):
    options = spark.range(3000).select(F.col("id").cast("string").alias("value"), F.concat_ws(" ", F.lit("type"), F.concat(F.lit("n"), F.col("id").cast("string")), F.concat(F.lit("m"), (F.col("id") % 40).cast("string"))).alias("text"), F.col("id").alias("ordinal"))
    asked = spark.range(500).select(F.concat_ws(" ", F.lit("type"), F.concat(F.lit("n"), F.col("id").cast("string")), F.lit("mx")).alias("wanted"))
    pairs = match.option_candidates(asked, options.select(F.struct("ordinal", "value", "text").alias("option")), 28)
    assert pairs.count() < 500 * 3000 / 100
    rows = match.best_option(asked, options, "wanted", []).collect()
    assert all(r["option_value"] == r["wanted"].split()[1][1:] for r in rows)


def test_parties_are_not_dealt_by_their_few_names(spark):
    """five names would make five groups of all parties."""
    rows = spark.range(5000).select((F.col("id") % 900).alias("k"), F.concat(F.lit("Brand#"), (F.col("id") % 5).cast("string")).alias("name"), F.col("id").alias("ordinal"))
    priority = spark.createDataFrame([("BRAND#3", 0), ("brand#1", 1)], "name string, priority int")
    out = match.primary_secondary(rows, priority, ["k"], threshold=0.99)
    dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(name#" in x]
    assert not dealt and out.count() == 900
    assert out.where("k = 3").first()["primary"] == "Brand#3"


def test_date_rules_are_dealt_by_their_rows(spark, sf_dir, monkeypatch):
    """what a task holds doesn't grow with the table."""
    from conftest import same_as_sql

    from caseflow.plans import catalogue

    monkeypatch.setattr(catalogue, "TASK_ROWS", 500, raising=False)
    plan = catalogue.QUERIES["labour_date_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 12), REPARTITION_BY_NUM" in plan
    assert same_as_sql(spark, catalogue.QUERIES["labour_date_rules"], catalogue.ORACLES["labour_date_rules"], sf_dir) > 0
