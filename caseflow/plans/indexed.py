"""Registered queries of the index joins and of what is kept by key, each equal to SQL over all pairs or the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.operators import hooks, match, worklog
from caseflow.operators.vectors import VectorTable
from caseflow.plans.catalogue import _pages, query, t
from caseflow.plans.more import _place
from caseflow.sources import pages


@query(
    """
WITH RECURSIVE p AS (SELECT DISTINCT p_name AS x, 'blue steel ring' AS y FROM part),
g AS (SELECT x, y, 1 AS i, 0 AS j, [cast(0 AS bigint) FOR k IN range(0, length(y) + 1)] AS prev, [cast(0 AS bigint)] AS cur FROM p
  UNION ALL SELECT x, y, CASE WHEN j = length(y) THEN i + 1 ELSE i END, CASE WHEN j = length(y) THEN 0 ELSE j + 1 END, CASE WHEN j = length(y) THEN cur ELSE prev END,
    CASE WHEN j = length(y) THEN [cast(0 AS bigint)] ELSE list_append(cur, CASE WHEN x[i] = y[j + 1] THEN prev[j + 1] + 1 ELSE greatest(prev[j + 2], cur[j + 1]) END) END FROM g WHERE i <= length(x))
SELECT x AS p_name, round(2 * prev[length(y) + 1]::double / (length(x) + length(y)), 9) AS lcs FROM g WHERE i = length(x) + 1 AND j = 0"""
)
def lcs_scores(spark, sf_dir):
    """F16: all part names with one, by longest common subsequence; the SQL fills the table of the recurrence."""
    p = t(spark, sf_dir, "part").select("p_name").distinct().withColumn("y", F.lit("blue steel ring"))
    return hooks.lcs_ratio(p, "p_name", "y").select("p_name", F.round("lcs", 9).alias("lcs"))


_LETTERS = r"'[^a-zA-Z ]', ' ', 'g'), '\s+', ' ', 'g')))"


@query(
    rf"""
WITH a AS (SELECT item_id, trim(upper(regexp_replace(regexp_replace(left(text, 40), {_LETTERS} AS alias FROM benchmark),
d AS (SELECT doc_id, trim(upper(regexp_replace(regexp_replace(coalesce(text, ''), {_LETTERS} AS body FROM documents),
m AS (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS n FROM d JOIN a ON contains(body, alias))
SELECT doc_id, 'item ' || item_id AS label FROM m WHERE n = 1"""
)
def contained_passages(spark, sf_dir):
    """The heads of all benchmark passages as aliases in all documents."""
    aliases = t(spark, sf_dir, "benchmark").select(T.letters(F.left("text", F.lit(40))).alias("alias"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("label"), F.col("item_id").alias("ordinal"))
    docs = t(spark, sf_dir, "documents").select("doc_id", T.letters("text").alias("text"))
    return match.alias_containment(docs, aliases, {"text": 1}).select("doc_id", "label")


@query(
    """
WITH o AS (SELECT DISTINCT p_name AS text FROM part), w AS (SELECT DISTINCT p_type AS wanted FROM part),
s AS (SELECT wanted, text, len(list_intersect(string_split(lower(wanted), ' '), string_split(text, ' ')))::double / len(list_distinct(list_concat(string_split(lower(wanted), ' '), string_split(text, ' ')))) AS j FROM w, o),
b AS (SELECT wanted, text, cast(floor(70 * j) AS int) + CASE WHEN contains(text, lower(wanted)) THEN 15 ELSE 0 END AS score, row_number() OVER (PARTITION BY wanted ORDER BY cast(floor(70 * j) AS int) + CASE WHEN contains(text, lower(wanted)) THEN 15 ELSE 0 END DESC, text) AS n FROM s)
SELECT w.wanted AS p_type, b.text AS option_text, b.score AS option_score FROM w LEFT JOIN b ON b.wanted = w.wanted AND n = 1 AND score >= 10"""
)
def options_of_types(spark, sf_dir):
    """The part name most like each part type, of all part names."""
    p = t(spark, sf_dir, "part")
    options = p.select(F.col("p_name").alias("text")).distinct().select(F.col("text").alias("value"), "text", F.col("text").alias("ordinal"))
    return match.best_option(p.select("p_type").distinct(), options, "p_type", [], 10).select("p_type", "option_text", "option_score")


def _vector_table(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    return VectorTable(_place(spark, "vectors")).create(v), queries


@query(
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS key, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, cast(rank AS int) AS rank, key, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= 5"""
)
def indexed_vectors(spark, sf_dir):
    """The five nearest of every hundredth vector by the vector table, looking into all lists."""
    table, queries = _vector_table(spark, sf_dir)
    return table.search(queries, probes=1 << 20).withColumn("score", F.round("score", 9))


@query("SELECT count(*) AS queries, true AS recall_reached, true AS rows_spared FROM embeddings WHERE vec_id % 100 = 0")
def vector_recall(spark, sf_dir):
    """Whether the fewest lists that a sample of the queries needs give a recall of 0.9 over all of them, and spare rows."""
    table, queries = _vector_table(spark, sf_dir)
    table = table.calibrated(queries, 0.95)
    every, found = table.search(queries, probes=1 << 20).select("query_id", "key"), table.search(queries).select("query_id", "key").withColumn("hit", F.lit(1))
    recall = every.join(found, ["query_id", "key"], "left").agg(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).first()[0]
    return queries.agg(F.count("*").alias("queries")).select("queries", F.lit(recall >= 0.9).alias("recall_reached"), F.lit(table.share_read(queries) < 1).alias("rows_spared"))


@query("SELECT conv_id AS doc_id, cast(turn + 1 AS int) AS page_no, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM conversations")
def page_ranges_of_files(spark, sf_dir):
    """Conversations in a few large text files, read in ranges that cut through pages."""
    p, at = _pages(spark, sf_dir), _place(spark, "files")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("x")))), lambda r: F.concat(F.lit("[PÁGINA "), r["page_no"].cast("string"), F.lit("] #"), F.col("doc_id").cast("string"), F.lit("\n"), r["x"])), "\n")
    p.groupBy("doc_id").agg(body.alias("value")).select("value").repartition(3).write.text(at)
    rows = pages.read_pages(spark, at, rangeBytes="65536")
    head = r"^#(\d+)\s*"
    return rows.select(F.regexp_extract("text", head, 1).cast("long").alias("doc_id"), "page_no", F.regexp_replace("text", head, "").alias("text"))


@query("SELECT o_custkey AS case_id, o_orderkey AS number FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def cases_to_redo(spark, sf_dir):
    """The cases to extract again, the newest 50."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("number"))
    return worklog.recent(o, 50, at="number", key="case_id")


def _read_off(batch):
    return batch.assign(first=batch["text"].str[:9], last=batch["text"].str[-9:])


@query(
    """
WITH p AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY 1),
x AS (SELECT conv_id, n, 'page ' || lpad(cast(conv_id % 1000 AS varchar), 4, '0') AS head FROM p)
SELECT conv_id AS doc_id, CASE WHEN conv_id % 3 = 0 THEN 'known' ELSE head END AS first, CASE WHEN conv_id % 5 = 0 THEN 'known' ELSE 'turn ' || lpad(cast(n AS varchar), 4, '0') END AS last FROM x"""
)
def enriched_from_pages(spark, sf_dir):
    """Fields left blank are read off the pages that the plan names for them: the first page for one, the last for the other."""
    turns = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"))
    said = F.concat(F.lit("page "), F.lpad((F.col("doc_id") % 1000).cast("string"), 4, "0"), F.lit(" turn "), F.lpad((F.col("page_no") - 1).cast("string"), 4, "0"))
    docs = turns.groupBy("doc_id").agg(F.max("page_no").alias("n"), F.min("page_no").alias("m"))
    rows = docs.select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'known' END").alias("first"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'known' END").alias("last"))
    plan = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("cover").alias("kind"), F.array("m").alias("pages")), F.struct(F.lit("end").alias("kind"), F.array("n").alias("pages")))).alias("p")).select("doc_id", "p.*")
    return hooks.enrich_from_pages(rows, turns.withColumn("text", said), plan, {"first": "cover", "last": "end"}, ["first", "last"], _read_off)
