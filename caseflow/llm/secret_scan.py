"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean query over trigrams (an OR of ANDs). The index holds a posting
(trigram, document) for every trigram that a rule asks for; a clause's candidates are the documents
in all of its postings. Candidates are verified by the regex itself. Rules without mandatory trigrams
scan every document.

Defined results: null text is empty and has no spans; rows that repeat a doc_id, null included, are
scanned one by one; spans are code points, end exclusive; other columns are ignored.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.llm._common import read, shielded, stash


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in their order. For runs, the least length may stand in the pattern.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public key formats.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# ---- trigram queries


def trigram_query(pattern: str, most: int = 64) -> frozenset[frozenset[str]]:
    """Clauses of which a match must satisfy one; a clause names the trigrams its text must hold, in lower case.

    An empty clause says nothing: the rule has no mandatory trigrams. ``most`` bounds the clauses; a part
    that would need more is treated as unknown text.
    """
    # a path: the trigrams so far, and the literal run that the next character continues
    Path = tuple[frozenset[str], str]

    def grown(path: Path, char: str) -> Path:
        grams, run = path
        run += char
        return (grams | {run[-3:]}, run) if len(run) >= 3 else (grams, run)

    def broken(paths: set[Path]) -> set[Path]:
        return {(grams, "") for grams, _ in paths}

    def members(items) -> set[str] | None:
        out: set[str] = set()
        for op, arg in items:
            if op is sre.LITERAL:
                out.add(chr(arg).lower())
            elif op is sre.RANGE and arg[1] - arg[0] < 8:
                out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if len(out) <= 5 else None

    def walk(nodes, paths: set[Path]) -> set[Path]:
        for op, arg in nodes:
            before = paths
            if op is sre.LITERAL:
                paths = {grown(p, chr(arg).lower()) for p in paths}
            elif op is sre.IN and (chars := members(arg)):
                paths = {grown(p, c) for p in paths for c in chars}
            elif op is sre.BRANCH:
                paths = set().union(*(walk(branch, paths) for branch in arg[1]))
            elif op is sre.SUBPATTERN:
                paths = walk(arg[-1], paths)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, body = arg
                if high == 1:
                    paths = walk(body, paths) | (paths if low == 0 else set())
                else:
                    for _ in range(min(low, 3)):
                        paths = walk(body, paths)
                    paths = broken(paths) if low else broken(before)
            elif op is not sre.AT:
                paths = broken(paths)
            if len(paths) > most:
                paths = broken(before)
        return paths

    clauses = {grams for grams, _ in walk(sre_parser.parse(pattern), {(frozenset(), "")})}
    return frozenset(c for c in clauses if not any(d < c for d in clauses))  # a weaker clause covers a stronger one


def has_trigrams(rule: Rule) -> bool:
    return frozenset() not in trigram_query(rule.pattern)


# ---- the index


def any_of(trigrams: list[str]) -> str:
    """A regex whose group 1 is, at each place of a text, the one of ``trigrams`` that begins there, in either case of a-z."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in sorted(trigrams):
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    one = lambda c: re.escape(c)
    ends = lambda cs: one(cs[0]) if len(cs) == 1 else f"[{''.join(map(one, cs))}]"
    middle = lambda below: "|".join(one(b) + ends(cs) for b, cs in below.items())
    return f"(?is)(?=({'|'.join(f'{one(a)}(?:{middle(below)})' for a, below in tree.items())}))"


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(trigram, doc_id) for every trigram that a rule asks for. Each text is read once, for all trigrams."""
    wanted = sorted({t for r in rules if has_trigrams(r) for clause in trigram_query(r.pattern) for t in clause})
    held = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(any_of(wanted)), F.lit(1)), F.lower)) if wanted else F.array().cast("array<string>")
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the documents whose postings satisfy a clause of a rule."""
    rows = []
    for rule in (r for r in rules if has_trigrams(r)):
        for n, clause in enumerate(sorted(map(sorted, trigram_query(rule.pattern)))):
            rows += [(rule.kind, n, t, 1 << k, (1 << len(clause)) - 1) for k, t in enumerate(clause)]
    asked = index.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, bit long, all_bits long")
    met = index.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
    full = met.groupBy("kind", "clause", "doc_id", "all_bits").agg(F.bit_or("bit").alias("bits")).where("bits = all_bits")
    return full.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))  # at most one entry a rule


# ---- verification


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches."""
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    long_enough = F.filter(T.matches_at(text, rule.pattern, rule.group), lambda m: F.length(m["value"]) >= max(1, rule.least))
    found = F.transform(long_enough, lambda m: F.struct(m["at"].cast("bigint").alias("start"), (m["at"] + m["size"]).cast("bigint").alias("end")))
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def _named(number: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _of_kind(number: int):
    return lambda s: s["kind_no"] == number


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id", name: str = "secrets") -> DataFrame:
    """All columns of ``docs`` and ``name``: array<struct<start, kind_no, end, kind>>, by start, then rule order."""
    return shielded(docs, (text, doc_id), lambda rows: _scanned(rows, rules, text, doc_id, name), name)


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text: str, doc_id: str, name: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    index = stash(postings(docs, rules, text, doc_id), "postings") if any(map(has_trigrams, rules)) else spark.createDataFrame([], "doc_id long, trigram string")
    found = candidates(index, rules).withColumnRenamed("doc_id", "__doc_id").withColumnRenamed("kinds", "__kinds")
    met = docs.join(found, docs[doc_id].eqNullSafe(found["__doc_id"]), "left").drop("__doc_id")
    each, body = [], F.coalesce(F.col(text), F.lit(""))
    for k, rule in enumerate(rules):
        spans = F.transform(spans_of(body, rule), _named(k, rule.kind))
        if has_trigrams(rule):
            spans = F.when(F.array_contains("__kinds", F.lit(rule.kind)), spans)
        each.append(F.coalesce(spans, F.array().cast("array<struct<start: bigint, kind_no: int, end: bigint, kind: string>>")))
    return met.withColumn(name, F.array_sort(F.concat(*each))).drop("__kinds")


def redact(text: Column, secrets: Column, mark: str = "[SECRET]", block: int = 256) -> Column:
    """``text`` with every span of ``secrets`` replaced; overlapping spans become one mark.

    Text is cut into blocks once, so what lies between two secrets is taken from its own blocks: a substring of the
    whole text would be counted from its start every time.
    """
    def between(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / block).cast("int")
        held = F.slice(blocks, first + 1, F.ceil(end / block).cast("int") - first)
        return F.when(end > start, F.substr(F.array_join(held, ""), (start - first * block + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    def redacted(x: Column) -> Column:
        blocks, spans = x["blocks"], x["spans"]
        # the text before a secret, unless the one before it reaches that far
        part = lambda at, s: F.when((s["start"] > at) | (at == 0), F.concat(between(blocks, at, s["start"]), F.lit(mark)))
        parts = T.running_rows(spans, lambda s: s["end"], F.greatest, F.lit(0).cast("bigint"), part)
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), between(blocks, end, x["size"]))

    whole = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("blocks"), secrets.alias("spans"), F.length(text).cast("bigint").alias("size"))
    return F.when(F.size(secrets) > 0, T.bind(whole, redacted)).otherwise(text)


def joined(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the secrets in every document."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind_no"] < len(BASE))
    counts = [F.size(F.filter("secrets", _of_kind(k))).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, rule in enumerate(RULES):
        p = "'" + rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]").replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0), 'n': length(w[i]), 'v': length(v[i])}})) AS m
  FROM (SELECT doc_id, regexp_split_to_array(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {rule.group}) AS v FROM d)""")
    least = " ".join(f"WHEN {k} THEN {max(1, r.least)}" for k, r in enumerate(RULES))
    word = "kind || ':' || cast(s AS bigint) || ':' || cast(e AS bigint)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT doc_id, k, kind, m.s AS s, m.s + m.n AS e FROM m WHERE m.v >= CASE k {least} END)
SELECT d.doc_id, count(f.k) FILTER (k = 0) AS n_assign, count(f.k) FILTER (k = 1) AS n_access, count(f.k) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg({word}, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({word}, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
