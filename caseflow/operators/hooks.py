"""Where own code enters: field extractors, and enrichment of rows that rules left blank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.operators.quality import missing_any
from caseflow.operators.rules import Rule, RulePack
from caseflow.operators.structure import restricted_text


def custom_rule(field: str, make: Callable[[Column], Column], source: str = "text") -> Rule:
    """An own Column -> Column extractor for a field."""
    return Rule(field, "", source=source, column=make)


def with_custom(pack: RulePack, extractors: dict[str, Callable[[Column], Column]], first: bool = True) -> RulePack:
    return pack.with_rules(*(custom_rule(f, make) for f, make in extractors.items()), first=first)


def enrich_blank(rows: DataFrame, context: DataFrame, critical: list[str], fields: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], key: str = "doc_id") -> DataFrame:
    """``work`` sees only rows with a blank critical field, with their context, and fills blanks alone.

    ``work`` takes batches of rows with the context's columns and ``missing`` and returns key and fields as
    text. It may be a model's or a scanner's client; none is shipped. A context is a page plan's text, say.
    """
    missing = F.array_compact(F.array(*(F.when(T.blank(f), F.lit(f)) for f in fields)))
    asked = missing_any(rows, critical).select(key, missing.alias("missing")).join(context, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield work(b)[[key, *fields]]

    kind = rows.schema[key].dataType.simpleString()
    found = asked.mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{f} string" for f in fields))
    found = found.groupBy(key).agg(*(F.max(T.unblank(f)).alias(f"__{f}") for f in fields))
    met = rows.join(found, key, "left")
    return met.withColumns({f: F.coalesce(T.unblank(f), F.col(f"__{f}").cast(rows.schema[f].dataType)) for f in fields}).drop(*(f"__{f}" for f in fields))


def enrich_from_pages(rows: DataFrame, pages: DataFrame, plan: DataFrame, kinds: dict[str, str], critical: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], key: str = "doc_id") -> DataFrame:
    """As ``enrich_blank``, with the planned pages (E29: ``plan`` of key, kind, pages) of the kinds of those fields alone that are blank.

    ``kinds`` maps a field to the kind of page that tells it; ``work`` gets their text as ``text``, in the order of the
    kinds. Pages that no blank field asks for aren't read on, and rows without planned pages stay as they are.
    """
    order = {k: n for n, k in enumerate(dict.fromkeys(kinds.values()))}
    needed = F.array_compact(F.array(*(F.when(T.blank(f), F.lit(k)) for f, k in kinds.items())))
    asked = missing_any(rows, critical).select(key, F.explode(F.array_distinct(needed)).alias("kind"))
    told = restricted_text(pages, plan.join(asked, [key, "kind"], "left_semi"), doc=key)
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))["kind"]
    context = told.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("n"), "text"))), lambda r: r["text"]), "\n").alias("text"))
    return enrich_blank(rows, context, critical, list(kinds), work, key)


def _columns(p: str) -> dict[str, int]:
    """For each letter of ``p`` the places where it stands, as bits."""
    at: dict[str, int] = {}
    for k, c in enumerate(p):
        at[c] = at.get(c, 0) | 1 << k
    return at


def lcs_length(p: str, q: str) -> int:
    """Longest common subsequence, a column of the recurrence at a time.

    A zero bit marks a place of ``p`` where the length grows. One addition carries every match of a letter of ``q`` to the
    next such place, so a letter costs a few operations on whole words instead of one on each letter of ``p``.
    """
    if len(p) > len(q):
        p, q = q, p
    at = _columns(p)
    row = full = (1 << len(p)) - 1
    for here in map(at.get, q):
        if here:
            match = row & here
            row = (row + match | row ^ match) & full
    return len(p) - row.bit_count()


#: Letters from which a pair is worked out alone, and pairs that are worked out side by side.
LONG, ABREAST = 1024, 4096
#: Words of the match masks of pairs side by side; texts of very many different letters go in smaller groups.
MASKS = 1 << 23


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, with the text and the place of each."""
    sizes = np.array([len(x) for x in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _abreast(ps: list[str], qs: list[str]) -> np.ndarray:
    """``lcs_length`` of pairs of similar size, one letter of every second text at a time; a word holds 64 columns."""
    n, words = len(ps), -(-max(map(len, ps)) // 64)
    letter, owner, place = _letters(ps)
    alphabet, code = np.unique(letter, return_inverse=True)
    if n > 1 and n * (len(alphabet) + 1) * words > MASKS:
        return np.concatenate([_abreast(ps[: n // 2], qs[: n // 2]), _abreast(ps[n // 2 :], qs[n // 2 :])])
    masks = np.zeros((n, len(alphabet) + 1, words), np.uint64)  # the last letter stands for all that no first text has
    bits = np.uint64(1) << (place & 63).astype(np.uint64)
    np.bitwise_or.at(masks, (owner, code, place >> 6), bits)
    full = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(full, (owner, place >> 6), bits)
    letter, owner, place = _letters(qs)
    at = np.minimum(np.searchsorted(alphabet, letter), len(alphabet) - 1)
    second = np.full((n, max(map(len, qs))), len(alphabet))
    second[owner, place] = np.where(alphabet[at] == letter, at, len(alphabet))
    row, every = np.full((n, words), ~np.uint64(0)), np.arange(n)
    for k in range(second.shape[1]):
        here = masks[every, second[:, k]]
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            before = row[:, w]
            match = before & here[:, w]
            half = before + match
            whole = half + carry
            carry = ((half < before) | (whole < half)).astype(np.uint64)
            row[:, w] = whole | (before ^ match)
    return np.bitwise_count(full & ~row).sum(axis=1)


def lcs_lengths(ps: list[str], qs: list[str]) -> np.ndarray:
    """``lcs_length`` of many pairs."""
    out = np.zeros(len(ps), np.int64)
    pairs = [(q, p) if len(p) > len(q) else (p, q) for p, q in zip(ps, qs)]
    some = sorted((k for k, (p, _) in enumerate(pairs) if p), key=lambda k: len(pairs[k][1]))
    short = [k for k in some if len(pairs[k][1]) < LONG]
    for at in range(0, len(short), ABREAST):
        part = short[at : at + ABREAST]
        out[part] = _abreast([pairs[k][0] for k in part], [pairs[k][1] for k in part])
    for k in some[len(short) :]:
        out[k] = lcs_length(*pairs[k])
    return out


def _lcs_scores(ps: list[str], qs: list[str], least: float) -> np.ndarray:
    """2 x LCS / lengths; 0 where that doesn't reach ``least``, which the lengths alone often show."""
    total, lower = (np.array([f(len(p), len(q)) for p, q in zip(ps, qs)], np.float64) for f in (lambda a, b: a + b, min))
    out = np.where(total == 0, 1.0, 0.0)
    some = np.flatnonzero((total > 0) & (2 * lower >= least * total))
    out[some] = 2 * lcs_lengths([ps[k] for k in some], [qs[k] for k in some]) / total[some]
    return np.where(out >= least, out, 0.0)


def _partial_score(p: str, q: str, least: float) -> float:
    """The best score of the shorter text with a window of its length in the longer one, windows at the ends being shorter."""
    if len(p) > len(q):
        p, q = q, p
    if not p:
        return 0.0 if q else 1.0
    if p in q:
        return 1.0
    letters, n = set(p), len(p)
    windows = [q[max(0, end - n) : end] for end in range(1, len(q) + n)]
    # a best window ends with a letter of the shorter text, or begins with one where it runs out of the longer text
    windows = [w for end, w in enumerate(windows, 1) if w[-1 if end <= len(q) else 0] in letters]
    return float(_lcs_scores([p] * len(windows), windows, least).max(initial=0.0))


def lcs_ratio(pairs: DataFrame, a: str = "a", b: str = "b", name: str = "lcs", least: float = 0.0, partial: bool = False) -> DataFrame:
    """F16: 2 x longest common subsequence / lengths of the folded texts (0 below ``least``), for parity with LCS scorers.

    ``partial`` compares the shorter text with the windows of the longer one. The pairs are candidates of a blocking join.
    """

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_partial_score(p, q, least) for p, q in zip(x, y)] if partial else _lcs_scores(x.tolist(), y.tolist(), least), dtype="float64")

    return pairs.withColumn(name, score(T.fold(a), T.fold(b)))
