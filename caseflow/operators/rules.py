"""Extraction by ordered rules: one projection over a corpus gives one typed row per document.

A rule belongs to a field and has a priority. The first rule of a field whose first match is accepted
gives the value; a match that its context vetoes makes way for the next rule, not for the next match,
unless the rule scans all matches. Every value comes with the id of its rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.functions.text import bind


@dataclass(frozen=True)
class Rule:
    field: str
    pattern: str
    group: int | tuple[int, ...] = 1
    source: str = "text"
    #: Characters of the source to look at, from its start.
    head: int | None = None
    veto: tuple[str, ...] = ()
    #: Characters on either side of a match in which a veto word counts.
    around: int = 50
    #: Near the text's start the neighbourhood reaches to the last match there (``text.context_of``), as that of one regex does.
    furthest: bool = False
    accept: Callable[[Column], Column] | None = None
    form: Callable[[Column], Column] | None = None
    #: ``form`` uses its argument once and gives blank or null for what isn't accepted, so it needs no binding.
    plain: bool = False
    scan_all: bool = False
    #: Or a rule of its own kind: columns of the source -> value.
    column: Callable[[Column], Column] | None = None
    #: Patterns without any of which ``column`` gives null.
    needs: tuple[str, ...] = ()

    def value(self, source: Column, low: Column | None = None) -> Column:
        """The accepted and formatted value, or null; ``low``: the ``caseless`` source, which spares regexes where a text can't match."""
        patterns = self.needs if self.column is not None else (self.pattern,)
        value = self._value(source)
        return F.when(T.may_match(low, *patterns), value) if low is not None and patterns else value

    def _value(self, source: Column) -> Column:
        if self.column is not None:
            return self.column(source)
        x = F.left(source, F.lit(self.head)) if self.head else source
        if self.scan_all:
            found = F.regexp_extract_all(x, F.lit(self.pattern), F.lit(self.group if isinstance(self.group, int) else self.group[0]))
            made = F.transform(found, self._formed)
            return F.try_element_at(F.filter(made, lambda v: v.isNotNull()), F.lit(1))
        groups = (self.group,) if isinstance(self.group, int) else self.group
        raw = T.some(F.concat_ws(" ", *(T.some(F.regexp_extract(x, self.pattern, g)) for g in groups)))
        value = self._formed(raw)
        if self.veto:
            words = "|".join(self.veto)
            near = T.context_of(x, self.pattern, self.around, self.furthest)
            value = bind(value, lambda v: F.when(v.isNotNull() & ~F.lower(near).rlike(f"(?u){words}"), v))
        return value

    def _formed(self, raw: Column) -> Column:
        form = self.form or F.trim
        if self.accept is None and (self.plain or self.form is None):
            return T.some(form(raw))
        return bind(raw, lambda r: bind(form(r), lambda v: F.when(self.accept(v) if self.accept else v != "", v)))


@dataclass(frozen=True)
class RulePack:
    """Rules in order, and the normalised sources that they read."""

    name: str
    rules: tuple[Rule, ...]
    sources: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    #: Sources made from another one, which is computed once for all of them: name -> (that one's name, how).
    derived: dict[str, tuple[str, Callable[[Column], Column]]] = field(default_factory=dict)

    def fields(self) -> list[str]:
        return list(dict.fromkeys(r.field for r in self.rules))

    def with_rules(self, *rules: Rule, first: bool = True) -> RulePack:
        """The pack with own rules before (or behind) its rules of the same fields."""
        return RulePack(self.name, (*rules, *self.rules) if first else (*self.rules, *rules), self.sources, self.derived)


_packs: dict[str, RulePack] = {}


def register(pack: RulePack) -> RulePack:
    _packs[pack.name] = pack
    return pack


def pack_named(name: str) -> RulePack:
    if name not in _packs:
        raise KeyError(f"no rule pack {name!r}; there are {sorted(_packs)}")
    return _packs[name]


def extract(docs: DataFrame, pack: RulePack, text: str = "text", fields: Iterable[str] | None = None, keep: tuple[str, ...] = ("doc_id",), provenance: bool = True) -> DataFrame:
    """``keep``, a column per field, and ``<field>_rule``: the number of the rule that gave the value."""
    wanted = list(fields or pack.fields())
    body = F.coalesce(F.col(text), F.lit(""))
    named = {"text": body} | {name: make(body) for name, make in pack.sources.items()}
    used = {r.source for r in pack.rules if r.field in wanted}
    own = {pack.derived[s][0] if s in pack.derived else s for s in used}
    base = docs.select(*keep, *(named[s].alias(f"__{s}") for s in sorted(own)))
    base = base.select("*", *(pack.derived[s][1](F.col(f"__{pack.derived[s][0]}")).alias(f"__{s}") for s in sorted(used) if s in pack.derived))
    base = base.select("*", *(T.caseless(f"__{s}").alias(f"__low_{s}") for s in sorted(used)))
    out = []
    for f in wanted:
        rules = [(k, r) for k, r in enumerate(r for r in pack.rules if r.field == f)]
        tried = [r.value(F.col(f"__{r.source}"), F.col(f"__low_{r.source}")).cast("string") for _, r in rules]
        if provenance:  # the rule's number stands before its value, so that one expression finds both
            tried = [F.concat(F.lit(f"{k:03d}"), v) for (k, _), v in zip(rules, tried)]
        out.append(F.coalesce(*tried).alias(f))
    found = base.select(*keep, *out)
    if not provenance:
        return found
    return found.select(*keep, *(F.substring(f, 4, 1 << 30).alias(f) for f in wanted), *(F.left(f, F.lit(3)).cast("int").alias(f"{f}_rule") for f in wanted))


def extract_all(docs: DataFrame, field_patterns: dict[str, str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, field, ordinal, value): every match of every pattern, in order, distinct within a document."""
    parts = [F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(0))), _tag(f)) for f, p in field_patterns.items()]
    exploded = docs.select(*keep, F.explode(F.concat(*parts)).alias("x"))
    return exploded.select(*keep, "x.field", "x.ordinal", "x.value")


def _tag(name: str):
    return lambda v, k: F.struct(F.lit(name).alias("field"), (k + 1).alias("ordinal"), v.alias("value"))


def line_window(text: Column, anchor: str, before: int, after: int) -> Column:
    """The lines from ``before`` above the first line that matches ``anchor`` to ``after`` below it; null if none does."""

    def window(lines: Column, at: Column) -> Column:
        start = F.greatest(at - before, F.lit(1))
        return F.when(at > 0, F.array_join(F.slice(lines, start.cast("int"), (at + after - start + 1).cast("int")), "\n"))

    place = lambda lines: F.array_position(F.transform(lines, lambda line: line.rlike(anchor)), True)
    found = bind(F.split(text, r"\n"), lambda lines: bind(place(lines), lambda at: window(lines, at)))
    return F.when(bind(T.caseless(text), lambda low: T.may_match(low, anchor)), found)


def anchored_value(text: Column, anchor: str, before: int, after: int, pattern: str, group: int = 0) -> Column:
    """The first match of ``pattern`` in the line window of ``anchor``."""
    return T.some(F.regexp_extract(line_window(text, anchor, before, after), pattern, group))


def last_of_all(text: Column, patterns: Iterable[str], clean: Callable[[Column], Column], ok: Callable[[Column], Column]) -> Column:
    """Hits of all patterns, cleaned, vetted and distinct; the last one."""
    hits = lambda low, p: F.when(T.may_match(low, p), F.regexp_extract_all(text, F.lit(p), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = bind(T.caseless(text), lambda low: F.concat(*(hits(low, p) for p in patterns)))
    return F.try_element_at(F.array_distinct(F.filter(F.transform(found, clean), ok)), F.lit(-1))


def guarded_first(text: Column, pattern: str, positive: str, negative: str, around: int = 200, group: int = 0) -> Column:
    """The first match with a positive marker and no negative one within ``around`` characters."""
    near = lambda m: F.substr(text, F.greatest(F.lit(1), m["at"] + 1 - around), F.least(F.lit(around), m["at"]) + F.length(m["value"]) + around)
    good = F.filter(T.matches_at(text, pattern), lambda m: near(m).rlike(positive) & ~near(m).rlike(negative))
    return F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(good, F.lit(1))["value"], F.lit("")), pattern, group), F.lit(""))


def union_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
