"""Names and labels against catalogues: exact, then containment, then similarity.

Catalogues are small tables. ``small`` broadcasts one only behind a count; above the bound Spark picks
the join. Distinct names are resolved once and joined back, so the cost follows names, not documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.operators.contain import contained

#: Rows, and bytes of their JSON, up to which a catalogue is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def _fits(df: DataFrame) -> bool:
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """For joins with a key: broadcast behind a check of its size; beyond it Spark picks the join."""
    return F.broadcast(df) if _fits(df) else df


def bounded(df: DataFrame, what: str) -> DataFrame:
    """For joins without a key, in which every row meets the whole catalogue: too large a catalogue is an error."""
    if not _fits(df):
        raise ValueError(f"{what} must be a catalogue of at most {BROADCAST_ROWS} rows and {BROADCAST_BYTES} bytes")
    return F.broadcast(df)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; the order must end in a tie-break."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def merge_alias_sources(*sources: DataFrame) -> DataFrame:
    """(alias, label) from sources in order of precedence; the first that knows an alias names it."""
    parts = [s.select(T.fold("alias").alias("alias"), "label", F.lit(k).alias("precedence")) for k, s in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return first_by(every.where("alias <> ''"), ["alias"], F.col("precedence"), F.col("label"))


def alias_containment(docs: DataFrame, aliases: DataFrame, weights: dict[str, int], keep: str = "doc_id", whole: str | None = None, whole_weight: int = 2) -> DataFrame:
    """The label whose alias a field contains; the heaviest field wins, the alias' ordinal breaks ties.

    Both sides are folded first; lists of any length meet the texts by their rare words or q-grams.
    """
    fields = dict(weights) | ({whole: whole_weight} if whole else {})
    # by union, not by an array of all fields: a share taken by key then folds only its own texts
    stacked = reduce(DataFrame.unionByName, (docs.select(F.struct(keep, F.lit(w).alias("weight")).alias("key"), T.fold(c).alias("body")) for c, w in fields.items()))
    named = aliases.select(T.fold("alias").alias("pattern"), F.struct("ordinal", "label").alias("payload"))
    return first_by(contained(stacked, named).select("key.*", "payload.*"), [keep], F.desc("weight"), F.col("ordinal"), F.col("label")).select(keep, "label", F.col("weight").alias("score"))


def _ranked_words(rows: DataFrame, keys: list[str], often: DataFrame) -> DataFrame:
    """``keys``, word, k, n: the words of each row, the rarest first, and their number."""
    each = rows.select(*keys, F.explode(F.array_distinct(T.tokens(keys[0]))).alias("word")).join(often, "word", "left")
    w = Window.partitionBy(*keys)
    return each.withColumn("k", F.row_number().over(w.orderBy(F.coalesce("times", F.lit(0)), "word"))).withColumn("n", F.count("*").over(w)).drop("times")


def _segment(length: Column, count: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of the i-th of ``count`` nearly equal segments."""
    start = F.floor(i * length / count)
    return start.cast("int"), (F.floor((i + 1) * length / count) - start).cast("int")


def _edits(length: Column, threshold: float) -> Column:
    """The most edits that a string of this length can be away from one that reaches the ratio."""
    return F.floor(F.floor(length / threshold + 1e-9) * (1 - threshold) + 1e-9).cast("int")


def similar_pairs(names: DataFrame, catalogue: DataFrame, threshold: float) -> DataFrame:
    """(name, entry): every pair whose token-set ratio can reach the threshold, and some more; nothing is capped.

    Words of one all in the other: then its rarest word is among the other's. Word overlap: the rarest
    ``n - ceil(threshold n) + 1`` words of both share one. Edit ratio of the sorted words: with at most ``k`` edits, one of
    ``k + 1`` segments of the entry stands in the name, at most ``k`` places away.
    """
    left, right = names.select("name").distinct(), catalogue.select(F.col("name").alias("entry")).distinct()
    often = right.select(F.explode(F.array_distinct(T.tokens("entry"))).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    a, b = _ranked_words(left, ["name"], often), _ranked_words(right, ["entry"], often)
    prefix = F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    met = lambda x, y: x.select("name", "word").join(y.select("entry", "word"), "word").select("name", "entry")
    pairs = met(a.where("k = 1"), b).unionByName(met(a, b.where("k = 1"))).unionByName(met(a.where(prefix), b.where(prefix)))

    joined = lambda c: T.fold(F.array_join(F.array_sort(F.array_distinct(T.tokens(c))), " "))
    e = right.select("entry", joined("entry").alias("s")).withColumn("size", F.length("s")).withColumn("edits", _edits(F.col("size"), threshold)).where("size > 0")
    start, size = _segment(F.col("size"), F.col("edits") + 1, F.col("i"))
    segments = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits")))).select("entry", "size", "i", F.substr("s", start + 1, size).alias("segment"))
    p = left.select("name", joined("name").alias("s")).withColumn("m", F.length("s")).where("m > 0")
    p = p.withColumn("size", F.explode(F.sequence(F.ceil(F.col("m") * threshold - 1e-9).cast("int"), F.floor(F.col("m") / threshold + 1e-9).cast("int"))))
    p = p.withColumn("edits", _edits(F.col("size"), threshold)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    shift = F.explode(F.sequence(F.greatest(-F.col("edits"), -start), F.least(F.col("edits"), F.greatest(F.col("m") - start - size, -start)))).alias("shift")
    p = p.select("*", shift).select("name", "size", "i", F.substr("s", start + F.col("shift") + 1, size).alias("segment")).distinct()
    return pairs.unionByName(p.join(segments, ["size", "i", "segment"]).select("name", "entry")).distinct()


def scored_candidates(names: DataFrame, catalogue: DataFrame, threshold: float) -> DataFrame:
    """(name, entry, label, ordinal, score): all pairs whose token-set ratio reaches the threshold."""
    pairs = similar_pairs(names, catalogue, threshold).withColumn("score", T.token_set_ratio("name", "entry")).where(F.col("score") >= threshold)
    return pairs.join(catalogue.select(F.col("name").alias("entry"), "label", "ordinal"), "entry")


def resolve_entity(names: DataFrame, catalogue: DataFrame, threshold: float = 0.85, name: str = "name", fallback: str | None = "title") -> DataFrame:
    """Rows of ``names`` with label, score and how (exact, similar, none).

    Exact folded equality first, then the best token-set similarity at or above the threshold, ties to
    the catalogue's order; else the name in title case, or null.
    """
    distinct = names.select(F.col(name).alias("name")).where(~T.blank(name)).distinct()
    entries = first_by(catalogue.withColumn("key", T.fold("name")), ["key"], F.col("ordinal"), F.col("label"))
    exact = distinct.withColumn("key", T.fold("name")).join(small(entries.select("key", "label")), "key").select("name", "label", F.lit(1.0).alias("score"), F.lit("exact").alias("how"))
    rest = distinct.join(exact.select("name"), "name", "left_anti")
    near = first_by(scored_candidates(rest, catalogue, threshold), ["name"], F.desc("score"), F.col("ordinal"), F.col("label")).select("name", "label", "score", F.lit("similar").alias("how"))
    found = exact.unionByName(near)
    out = names.join(found.withColumnRenamed("name", "__name"), names[name] == F.col("__name"), "left").drop("__name")
    out = out.withColumn("how", F.coalesce("how", F.lit("none")))
    return out.withColumn("label", F.coalesce("label", F.initcap(F.lower(F.trim(name))))) if fallback == "title" else out


def dictionary_enrich(df: DataFrame, dictionary: DataFrame, name: str, fields: list[str], threshold: float = 0.9) -> DataFrame:
    """Fields of the dictionary's entry equal or similar to the name, only where they are blank."""
    entries = dictionary.withColumn("label", F.struct(*(F.col(f).alias(f) for f in fields)))
    found = resolve_entity(df.select(name).distinct(), entries, threshold, name, fallback=None).where("label is not null").select(F.col(name).alias("__name"), F.col("label").alias("__entry"))
    met = df.join(found, df[name] == F.col("__name"), "left")
    return met.withColumns({f: F.coalesce(T.unblank(f), F.col(f"__entry.{f}")) for f in fields}).drop("__name", "__entry")


def label_by_key(df: DataFrame, catalogue: DataFrame, column: str, key: str, value: str, out: str, default: str | None = None, patterns: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Folded equality with a catalogue, then patterns, then a default."""
    named = small(first_by(catalogue.select(T.fold(key).alias("__k"), F.col(value).alias("__v")), ["__k"], F.col("__v")))
    met = df.join(named, T.fold(column) == F.col("__k"), "left")
    ladder = [F.when(T.fold(column, "lower").rlike(p), F.lit(v)) for p, v in patterns]
    return met.withColumn(out, F.coalesce(F.col("__v"), *ladder, F.lit(default))).drop("__k", "__v")


def region_by_code(df: DataFrame, regions: DataFrame, number: str, text: str | None = None) -> DataFrame:
    """The state of digits 15 and 16 of a case number.

    Regions of several states (``ufs``) score each: 10 for a place word of it in the text, 5 for its code
    as a word; the highest wins, ties go to the region's order.
    """
    code = F.when(F.length(T.digits(number)) == 20, F.substring(T.digits(number), 15, 2))
    met = df.withColumn("__code", code).join(small(regions.select(F.col("code").alias("__code"), F.col("uf").alias("__uf"), F.col("ufs").alias("__ufs"), F.col("place_words").alias("__words"))), "__code", "left")
    if text is None:
        return met.withColumn("region_state", F.coalesce("__uf", F.try_element_at("__ufs", F.lit(1)))).drop("__uf", "__ufs", "__words").withColumnRenamed("__code", "region_code")
    body = T.fold(text)

    def score(uf: Column) -> Column:
        words = F.coalesce(F.try_element_at(F.col("__words"), uf), F.array().cast("array<string>"))
        place = F.size(F.filter(words, lambda w: F.contains(body, T.fold(w)))) * 10
        return place + F.when(F.contains(F.concat(F.lit(" "), F.regexp_replace(body, "[^A-Z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), uf, F.lit(" "))), 5).otherwise(0)

    ranked = F.array_sort(F.transform("__ufs", lambda uf, k: F.struct((-score(uf)).alias("s"), k.alias("k"), uf.alias("uf"))))
    state = F.when(F.size("__ufs") > 1, F.try_element_at(ranked, F.lit(1))["uf"]).otherwise(F.coalesce("__uf", F.try_element_at("__ufs", F.lit(1))))
    return met.withColumn("region_state", state).drop("__uf", "__ufs", "__words").withColumnRenamed("__code", "region_code")


def resolve_position(df: DataFrame, positions: DataFrame, column: str, context: str, threshold: float = 0.85, default_context: str = "labour") -> DataFrame:
    """A synonym in its context (else the default context), then an official label, then the most similar one."""
    key = T.fold(column)
    syn = small(first_by(positions.select("context", T.fold("synonym").alias("s"), "label", "label_id"), ["context", "s"], F.col("label")))
    base = df.withColumn("__k", key).withColumn("__x", F.col(context))
    own = base.join(syn.select(F.col("context").alias("__x"), F.col("s").alias("__k"), F.col("label").alias("l1")), ["__x", "__k"], "left")
    usual = own.join(syn.where(F.col("context") == default_context).select(F.col("s").alias("__k"), F.col("label").alias("l2")), "__k", "left")
    official = first_by(positions.select(T.fold("label").alias("__k"), F.col("label").alias("l3")), ["__k"], F.col("l3"))
    met = usual.join(small(official), "__k", "left")
    labels = positions.select(F.col("label").alias("name"), "label").distinct().withColumn("ordinal", F.lit(1))
    rest = met.where(F.coalesce("l1", "l2", "l3").isNull() & (F.col("__k") != "")).select(F.col(column).alias("name")).distinct()
    near = first_by(scored_candidates(rest, labels, threshold), ["name"], F.desc("score"), F.col("label")).select(F.col("name").alias("__near"), F.col("label").alias("l4"))
    met = met.join(near, F.col(column) == F.col("__near"), "left").withColumn("position", F.coalesce("l1", "l2", "l3", "l4", F.nullif(F.col("__k"), F.lit(""))))
    ids = small(first_by(positions.select(F.col("label").alias("position"), F.col("label_id").alias("position_id")), ["position"], F.col("position_id")))
    return met.drop("__k", "__x", "l1", "l2", "l3", "l4", "__near").join(ids, "position", "left")


def option_score(wanted, option, preferred: tuple[str, ...] = ()) -> Column:
    """70 x word overlap; 100 for equality; +15 contained; +12 a preferred word; ordinals +50 or -100."""
    w, o = T.fold(wanted, "lower"), T.fold(option, "lower")
    base = F.floor(T.jaccard(T.tokens(wanted), T.tokens(option)) * 70).cast("int")
    score = F.when((w == o) & (w != ""), 100).when((w != "") & F.contains(o, w), base + 15).otherwise(base)
    liked = [F.contains(o, T.fold(F.lit(p), "lower")) for p in preferred]
    if liked:
        score = score + F.when(F.greatest(*(x.cast("int") for x in liked), F.lit(0)) > 0, 12).otherwise(0)
    a, b = T.ordinal_of(wanted), T.ordinal_of(option)
    return score + F.when(a.isNull() | b.isNull(), 0).when(a == b, 50).otherwise(-100)


def option_candidates(asked: DataFrame, options: DataFrame, threshold: int, preferred: tuple[str, ...] = ()) -> DataFrame:
    """(wanted, option) pairs among which the best option of every ``asked.wanted`` at or above the threshold is.

    ``options.option`` is a struct that begins with the order of the catalogue and has a ``text``. The score is bounded by
    what a pair has in common, so four lists hold all that can win:

    * options that hold the wanted text whole, by ``contained``;
    * pairs with one ordinal (first, second), by a shared word: any overlap beats the first such option without;
    * pairs with a word among the rarest ``n - ceil(least n) + 1`` of both: ``least`` is the word overlap that the
      threshold needs when only a preferred word can add to it;
    * of the options without any of that, which score by ordinal and preferred word alone, the first of each kind.
    """
    o = options.select("option", F.col("option.text").alias("text")).distinct()
    kind = lambda c: T.ordinal_of(c)
    liked = F.lit(False)
    for p in preferred:
        liked = liked | F.contains(T.fold("text", "lower"), T.fold(F.lit(p), "lower"))
    wordless = F.size(T.tokens("text")) == 0  # like another wordless text, as far as words go
    firsts = o.groupBy(kind("text").alias("kind"), liked.alias("liked"), wordless.alias("wordless")).agg(F.min("option").alias("option")).select("option")  # twelve rows at most
    whole = contained(o.select(F.col("option").alias("key"), T.fold("text", "lower").alias("body")), asked.select(T.fold("wanted", "lower").alias("pattern"), F.col("wanted").alias("payload")))
    pairs = asked.join(F.broadcast(firsts), F.lit(True)).select("wanted", "option")
    pairs = pairs.unionByName(whole.select(F.col("payload").alias("wanted"), F.col("key").alias("option")))

    words = lambda rows, key, c: rows.select(F.col(key), F.explode(F.array_distinct(T.tokens(c))).alias("word"))
    often = words(o, "option", "text").groupBy("word").agg(F.count("*").alias("times"))

    def ranked(rows: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key)
        each = rows.join(often, "word", "left")
        return each.withColumn("k", F.row_number().over(w.orderBy(F.coalesce("times", F.lit(0)), "word"))).withColumn("n", F.count("*").over(w))

    a, b = ranked(words(asked, "wanted", "wanted"), "wanted"), ranked(words(o, "option", "text"), "option")
    least = max(0, threshold - (12 if preferred else 0)) / 70
    rare = F.col("k") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    pairs = pairs.unionByName(a.where(rare).join(b.where(rare).select("option", "word"), "word").select("wanted", "option"))
    numbered = lambda rows, c: rows.withColumn("kind", kind(c)).where("kind is not null")
    one, other = words(numbered(asked, "wanted"), "wanted", "wanted"), words(numbered(o, "text"), "option", "text")
    same = one.join(other, "word").where(kind("wanted") == kind("option.text"))
    return pairs.unionByName(same.select("wanted", "option")).distinct()


def best_option(df: DataFrame, options: DataFrame, wanted: str, keys: list[str], threshold: int = 28, preferred: tuple[str, ...] = ()) -> DataFrame:
    """The option of highest score, ties to the catalogue's order; null below the threshold.

    Distinct wanted values meet the candidates that ``option_candidates`` leaves.
    """
    asked = df.select(F.coalesce(F.col(wanted), F.lit("")).alias("wanted")).distinct()
    met = option_candidates(asked, options.select(F.struct("ordinal", "value", "text").alias("option")), threshold, preferred)
    scored = met.withColumn("score", option_score("wanted", "option.text", preferred)).where(F.col("score") >= threshold)
    best = first_by(scored, ["wanted"], F.desc("score"), F.col("option"))
    best = best.select(F.col("wanted").alias("__w"), F.col("option.value").alias("option_value"), F.col("option.text").alias("option_text"), F.col("score").alias("option_score"))
    return df.join(best, F.coalesce(F.col(wanted), F.lit("")) == F.col("__w"), "left").drop("__w")


def distinct_names(names, threshold: float = 0.85) -> Column:
    """Of an array, in order: a name equal to, contained in, containing or similar to a kept one goes. Companies come first."""
    names = F.col(names) if isinstance(names, str) else names
    firm = lambda n: F.coalesce(T.person_type(n) == "juridica", F.lit(False))
    # an exact copy goes in any case; folded form and kind are computed once for each name
    entries = F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("name"), T.fold(n).alias("folded"), firm(n).alias("firm")))
    kind = "array<struct<name: string, folded: string, firm: boolean>>"

    def same(a: Column, b: Column) -> Column:
        x, y = a["folded"], b["folded"]
        return (x == y) | F.contains(x, y) | F.contains(y, x) | (T.folded_ratio(x, y) >= threshold)

    def kept(every: Column) -> Column:
        ordered = F.concat(F.filter(every, lambda n: n["firm"]), F.filter(every, lambda n: ~n["firm"]))
        return F.aggregate(ordered, F.array().cast(kind), lambda acc, n: F.when(F.exists(acc, lambda k: same(k, n)), acc).otherwise(F.concat(acc, F.array(n).cast(kind))))

    return F.transform(F.filter(T.bind(entries, kept), lambda n: n["folded"] != ""), lambda n: n["name"])


def primary_secondary(parties: DataFrame, priority: DataFrame, keys: list[str], name: str = "name", ordinal: str = "ordinal", longest_match: bool = False, threshold: float = 0.85) -> DataFrame:
    """The first two distinct names of a key by priority.

    A name takes the first entry of the list that contains it or that it contains (the longest with
    ``longest_match``), else the most similar one, else the last place; ties keep the order of arrival.
    """
    distinct = parties.select(F.col(name).alias("__name")).distinct()
    met = distinct.join(bounded(priority.select(F.col("name").alias("entry"), F.col("priority").cast("int").alias("priority")), "priorities"), F.lit(True))
    a, b = T.fold("__name"), T.fold("entry")
    inside = F.contains(a, b) | F.contains(b, a)
    close = T.ratio("__name", "entry")
    met = met.where(inside | (close >= threshold)).withColumn("inside", inside).withColumn("close", close)
    order = [F.desc("inside"), *([F.desc(F.length("entry"))] if longest_match else []), F.when(F.col("inside"), F.col("priority")), F.desc("close"), F.col("priority")]
    ranked = first_by(met, ["__name"], *order, F.col("entry")).select("__name", "priority")
    # few names make few groups: the join must not deal the parties by name; one exchange by key then serves both steps
    named = parties.select(*keys, name, ordinal).join(small(ranked), F.col(name) == F.col("__name"), "left").repartition(*keys)
    rows = first_by(named, [*keys, name], F.col(ordinal)).withColumn("priority", F.coalesce("priority", F.lit(999)))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("priority", ordinal))
    rows = rows.withColumn("__n", n).where("__n <= 2")
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("__n") == 1, F.col(name))).alias("primary"), F.max(F.when(F.col("__n") == 2, F.col(name))).alias("secondary"))


GIVEN = "array<struct<value: string, type_text: string, type_ordinal: bigint, keyword: string, category: string, priority: bigint, score: bigint>>"


def map_claims(claims: DataFrame, keywords: DataFrame, types: DataFrame, key: str = "doc_id", claim: str = "claim", ordinal: str = "ordinal", most: int = 30, enough: int = 5, close: float = 0.75, tried: int = 10, head: int = 100) -> tuple[DataFrame, DataFrame]:
    """(chosen, omitted) claim types per document.

    Types take turns in the catalogue's order. Each takes the first keyword (by ``ordinal``, if there is one, then name)
    that is not taken yet and has terms both in a claim and in the type's text; it scores 20 x the keyword's priority.
    Where that gives fewer than ``enough`` types, the first ``tried`` claims take turns: each takes the first type left
    whose partial ratio with the claim's first ``head`` characters reaches ``close``; it has priority 0. Chosen are the
    first ``most`` by priority, then score, then turn. Keywords may be many; types, which take turns, are a catalogue of bounded size.
    """
    at = F.col("ordinal") if "ordinal" in keywords.columns else F.lit(0)
    entry = F.struct(at.alias("k_ordinal"), "keyword", "category", F.col("priority").cast("bigint").alias("priority"))
    k = keywords.select(T.fold("term").alias("pattern"), entry.alias("payload"))
    t = types.select("value", F.col("text").alias("type_text"), F.col("ordinal").cast("bigint").alias("type_ordinal"))
    every = t.select(F.struct("type_ordinal", "value", "type_text").alias("key"), T.fold("type_text").alias("body"))
    words = contained(every, k).groupBy("key").agg(F.collect_set("payload.keyword").alias("fits"))
    fits = bounded(t, "types").join(words, F.struct("type_ordinal", "value", "type_text").eqNullSafe(F.col("key")), "left").drop("key").withColumn("fits", F.coalesce("fits", F.array().cast("array<string>")))
    every = fits.agg(F.array_sort(F.collect_list(F.struct("type_ordinal", "value", "type_text", "fits"))).alias("every"))
    said = contained(claims.select(F.col(key).alias("key"), T.fold(claim).alias("body")), k)
    named = said.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set("payload")).alias("keywords"))
    first = claims.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(ordinal, claim))).where(F.col("__n") <= tried)
    order = F.array_sort(F.collect_list(F.struct("__n", F.left(claim, F.lit(head)).alias("c"))))
    docs = first.groupBy(key).agg(order.alias("claims")).join(named, key, "left").join(F.broadcast(every), F.lit(True))  # every: one row
    free = lambda acc, x: ~F.exists(acc, lambda g: g["value"] == x["value"])

    def turn(acc: Column, kind: Column) -> Column:
        left = F.filter("keywords", lambda w: F.array_contains(kind["fits"], w["keyword"]) & ~F.exists(acc, lambda g: g["keyword"] == w["keyword"]))
        w = F.try_element_at(left, F.lit(1))
        return F.when(w.isNull() | ~free(acc, kind), acc).otherwise(F.concat(acc, _given(kind, w["keyword"], w["category"], w["priority"], w["priority"] * 20)))

    def near(acc: Column, c: Column) -> Column:
        close_by = F.filter(F.transform(F.filter("every", lambda x: free(acc, x)), lambda x: F.struct(x["value"].alias("value"), x["type_text"].alias("type_text"), x["type_ordinal"].alias("type_ordinal"), T.partial_ratio(x["type_text"], c["c"]).alias("ratio"))), lambda x: x["ratio"] >= close)
        first = F.try_element_at(close_by, F.lit(1))
        return F.when(first.isNull(), acc).otherwise(F.concat(acc, _given(first, F.lit(None), F.lit("fuzzy"), F.lit(0), F.round(first["ratio"] * 100))))

    by_word = F.coalesce(F.aggregate("every", F.array().cast(GIVEN), turn), F.array().cast(GIVEN))
    docs = docs.withColumn("__given", F.when(F.col("keywords").isNull(), F.array().cast(GIVEN)).otherwise(by_word))
    docs = docs.withColumn("__given", F.when(F.size("__given") >= enough, F.col("__given")).otherwise(F.aggregate("claims", F.col("__given"), near)))
    found = docs.select(key, F.posexplode("__given").alias("turn", "g")).select(key, "turn", "g.*")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), F.desc("score"), "turn"))).drop("turn")
    return ranked.where(F.col("rank") <= most), ranked.where(F.col("rank") > most)


def _given(kind: Column, keyword: Column, category: Column, priority: Column, score: Column) -> Column:
    row = F.struct(kind["value"].alias("value"), kind["type_text"].alias("type_text"), kind["type_ordinal"].alias("type_ordinal"), keyword.alias("keyword"), category.alias("category"), priority.alias("priority"), score.alias("score"))
    return F.array(row).cast(GIVEN)


def category_counts(mapped: DataFrame, key: str = "doc_id") -> DataFrame:
    """A12"""
    return mapped.groupBy(key, "category").agg(F.count("*").alias("n"))


def fill_gaps(df: DataFrame, options: dict[str, DataFrame], wanted: dict[str, str], preferred: dict[str, str], default: dict[str, str], threshold: float = 0.7) -> DataFrame:
    """Each field from its option catalogue, with ``evidence`` (source, value) and ``needs_review``.

    The preferred label if the wanted text holds it, else the best option at the threshold, else the default,
    which needs review. A field without a catalogue is an error.
    """
    missing = set(wanted) - set(options)
    if missing:
        raise ValueError(f"no option catalogue for {sorted(missing)}")
    out, evidence, review = df, [], []
    for name, column in wanted.items():
        out = best_option(out.withColumn("__asked", F.col(column)), options[name], "__asked", [], round(threshold * 100 * 0.7)).drop("__asked")
        liked = F.contains(T.fold(column), T.fold(F.lit(preferred.get(name, "\0")))) if name in preferred else F.lit(False)
        value = F.when(liked, F.lit(preferred.get(name))).otherwise(F.coalesce("option_text", F.lit(default.get(name))))
        source = F.when(liked, F.lit("preferred")).when(F.col("option_text").isNotNull(), F.lit("catalogue")).otherwise(F.lit("default"))
        out = out.withColumn(name, value).withColumn(f"__s_{name}", source).drop("option_value", "option_text", "option_score")
        evidence.append(F.struct(F.lit(name).alias("field"), F.col(f"__s_{name}").alias("source"), F.col(name).alias("value")))
        review.append(F.when(F.col(f"__s_{name}") == "default", F.lit(name)))
    return out.withColumn("evidence", F.array(*evidence)).withColumn("needs_review", F.array_compact(F.array(*review))).drop(*(f"__s_{n}" for n in wanted))


def defendants_or_stored(found: Column, stored: Column, second: Column) -> Column:
    """A list of one or none gives way to the stored adverse party and a different second client."""
    other = F.when(~T.blank(second) & (T.fold(second) != T.fold(F.coalesce(stored, F.lit("")))), second)
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 1, found).when(T.blank(stored), found).otherwise(F.array_compact(F.array(stored, other)))


def link_files(cases: DataFrame, listing: DataFrame) -> DataFrame:
    """A case's file: equal base name, else its batch folder and number digits in the path; the first by path."""
    files = listing.select(F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("base"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))
    exact = cases.join(files.select("path", "base"), cases["source_filename"] == F.col("base")).select("case_id", "path", F.lit(1).alias("tier"))
    by_folder = cases.where(F.length(T.digits("numero_processo")) >= 7).join(files, cases["batch_folder"] == files["folder"]).where(F.contains(T.digits("base"), F.left(T.digits("numero_processo"), F.lit(7)))).select("case_id", "path", F.lit(2).alias("tier"))
    best = first_by(exact.unionByName(by_folder), ["case_id"], F.col("tier"), F.col("path"))
    return cases.join(best, "case_id", "left")
