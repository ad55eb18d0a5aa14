"""Document structure: zones, pages, sections, chunks, and the merging of section rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import chains as C
from caseflow.functions import text as T
from caseflow.functions.grammar import either, spaced_letters
from caseflow.operators.classify import CLAIM, KINDS, NOTICE, ORDER, REPLY, RULING, Kind
from caseflow.operators.match import small


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- zones and pages


def select_zone(pages: DataFrame, first: Column | int = 35, last: Column | int = 15, most_chars: int = 120_000, marker: str = "[...]", doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(doc, text): the first and last pages of each document joined, with a marker where pages are left out."""
    w = Window.partitionBy(doc)
    rows = pages.withColumn("__total", F.max(page).over(w)).withColumn("__first", first if isinstance(first, Column) else F.lit(first)).withColumn("__last", last if isinstance(last, Column) else F.lit(last))
    rows = rows.where((F.col(page) <= F.col("__first")) | (F.col(page) > F.col("__total") - F.col("__last")))
    gap = (F.col("__first") + F.col("__last") < F.col("__total")) & (F.col(page) == F.col("__first"))
    body = F.concat(F.lit("[PAGE "), F.col(page).cast("string"), F.lit("]\n"), F.coalesce(text, F.lit("")), F.when(gap, F.lit(f"\n{marker}")).otherwise(""))
    joined = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), body.alias("t")))).alias("x"))
    return joined.select(doc, F.left(F.array_join(F.transform("x", lambda r: r["t"]), "\n"), F.lit(most_chars)).alias("text"))


def zone_sizes(file_bytes) -> tuple[Column, Column]:
    """First and last pages by file size: 35+15 up to 5 MB, 32+12 up to 10 MB, else 30+12."""
    mb = _c(file_bytes) / (1 << 20)
    return F.when(mb <= 5, 35).when(mb <= 10, 32).otherwise(30), F.when(mb <= 5, 15).otherwise(12)


def text_density(pages: DataFrame, least: int = 200, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """characters per page and whether the document is a scan."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.sum(n).alias("chars")).withColumn("density", F.col("chars") / F.col("pages")).withColumn("is_scanned", F.col("density") < least)


def classify_pages(pages: DataFrame, kinds: DataFrame, least: int = 200, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Per document the pages of each kind (by keyword), the scanned pages, all in order."""
    body = pages.select(doc, page, T.fold(text, "lower").alias("__b"), T.scanned(F.length(F.trim(text)), least).alias("__scanned"))
    words = small(kinds.select("kind", T.fold("keyword", "lower").alias("keyword")))
    by_kind = body.join(words, F.contains(F.col("__b"), F.col("keyword"))).groupBy(doc, "kind").agg(F.array_sort(F.collect_set(page)).alias("pages"))
    maps = by_kind.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "pages")))).alias("pages_by_kind"))
    scans = body.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("__scanned"), F.col(page)))).alias("scanned_pages"), F.max(page).alias("total_pages"))
    return scans.join(maps, doc, "left")


def scanned_candidates(scanned) -> Column:
    """All if ten or fewer, else the first five and three from one third on."""
    s = _c(scanned)
    third = F.slice(s, (F.size(s) / 3).cast("int") + 1, 3)
    return F.when(F.size(s) <= 10, s).otherwise(F.array_union(F.slice(s, 1, 5), third))


def page_shares(scanned, kinds: Column) -> Column:
    """Scanned pages in equal blocks, one for each kind in order."""
    s, n = _c(scanned), F.size(kinds)
    block = F.greatest(F.lit(1), (F.size(s) / F.greatest(n, F.lit(1))).cast("int"))
    return F.transform(kinds, lambda k, i: F.struct(k.alias("kind"), F.slice(s, (i * block + 1).cast("int"), block).alias("pages")))


#: Usual places of annexes as a share of the pages.
USUAL_RATIO = {"ctps": 0.82, "payslip": 0.87, "termination_form": 0.77}


def candidate_pages(total, mean_ratio, samples, kind) -> Column:
    """U4: mean - 2, mean, mean + 2 from history of three samples or more, else the usual place and its neighbours, within the pages."""
    total, kind = _c(total), _c(kind)
    usual = reduce(lambda acc, kv: acc.when(kind == kv[0], F.lit(kv[1])), USUAL_RATIO.items(), F.when(F.lit(False), F.lit(0.0)))
    known = F.coalesce(_c(samples), F.lit(0)) >= 3
    mid = F.when(known, F.floor(_c(mean_ratio) * total)).otherwise(F.floor(usual * total)).cast("int")
    step = F.when(known, 2).otherwise(1)
    clamp = lambda p: F.greatest(F.lit(1), F.least(p, total)).cast("int")
    return F.when(mid.isNotNull(), F.array_sort(F.array_distinct(F.array(clamp(mid - step), clamp(mid), clamp(mid + step)))))


def expand_range(first, last, most: int = 5) -> Column:
    """U5"""
    return F.when(_c(last) >= _c(first), F.slice(F.sequence(_c(first), _c(last)), 1, most)).otherwise(F.array(_c(first)))


def bookmark_pages(bookmarks: DataFrame, kinds: list[tuple[str, str]], doc: str = "doc_id") -> DataFrame:
    """The first bookmark of each kind per document."""
    kind = T.first_match("title", kinds)
    return bookmarks.withColumn("kind", kind).where("kind is not null").groupBy(doc, "kind").agg(F.min_by("page_no", F.struct("ordinal", "page_no")).alias("page_no"))


def contents_entries(pages: DataFrame, kinds: list[tuple[str, str]], edge: int = 6, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(doc, kind, pages): entries "label ..... 12" or "label - p. 12 a 15" on the first and last pages."""
    total = F.max(page).over(Window.partitionBy(doc))
    near = pages.withColumn("__t", total).where((F.col(page) <= edge) | (F.col(page) > F.col("__t") - edge))
    line = near.select(doc, F.explode(F.split(F.coalesce(text, F.lit("")), r"\n")).alias("line"), F.col("__t").alias("total"))
    p = r"(?iu)^\s*(.{3,80}?)\s*(?:\.{2,}|\s[-–:]\s*(?:p[áa]g\.?|p\.|fls?\.?)?|\s{3,}|\s(?:p[áa]g\.?|p\.|fls?\.?))\s*(\d{1,4})(?:\s*(?:a|-|–)\s*(\d{1,4}))?\s*$"
    low = F.expr("try_cast(b as int)")
    found = line.select(doc, "total", T.first_match(F.regexp_extract("line", p, 1), kinds).alias("kind"), F.regexp_extract("line", p, 2).alias("b"), F.regexp_extract("line", p, 3).alias("e")).where("kind is not null and b <> ''")
    found = found.withColumn("first", low).withColumn("last", F.coalesce(F.expr("try_cast(e as int)"), low)).where("first between 1 and total")
    return found.groupBy(doc, "kind").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(expand_range(F.col("first"), F.col("last")))))), 1, 5).alias("pages"))


def page_plan(needed: DataFrame, bookmark: DataFrame, contents: DataFrame, history: DataFrame, totals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The pages to read for each (doc, kind): from bookmarks, else contents, else history or the usual place."""
    plan = needed.select(doc, "kind").distinct().join(totals.select(doc, "total_pages"), doc)
    plan = plan.join(bookmark.select(doc, "kind", F.array("page_no").alias("p1")), [doc, "kind"], "left").join(contents.select(doc, "kind", F.col("pages").alias("p2")), [doc, "kind"], "left")
    plan = plan.withColumn("bucket", T.size_bucket("total_pages")).join(history.select("kind", "bucket", "mean_ratio", "samples"), ["kind", "bucket"], "left")
    p3 = candidate_pages("total_pages", "mean_ratio", "samples", "kind")
    source = F.when(F.col("p1").isNotNull(), "bookmark").when(F.col("p2").isNotNull(), "contents").when(F.coalesce("samples", F.lit(0)) >= 3, "history").when(p3.isNotNull(), "usual")
    return plan.select(doc, "kind", F.coalesce("p1", "p2", p3).alias("pages"), source.alias("source"))


def restricted_text(pages: DataFrame, plan: DataFrame, most: int = 8, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(doc, kind, text): the planned pages' text, in the plan's order."""
    wanted = plan.select(doc, "kind", F.posexplode(F.slice(F.array_distinct("pages"), 1, most)).alias("rank", page))
    met = wanted.join(pages.select(doc, page, text), [doc, page])
    return met.groupBy(doc, "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(text, F.lit("")).alias("t")))), lambda r: r["t"]), "\n").alias("text"))


# ---- sections


def line_positions(text) -> Column:
    """array<struct<start, line>>: running sums of line lengths."""
    lines = F.split(F.coalesce(_c(text), F.lit("")), r"\n")
    return T.running_rows(lines, lambda x: F.length(x) + 1, lambda a, b: a + b, F.lit(0), lambda at, x: F.struct(at.alias("start"), x.alias("line")))


def headings(kind: Kind) -> str:
    """How a part of this kind begins: with its title, whose letters may stand apart, with its act, or with the address of its reader."""
    spaced = "|".join(spaced_letters(t.replace(" ", "")) for t in kind.titles if " " not in t)
    opening = {NOTICE.key: kind.acts, RULING.key: kind.actors[-3:], CLAIM.key: kind.actors[:2]}.get(kind.key, ())
    return "|".join(filter(None, (spaced, either(*kind.titles, *opening))))


#: A line of its own that opens an order, and the head of another case.
_VISTOS, _OTHER_CASE = r"vistos\W*(?:etc\W*)?$", r"(?:processo|autos)\s+(?:n\w?\W{0,2}\s*)?\d"
#: What a line begins with where a new part starts, and the part's kind.
BREAKS = (
    *((headings(kind), kind.key) for kind in KINDS),
    (either("decisão", "despacho", "conclusão") + "|" + _VISTOS, ORDER.key),
    (either("intimação", "mandado", "edital"), NOTICE.key),
    (either("impugnação", "defesa", "resposta à"), REPLY.key),
    (_OTHER_CASE, "novo_processo"),
)


def section_breaks(text, breaks=BREAKS) -> Column:
    """array<struct<start, kind>> of lines behind the first that begin a part."""

    def kind(line: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for p, k in breaks:
            out = out.when(line.rlike(rf"(?iu)^\s*(?:{p})"), F.lit(k))
        return out

    marked = F.transform(line_positions(text), lambda r: F.struct(r["start"].alias("start"), kind(r["line"]).alias("kind")))
    return F.filter(marked, lambda r: r["kind"].isNotNull() & (r["start"] > 0))


def thin_breaks(positions, gap: int = 200) -> Column:
    """A position stays only if it lies more than ``gap`` behind the last one that stayed."""
    return C.bound(F.array_sort(_c(positions)), lambda ps: F.transform(C.spaced(ps, gap), lambda k: F.get(ps, k).cast("int")))


def section_spans(docs: DataFrame, breaks: str = "breaks", text: str = "text", keep: str = "doc_id", least: int = 100) -> DataFrame:
    """(keep, section_no, start, end, kind, text): from each break to the next; short ones go, but for the first."""
    b = F.col(breaks)
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit("inicio_documento").alias("kind")))
    every = F.when(F.size(b) == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit("documento_unico").alias("kind")))).when(b[0]["start"] > 0, F.concat(first, b)).otherwise(b)
    rows = docs.select(keep, F.coalesce(text, F.lit("")).alias("__t"), F.posexplode(every).alias("section_no", "b"))
    end = F.coalesce(F.lead("b.start").over(Window.partitionBy(keep).orderBy("section_no")), F.length("__t"))
    rows = rows.withColumn("end", end).withColumn("text", F.trim(F.substr("__t", F.col("b.start") + 1, F.col("end") - F.col("b.start"))))
    return rows.where((F.col("b.start") == 0) | (F.length("text") > least)).select(keep, "section_no", F.col("b.start").alias("start"), "end", F.col("b.kind").alias("kind"), "text")


def sections(docs: DataFrame, text: str = "text", keep: str = "doc_id", gap: int = 200) -> DataFrame:
    """Breaks, thinned, then spans."""
    found = C.bound(section_breaks(text), lambda b: F.transform(C.spaced(F.transform(b, lambda r: r["start"]), gap), lambda k: F.get(b, k)))
    return section_spans(docs.withColumn("breaks", found), text=text, keep=keep)


def merge_sections(rows: DataFrame, first: list[str] = [], longest: list[str] = [], distinct: list[str] = [], last: list[str] = [], key: str = "doc_id", order: str = "section_no") -> DataFrame:  # noqa: B006
    """One row per document: first non-blank, longest, first three distinct joined, last non-blank; and the number of rows."""
    out = [F.min_by(T.unblank(c), F.when(~T.blank(c), F.col(order))).alias(c) for c in first]
    # the longest value, the earliest of equal length
    out += [F.max_by(T.unblank(c), F.when(~T.blank(c), F.struct(F.length(c), -F.col(order)))).alias(c) for c in longest]
    out += [F.max_by(T.unblank(c), F.when(~T.blank(c), F.col(order))).alias(c) for c in last]
    for c in distinct:
        in_order = F.transform(F.array_sort(F.collect_list(F.when(~T.blank(c), F.struct(F.col(order).alias("o"), F.trim(c).alias("v"))))), lambda r: r["v"])
        same = lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v)))
        out.append(F.nullif(F.array_join(F.slice(F.aggregate(in_order, F.array().cast("array<string>"), same), 1, 3), ", "), F.lit("")).alias(c))
    return rows.groupBy(key).agg(*out, F.count("*").alias("num_sections")).withColumn("multi_document", F.col("num_sections") > 1)


# ---- chunks


def sentences(text) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"\.\s+"), lambda s: F.trim(s)), lambda s: s != "")


def chunks(docs: DataFrame, text: str = "text", keep: str = "doc_id", budget: int = 1000, overlap: int = 2, size=None) -> DataFrame:
    """(keep, chunk_no, content, token_count): sentences packed to a budget; a chunk begins with the last sentences of the one before.

    ``size`` maps a sentence to its tokens; words by default.
    """
    size = size or (lambda s: F.size(F.split(s, r"\s+")))

    def rows(xs: Column) -> Column:
        packs = C.packed(F.transform(xs, size), budget, overlap)
        return F.transform(packs, lambda p: F.struct(F.array_join(F.slice(xs, p["first"] + 1, p["end"] - p["first"]), ". ").alias("content"), p["total"].alias("token_count")))

    return docs.select(keep, F.posexplode(C.bound(sentences(text), rows)).alias("chunk_no", "c")).select(keep, "chunk_no", "c.content", "c.token_count")


def windows(docs: DataFrame, text: str = "text", keep: str = "doc_id", width: int = 20_000, step: int = 17_000) -> DataFrame:
    """(keep, window_no, content): overlapping character windows."""
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - (width - step)) / step)).cast("int")
    rows = docs.where(~T.blank(text)).select(keep, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window_no"))
    return rows.select(keep, "window_no", F.substr("__t", F.col("window_no") * step + 1, F.lit(width)).alias("content"))


def progressive_fill(rows: DataFrame, fields: list[str], key: str = "doc_id", order: str = "window_no") -> DataFrame:
    """The first non-blank value of each field over the windows."""
    return rows.groupBy(key).agg(*(F.min_by(T.unblank(f), F.when(~T.blank(f), F.col(order))).alias(f) for f in fields))


def analysis_rollup(chunk_rows: DataFrame, key: str = "doc_id", summary_chars: int = 8000, list_chars: int = 2000) -> DataFrame:
    """Joined summaries, distinct entities and concepts in order, totals."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.col(c).alias("v")))), lambda r: r["v"])
    rows = chunk_rows.groupBy(key).agg(ordered("summary").alias("s"), ordered("entities").alias("e"), ordered("concepts").alias("c"), F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens"))
    flat = lambda c: F.left(F.array_join(F.array_distinct(F.flatten(F.filter(c, lambda x: x.isNotNull()))), ", "), F.lit(list_chars))
    return rows.select(key, F.left(F.array_join(F.filter("s", lambda x: ~T.blank(x)), "\n"), F.lit(summary_chars)).alias("summary"), flat("e").alias("entities"), flat("c").alias("concepts"), "total_chunks", "total_tokens")
