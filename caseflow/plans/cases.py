"""Composed plans: pages to typed case rows, and page-restricted re-extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as T
from caseflow.operators import classify, match, quality, structure
from caseflow.operators.rules import RulePack, extract


def post_process(cases: DataFrame, regions: DataFrame | None = None, parties: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """State by case number, client by party, cell by client, instance, unit number, secrecy; in this order."""
    out = cases
    if regions is not None:
        out = match.region_by_code(out, regions, "case_number")
        out = out.withColumn("state", F.coalesce(T.unblank("state"), "region_state")).drop("region_state")
    if parties is not None:
        out = match.resolve_entity(out, parties, name="defendant", fallback=None).withColumnsRenamed({"label": "client", "score": "client_score", "how": "client_how"})
        if cells is not None:
            out = match.label_by_key(out, cells, "client", "client", "cell", "cell", "Trabalhista")
    out = out.withColumn("instance", F.coalesce(T.unblank("instance"), F.when(T.ordinal_of("bench").isNotNull(), "Primeira Instância")))
    return out.withColumn("unit_number", F.when(~T.blank("bench"), T.unit_number("bench"))).withColumn("is_secret", F.coalesce(T.fold("text", "lower").rlike(r"segredo de justica"), F.lit(False)) if "text" in cases.columns else F.lit(False))


def extract_cases(pages: DataFrame, pack: RulePack, as_of: Column, regions: DataFrame | None = None, parties: DataFrame | None = None, cells: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Pages -> zone text -> rules -> typed dates -> consistency -> post-processing; one row per document."""
    first, last = structure.zone_sizes(F.coalesce(F.col("file_bytes"), F.lit(0)))
    text = structure.select_zone(pages, first, last)
    typed = text.withColumn("doc_type", classify.document_type("text"))
    rows = extract(typed, pack, keep=("doc_id", "doc_type"))
    rows = rows.select("*", F.col("doc_type.type").alias("type"), F.col("doc_type.confidence").alias("type_confidence")).drop("doc_type")
    if mask is not None:
        rows = classify.mask_fields(rows, mask, pack.fields())
    dates = {f: T.to_date_br(F.col(f)) for f in ("filing_date", "hire_date", "dismissal_date") if f in rows.columns}
    rows = rows.withColumns(dates)
    if len(dates) == 3:
        rows = quality.labour_dates(rows, "hire_date", "dismissal_date", "filing_date", as_of)
    if "hearing" in rows.columns:
        rows = rows.withColumn("hearing", F.try_to_timestamp("hearing", F.lit("dd/MM/yyyy HH:mm")))
        rows = quality.hearing_after_filing(rows, "hearing", "filing_date") if "filing_date" in rows.columns else rows
    if "salary" in rows.columns:
        rows = rows.withColumn("salary_value", T.money_to_decimal("salary"))
    return post_process(rows, regions, parties, cells)


def reextract(cases: DataFrame, pages: DataFrame, plan: DataFrame, pack: RulePack, kinds: dict[str, str], key: str = "doc_id") -> DataFrame:
    """Each missing field's rules on the planned pages of its kind; fills blanks only."""
    text = structure.restricted_text(pages, plan, doc=key)
    out = cases
    for kind in dict.fromkeys(kinds.values()):
        fields = [f for f, k in kinds.items() if k == kind]
        found = extract(text.where(F.col("kind") == kind), pack, fields=fields, keep=(key,), provenance=False)
        out = quality.baseline_fill(out, found, fields, key)
    return out
