"""Completeness, consistency, provenance and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as T


def missing_any(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with a blank in any field."""
    return df.where(reduce(lambda a, b: a | b, (T.blank(f) for f in fields)))


def missing_fields(labels: dict[str, str]) -> Column:
    """Labels of the blank fields, in order."""
    return F.array_compact(F.array(*(F.when(T.blank(f), F.lit(label)) for f, label in labels.items())))


def with_completeness(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    return df.withColumn("missing", missing_fields(labels)).withColumn("is_complete", F.size("missing") == 0)


def missing_stats(df: DataFrame, fields: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """A2: total, and per field how many are blank, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(T.blank(f)).alias(f"missing_{f}") for f in fields))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """A9 per document: how many fields are filled."""
    return df.withColumn("filled", sum(((~T.blank(f)).cast("int") for f in fields), F.lit(0)))


def coverage_report(df: DataFrame, fields: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """A9 for a corpus: filled rows of each field."""
    return df.groupBy(*by).agg(F.count("*").alias("docs"), *(F.count_if(~T.blank(f)).alias(f"with_{f}") for f in fields))


def distribution(df: DataFrame, columns: list[str], k: int | None = None) -> DataFrame:
    """(column, value, n) in long form, from one scan; with ``k`` the most frequent of each column."""
    from pyspark.sql import Window

    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    counted = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    if k is None:
        return counted
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value")))).where(F.col("rank") <= k)


def reextract_stats(before: DataFrame, after: DataFrame, fields: list[str], key: str = "case_id") -> DataFrame:
    """A10: per field the blanks tried, filled and still blank."""
    b, a = before.select(key, *(F.col(f).alias(f"b_{f}") for f in fields)), after.select(key, *(F.col(f).alias(f"a_{f}") for f in fields))
    rows = b.join(a, key, "left").select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), T.blank(f"b_{f}").alias("tried"), T.blank(f"a_{f}").alias("blank")) for f in fields))).alias("x")).select("x.*")
    return rows.groupBy("field").agg(F.count_if("tried").alias("attempts"), F.count_if(F.col("tried") & ~F.col("blank")).alias("recovered"), F.count_if(F.col("tried") & F.col("blank")).alias("not_found"))


def labour_dates(df: DataFrame, hired: str, left: str, filed: str, as_of: Column) -> DataFrame:
    """Q1: dates not in the future and from 1950 on; a swapped pair of under 50 years is corrected; leaving comes before filing."""
    ok = lambda c: F.when((F.col(c) <= as_of) & (F.year(c) >= 1950), F.col(c))
    h, d = ok(hired), ok(left)
    swapped = F.coalesce((d < h) & (F.months_between(h, d) < 600), F.lit(False))
    out = df.withColumns({"__h": F.when(swapped, d).otherwise(h), "__d": F.when(swapped, h).otherwise(d), "dates_swapped": swapped})
    late = F.coalesce(F.col("__d") >= F.col(filed), F.lit(False))
    return out.withColumn(hired, F.col("__h")).withColumn(left, F.when(~late, F.col("__d"))).drop("__h", "__d")


def hearing_after_filing(df: DataFrame, hearing: str, filed: str) -> DataFrame:
    """Q2: a hearing on or before the day of filing goes, and the flag says so."""
    early = F.coalesce(F.to_date(hearing) <= F.to_date(filed), F.lit(False))
    return df.withColumn("has_hearing", F.col(hearing).isNotNull() & ~early).withColumn(hearing, F.when(~early, F.col(hearing)))


def issues(*checks: tuple[Column, str, str]) -> Column:
    """Q3, Q4: array<struct<field, message>> of the conditions that hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for c, f, m in checks)))


def validate_case(as_of: Column) -> Column:
    """Q3 over the typed columns hire_date, dismissal_date, filing_date, salary_value, pis, plaintiff, defendant."""
    c = F.col
    return issues(
        (c("hire_date") > as_of, "hire_date", "in the future"),
        (c("dismissal_date") < c("hire_date"), "dismissal_date", "before hire_date"),
        (c("dismissal_date").isNotNull() & c("hire_date").isNull(), "hire_date", "needed by dismissal_date"),
        (c("filing_date") < c("dismissal_date"), "filing_date", "before dismissal_date"),
        (~c("salary_value").between(1000, 500000), "salary_value", "out of range"),
        (F.length(T.digits("pis")) != 11, "pis", "not 11 digits"),
        (~T.blank("plaintiff") & (T.fold("plaintiff") == T.fold("defendant")), "defendant", "same as plaintiff"),
    )


def cascade_alerts() -> Column:
    """Q4 over the columns origin, instance, bench, filing_date, forum, person_kind, defendant."""
    c = F.col
    return issues(
        (c("origin").isin("TST", "STF", "STJ") & (~T.blank("bench") | (c("instance") == "Primeira Instância")), "origin", "superior court with signs of first instance"),
        ((c("instance") == "Segunda Instância") & ~T.blank("filing_date") & ~T.blank("bench"), "instance", "second instance with filing date and bench"),
        (T.blank("forum"), "forum", "empty"),
        ((c("person_kind") == "juridica") & (T.person_type("defendant") == "fisica"), "defendant", "company with a person's name"),
    )


PLACEHOLDERS = ("nao informado", "n/a", "-", "em segredo", "a definir")


def with_precedence(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Q5: stored beats extracted; placeholders don't count; ``<field>_conflict`` says that both are there and differ."""
    real = lambda col: F.when(~T.fold(col, "lower").isin(*PLACEHOLDERS), T.unblank(col))
    out = df
    for name, (stored, extracted) in pairs.items():
        s, e = real(stored), real(extracted)
        out = out.withColumn(f"{name}_conflict", F.coalesce(T.fold(s) != T.fold(e), F.lit(False)) & s.isNotNull() & e.isNotNull()).withColumn(name, F.coalesce(s, e))
    return out


def fill_defaults(df: DataFrame, spec: dict[str, list[str | Column]]) -> DataFrame:
    """Each field from a chain of columns (blank ones are skipped) and literals."""
    take = lambda x: T.unblank(x) if isinstance(x, str) else x
    return df.withColumns({f: F.coalesce(*(take(x) for x in chain)) for f, chain in spec.items()})


def baseline_fill(df: DataFrame, found: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """Values of ``found`` only where ``df`` is blank."""
    other = found.select(key, *(F.col(f).alias(f"__f_{f}") for f in fields))
    met = df.join(other, key, "left")
    return met.withColumns({f: F.coalesce(T.unblank(f), F.col(f"__f_{f}")) for f in fields}).drop(*(f"__f_{f}" for f in fields))
