"""The operators as filtering and rewriting stages over tables shaped like ``documents``.

A row is known by its id and a hash of its text, so repeated ids do no harm. All stages but packing
return the columns they were given, with ``n_chars`` (where there is one) brought up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from caseflow.llm._common import read, shielded


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__tag", F.xxhash64("text"))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return shielded(docs, ("doc_id", "text"), lambda rows: _kept_by_rules(spark, rows, sf_dir))


def _kept_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_tagged(docs), read(spark, sf_dir, "labels"), keys=("doc_id", "__tag"))
    out = judged.where(~F.col("kept")).select(F.col("doc_id").alias("o_id"), F.col("__tag").alias("o_tag")).distinct()
    own = _tagged(docs)
    return own.join(out, own["doc_id"].eqNullSafe(out["o_id"]) & (own["__tag"] == out["o_tag"]), "left_anti").drop("__tag")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id. Documents without words all stay.

    Of rows with one id and one text, that with the smallest other columns stays; they combine before they are exchanged.
    """
    return shielded(docs, ("doc_id", "text"), _one_of_each)


def _one_of_each(docs: DataFrame) -> DataFrame:
    found = ngram_join.near_duplicates(docs).where("n_shingles > 0")
    stay = found.groupBy("component").agg(F.min(F.struct("__id", "__tag")).alias("r")).select(F.col("r.__id").alias("__s_id"), F.col("r.__tag").alias("__s_tag"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = _tagged(docs.where(has_words))
    met = own.join(stay, own["doc_id"].cast("long").eqNullSafe(stay["__s_id"]) & (own["__tag"] == stay["__s_tag"]))
    order = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    one = met.groupBy("__s_id", "__s_tag").agg(F.min_by(F.struct(*docs.columns), F.struct(F.lit(0), *order)).alias("__row"))
    return one.select("__row.*").unionByName(docs.where(~has_words))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that occur more than once."""
    return _measured(suffix_dedup.remove_repeats(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""

    def work(rows: DataFrame) -> DataFrame:
        found = secret_scan.scan(rows, name="__secrets")
        return found.withColumn("text", secret_scan.redact(F.col("text"), F.col("__secrets"))).drop("__secrets")

    return _measured(shielded(docs, ("doc_id", "text"), work))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
