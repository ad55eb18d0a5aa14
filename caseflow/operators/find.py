"""Search over chunks: keywords and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as T


def shortened(c, n: int = 500) -> Column:
    """The first n characters and "..." if there are more."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def keyword_search(chunks: DataFrame, term: str, key: str = "chunk_id", content: str = "content", case: Column | None = None, n: int = 5) -> DataFrame:
    """Chunks that hold the term, the first n by key, content shortened."""
    rows = chunks.where(T.ilike_any([content], term))
    rows = rows.where(case) if case is not None else rows
    return rows.orderBy(key).limit(n).withColumn(content, shortened(content))


def cosine(a, b) -> Column:
    """Of two arrays of numbers, in double precision; null for other lengths or a zero vector."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def vector_search(vectors: DataFrame, query: DataFrame, n: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The n rows most like the one row of ``query`` (column q)."""
    met = vectors.join(F.broadcast(query.limit(1).select("q")), F.lit(True))  # one row
    return met.select(key, cosine(vector, "q").alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(n)
