"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.sources.shared import shared_dir, work_path  # noqa: F401  (shared_dir for the operators)

#: Text bytes that one vectorised step inside a task works on at once.
STEP_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, keep: str = "lineage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table replaces the lineage: a lost executor costs a reread, not a recomputation, and every
    later use of the frame reads the same rows.
    """
    spark = df.sparkSession
    path = work_path(spark, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fanout(df: DataFrame) -> int:
    """Partitions for explicit exchanges: the session's setting, read at call time."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``limit`` bytes in ``column`` (a longer single row stays whole)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    mark = np.cumsum(size, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def shielded(docs: DataFrame, own: tuple[str, ...], work: Callable[[DataFrame], DataFrame], *new: str) -> DataFrame:
    """``work`` on ``docs``, while its columns other than ``own`` bear names that nobody else uses; back come all columns, and ``new`` ones.

    So an operator's names of its own (``__id`` and the like) never meet a column of the caller's.
    """
    hidden = {c: c if c in own else f"__kept_{k}" for k, c in enumerate(docs.columns)}
    out = work(docs.select(*(F.col(f"`{c}`").alias(h) for c, h in hidden.items())))
    return out.select(*(F.col(h).alias(c) for c, h in hidden.items()), *new)
