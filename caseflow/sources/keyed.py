"""A table that is changed by key: rows lie in partitions by a hash of the key, and a change rewrites only the partitions that it touches.

A change is written aside first, from the table as it stands, then put in place by Spark's dynamic partition overwrite,
then marked as done. So a change that is repeated after a crash is taken up where it stopped, and one that was done
changes nothing. Until then a reader meets each partition before or after the change, never in between. Rows are
added and replaced, never removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.sources.shared import drop_folder, open_store

PART = "__part"


@dataclass(frozen=True)
class KeyedTable:
    path: str
    key: str
    #: Partitions: so many that one of them is a file of usual size.
    parts: int = 64

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias(PART)

    def create(self, rows: DataFrame) -> KeyedTable:
        rows.select("*", self._part()).repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/rows")
        return self

    def read(self, spark: SparkSession, parts: list[int] | None = None) -> DataFrame:
        """The rows, or those of some partitions; the others aren't opened."""
        rows = spark.read.parquet(f"{self.path}/rows")
        return (rows if parts is None else rows.where(F.col(PART).isin(parts))).drop(PART)

    def change(self, number: int, updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the partitions that ``updates`` touch by ``merge`` of their rows with the updates; ``number`` names the change."""
        spark, aside, done = updates.sparkSession, f"{self.path}/aside/change={number}", f"{self.path}/done/change={number}"
        if _complete(done):
            return []
        if not _complete(aside):
            touched = [r[PART] for r in updates.select(self._part()).distinct().collect()]  # at most ``parts``
            if touched:
                merge(self.read(spark, touched), updates).select("*", self._part()).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(aside)
        touched = []
        if _complete(aside):
            changed = spark.read.parquet(aside)
            touched = sorted(r[PART] for r in changed.select(PART).distinct().collect())
            changed.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.path}/rows")
        spark.createDataFrame([(p,) for p in touched], "part int").coalesce(1).write.mode("overwrite").parquet(done)
        if touched:
            drop_folder(aside)
        return touched

    def upsert(self, number: int, rows: DataFrame) -> list[int]:
        """Rows of new keys are added, those of known keys replaced. A key stands once in ``rows``."""
        return self.change(number, rows, lambda old, new: old.join(new.select(self.key), self.key, "left_anti").unionByName(new))


def _complete(path: str) -> bool:
    store, top = open_store(path)
    return store.get_file_info(f"{top}/_SUCCESS").type != fs.FileType.NotFound
