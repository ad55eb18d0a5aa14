"""A table of vectors with an index of inverted lists, so that a block of queries reads only the lists near it.

Centroids are fitted by k-means on a bounded sample; every row goes to the list of its nearest one and lies in that
list's partition of the table. A list that holds more than ``most`` rows is split again by centroids of its own, as often
as needed (equal vectors stay together), so partitions don't grow with the table. A query looks into the lists of its nearest centroids;
how many it needs for a recall is measured (``calibrated``), and scores of what is found are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.operators.find import cosine
from caseflow.operators.match import small

#: Rows of a list that meet its queries in one group, about, and the share of rows (one in so many) that bounds the scores.
BLOCK, SHARE = 8192, 128
#: Numbers of a vector up to which they are columns of their own: a pair then takes compiled code a microsecond instead of interpreted lambdas.
NARROW = 96


def _flat(name: str, width: int) -> list[Column]:
    """The numbers of an array as columns, with its length: both as ``cosine`` has them. Wider arrays stay."""
    squares = F.aggregate(name, F.lit(0.0), lambda s, x: s + x * x)
    numbers = [F.coalesce(F.get(name, F.lit(i)), F.lit(0.0)).alias(f"{name}{i}") for i in range(width)]
    return [*numbers, F.sqrt(squares).alias(f"{name}_size")] if width <= NARROW else [F.col(name)]


def _score(width: int) -> Column:
    """``cosine`` of the columns that ``_flat`` made of q and v."""
    if width > NARROW:
        return cosine("q", "v")
    dot = reduce(lambda s, i: s + F.col(f"q{i}") * F.col(f"v{i}"), range(width), F.lit(0.0))
    return dot / F.nullif(F.col("q_size") * F.col("v_size"), F.lit(0.0))


def _ranked(scored: DataFrame, n: int) -> DataFrame:
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
    return best.where(F.col("rank") <= n).select("query_id", "rank", "key", "score")


@dataclass(frozen=True)
class VectorTable:
    path: str
    key: str = "vec_id"
    vector: str = "embedding"
    lists: int = 16
    #: Rows that k-means is fitted on, at most, and rows of a list before it is split.
    fit_rows: int = 100_000
    most: int = 1_000_000
    probes: int = 4
    seed: int = 1

    # ---- writing

    def create(self, rows: DataFrame) -> VectorTable:
        """Write the table and its centroids. Vectors that are null, zero or of another length than most take no part."""
        wide = rows.select(F.col(self.key).alias("key"), F.transform(self.vector, lambda x: x.cast("double")).alias("v"))
        sound = wide.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0))
        usual = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        sound = sound.where(F.size("v") == (usual["n"] if usual else 0))
        self._split(sound, "", 0)
        return self

    def _split(self, sound: DataFrame, prefix: str, level: int) -> None:
        spark, n = sound.sparkSession, sound.count()
        sample = sound.sample(min(1.0, self.fit_rows / max(n, 1)), seed=self.seed) if n > self.fit_rows else sound
        held = sample.select(array_to_vector("v").alias("features"))
        k = min(self.lists, max(1, n // 8))
        if k > 1:
            model = KMeans(k=k, seed=self.seed + level, maxIter=10, distanceMeasure="cosine").fit(held)
            centres = [c.tolist() for c in model.clusterCenters()]
            placed = model.transform(sound.withColumn("features", array_to_vector("v"))).drop("features").withColumn("list", F.concat(F.lit(prefix), F.format_string("%03d", "prediction"))).drop("prediction")
        else:
            centres, placed = [[0.0]], sound.withColumn("list", F.lit(f"{prefix}000"))
        sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # ``lists`` rows
        large = sorted(x for x, size in sizes.items() if self.most < size < n)  # equal vectors can't be parted
        placed.where(~F.col("list").isin(large) if large else F.lit(True)).repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")
        named = [(f"{prefix}{j:03d}", c) for j, c in enumerate(centres) if f"{prefix}{j:03d}" in sizes and f"{prefix}{j:03d}" not in large]
        if named:
            spark.createDataFrame(named, "list string, centre array<double>").coalesce(1).write.mode("append").parquet(f"{self.path}/centres")
        for x in large:
            self._split(placed.where(F.col("list") == x).drop("list"), f"{x}-", level + 1)

    # ---- reading

    def rows(self, spark: SparkSession, lists: list[str] | None = None) -> DataFrame:
        """(key, v, list); of the lists alone, whose partitions are all that is read."""
        held = spark.read.schema("key long, v array<double>, list string").parquet(f"{self.path}/rows")
        return held if lists is None else held.where(F.col("list").isin(lists))

    def centres(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("list string, centre array<double>").parquet(f"{self.path}/centres")

    def nearest_lists(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(query_id, q, list, place): each query's lists in order of their centroids, the first ``probes`` (all, if null)."""
        centres = self.centres(queries.sparkSession)
        near = F.coalesce(cosine("q", "centre"), F.lit(0.0))
        # centroids grow with the number of lists alone; every query meets each
        met = queries.join(small(centres), F.lit(True)).withColumn("near", near)
        placed = met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "list"))).select("query_id", "q", "list", "place")
        return placed if probes is None else placed.where(F.col("place") <= probes)

    def search(self, queries: DataFrame, n: int = 5, probes: int | None = None, skip_self: bool = True) -> DataFrame:
        """(query_id, rank, key, score): the n most like each of ``queries`` (query_id, q) in the lists that it looks into.

        The n-th best in a share of these rows bounds what can be among the n best of all, so only few pairs are ranked.
        """
        spark = queries.sparkSession
        wanted = self.nearest_lists(queries, probes or self.probes)
        lists = sorted(r["list"] for r in wanted.select("list").distinct().collect())  # a name for each list
        rows = self.rows(spark, lists)
        first = rows.select(F.size("v").alias("n")).first()
        width = first["n"] if first else 0
        wanted = wanted.where((F.size("q") == width) & ~F.exists("q", lambda x: x.isNull()))
        parts = small(rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))  # a row for each list
        part = lambda count: F.pmod(F.xxhash64("key"), count).cast("int")
        held = rows.join(parts, "list").select("list", part(F.col("parts")).alias("part"), "key", *_flat("v", width))
        asked = wanted.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", *_flat("q", width))
        own = F.col("query_id") != F.col("key") if skip_self else F.lit(True)
        score = _score(width)

        some = held.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SHARE)) == 0)
        seen = some.join(asked.hint("shuffle_hash"), ["list", "part"]).where(own).select("query_id", "key", score.alias("score")).where("score is not null")
        bound = _ranked(seen, n).where(F.col("rank") == n).select("query_id", F.col("score").alias("least"), F.col("key").alias("last"))
        asked = asked.join(bound, "query_id", "left")
        inside = F.coalesce((score >= F.col("least")) & ((F.col("key") <= F.col("last")) | (score > F.col("least"))), F.col("least").isNull())
        met = held.join(asked.hint("shuffle_hash"), ["list", "part"]).where(own & inside).select("query_id", "key", score.alias("score")).where("score is not null")
        return _ranked(met, n)

    def calibrated(self, queries: DataFrame, recall: float = 0.9, n: int = 5, sample: int = 64) -> VectorTable:
        """The table with the fewest probes that reach ``recall`` on at most ``sample`` of the queries, by a full scan for these."""
        few = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
        order = self.nearest_lists(few, None).select("query_id", "list", "place")
        best = replace(self, probes=1 << 30).search(few, n).join(self.rows(queries.sparkSession).select("key", "list"), "key")
        places = best.join(order, ["query_id", "list"]).agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY place)")).first()[0]
        return replace(self, probes=int(places or 1))

    def share_read(self, queries: DataFrame) -> float:
        """The share of all rows that a query compares itself with, on average."""
        sizes = self.rows(queries.sparkSession).groupBy("list").count()
        seen = self.nearest_lists(queries, self.probes).join(sizes, "list").agg(F.sum("count")).first()[0] or 0
        return seen / max(1, queries.count() * self.rows(queries.sparkSession).count())
