"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one and hashed in several tables: each of a table's functions is
floor((a.v + b) / width) with normal ``a`` (2-stable). A query visits its own bucket and perturbed
buckets, in the order of their estimated success (sum of squared distances to the slot borders that
are crossed). The candidates of all tables are merged and ranked by exact cosine on the original
vectors.

Equal vectors are one class with its smallest ids, so copies can't fill a bucket; a bucket with more
than ``bucket_rows`` classes is split, and a probe visits all its parts. The queries that visit a block
are dealt to lots of bounded size, each of which meets the block's rows. The number of functions and
of probes and the slot width are measured: on a bounded sample of queries, against brute force over all
rows, those that meet the wanted recall with the smallest share of rows visited are taken. Where none
does, one bucket holds everything and the search is exact.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do vectors of another length than most; a query is not its own candidate (rows with its id are not
either); ties go to the smaller id; fewer candidates than wanted give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm._common import fanout, read, stash


@dataclass(frozen=True)
class Settings:
    k: int = 5
    tables: int = 4
    #: Slot widths for vectors of length one that are tried; the first one unless another is chosen.
    widths: tuple[float, ...] = (1.6, 2.2)
    #: Rows that a bucket should hold on average; sets the number of functions a table starts with.
    bucket_target: int = 48
    bucket_rows: int = 4096
    #: Queries, and their visits to buckets, that one block should meet at once.
    lot_queries: int = 4096
    lot_visits: int = 1 << 18
    most_probes: int = 1024
    recall: float = 0.95
    #: Queries that the parameters are measured on (those in the first place that functions and width are chosen by), and rows.
    sample_queries: int = 64
    choose_queries: int = 24
    sample_rows: int = 2048
    seed: int = 29


class Hashing:
    """The functions of all tables, and the probing order of a query."""

    def __init__(self, dim: int, functions: int, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.functions, self.s, self._template = functions, s, None
        self.a = rng.standard_normal((dim, s.tables * 24))[:, : s.tables * 24].reshape(dim, s.tables, 24)[:, :, :functions]
        self.width = s.widths[0]
        self.b = rng.uniform(0, self.width, (s.tables, 24))[:, :functions]

    def project(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, functions): positions in slots."""
        return (np.einsum("nd,dtf->ntf", unit, self.a) + self.b) / self.width

    @staticmethod
    def key(slots: np.ndarray) -> np.ndarray:
        """Slots along the last axis -> a 64-bit bucket key."""
        h = np.full(slots.shape[:-1], 0x243F6A8885A308D3, np.uint64)
        for k in range(slots.shape[-1]):
            h = (h ^ slots[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def template(self, most: int) -> np.ndarray:
        """Sets of border crossings (by rank of distance), about the ``most`` likeliest for an average query, the empty set first."""
        if self._template is None:
            m = self.functions
            j = np.arange(1, 2 * m + 1)
            back = 2 * m + 1 - j
            # expected squared distances of the j-th nearest border, in slots
            z = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2))).tolist()
            out, heap = [()], [(z[0], (0,))] if m else []
            while heap and len(out) < most:
                score, chosen = heappop(heap)
                last = chosen[-1]
                if last + 1 < 2 * m:  # the last crossing moves on to the next border, or that one is crossed as well
                    heappush(heap, (score - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
                    heappush(heap, (score + z[last + 1], (*chosen, last + 1)))
                if not any(2 * m - 1 - c in chosen for c in chosen):  # no function is moved both ways
                    out.append(chosen)
            self._template = np.zeros((len(out), 2 * m), np.int8)
            for k, chosen in enumerate(out):
                self._template[k, list(chosen)] = 1
        return self._template

    def probes(self, position: np.ndarray, most: int) -> np.ndarray:
        """Slots of the ``most`` buckets that most likely hold near vectors, best first, for one table.

        The sets of the template are put in the order of this query's own distances.
        """
        slot, m = np.floor(position), self.functions
        if not m:
            return slot[None]
        cost = np.r_[(position - slot) ** 2, (slot + 1 - position) ** 2]  # one slot down, one slot up
        order = np.argsort(cost, kind="stable")
        sets = self.template(self.s.most_probes + self.s.most_probes // 4)
        best = sets[np.argsort(sets @ cost[order], kind="stable")[:most]]
        crossed = np.zeros_like(best)
        crossed[:, order] = best
        down, up = crossed[:, :m], crossed[:, m:]
        return (slot + up - down)[~(down & up).any(1)]


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def classes(vectors: DataFrame, k: int, vec_id: str, vector: str) -> DataFrame:
    """class, v, ids: equal vectors once, with their k + 1 smallest ids.

    Rows that repeat an id count once. The window keeps k + 1 rows a class before the exchange already, whatever the
    number of copies.
    """
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(usable(F.col("v")))
    rows = rows.withColumn("class", F.sha2(F.array_join(F.transform("v", lambda x: F.hex(F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string"))), ","), 256))
    rows = rows.dropDuplicates(["class", "vec_id"])
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return first.groupBy("class").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row and independent of how rows are batched."""
    scale_q, scale_r = np.abs(query).max(), np.abs(rows).max(1)
    q, r = query / scale_q, rows / scale_r[:, None]
    return (r * q).sum(1) / (np.sqrt((r * r).sum(1)) * math.sqrt(float((q * q).sum())))


def _best(q: pd.DataFrame, ids: pd.Series, v: np.ndarray, k: int, pick: list[np.ndarray] | None = None) -> dict[str, list]:
    """For each query the k + 1 best classes among ``v`` (or its rows ``pick[i]``), by exact cosine."""
    out: dict[str, list] = {"query_id": [], "ids": [], "score": []}
    unit = _unit(v)
    for i, (qid, qv) in enumerate(zip(q["query_id"], q["qv"])):
        qv = np.asarray(qv)
        rows = np.arange(len(v)) if pick is None else pick[i]
        near = unit[rows] @ _unit(qv[None])[0]
        if len(rows) > k + 1:
            floor = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
            rows = rows[near >= floor - 1e-9]
        score = exact_cosine(qv, v[rows])
        for j in np.lexsort(([ids.iat[r][0] for r in rows], -score))[: k + 1]:
            out["query_id"].append(qid), out["ids"].append(ids.iat[rows[j]]), out["score"].append(float(score[j]))
    return out


FOUND = "query_id long, ids array<long>, score double"


def rank(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from classes found in any block; classes are ranked before their ids are listed."""
    found = found.groupBy("query_id", F.element_at("ids", 1).alias("least")).agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "least")
    found = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").dropDuplicates(["query_id", "vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(index: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries: each block of rows keeps its k + 1 best."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame(_best(shared.value, pdf["ids"], np.array(pdf["v"].tolist()), k))

    return rank(index.select("ids", "v").mapInPandas(run, FOUND), k)


@dataclass(frozen=True)
class Choice:
    """Parameters for all tables, and the share of rows and the recall that they are expected to have."""

    functions: int
    probes: int
    width: float
    share: float
    recall: float


def probe_ranks(h: Hashing, query: np.ndarray, slots: np.ndarray, most: int) -> np.ndarray:
    """For rows of the given bucket keys (rows, tables): the place of their bucket in the query's probing order, the best of all tables."""
    position, out = h.project(_unit(query[None]))[0], np.full(len(slots), np.inf)
    for t in range(slots.shape[1]):
        keys = h.key(h.probes(position[t], most))
        order = np.argsort(keys, kind="stable")
        at = np.minimum(np.searchsorted(keys[order], slots[:, t]), len(keys) - 1)
        hit = keys[order[at]] == slots[:, t]
        out[hit] = np.minimum(out[hit], order[at[hit]] + 1)
    return out


def calibrate(index: DataFrame, n: int, dim: int, sample: pd.DataFrame, s: Settings) -> Choice:
    """The parameters that meet the recall on the sample with the smallest share of rows visited."""
    everything = Choice(0, 1, s.widths[0], 1.0, 1.0)
    truth = brute_force(index, sample, s.k).select("query_id", "vec_id")
    owner = index.select(F.explode("ids").alias("vec_id"), "v").join(F.broadcast(truth), "vec_id").select("query_id", "v").toPandas()  # sample_queries * k rows
    if not len(owner):
        return everything
    first = lambda rows: rows.orderBy("class").limit(s.sample_rows).select("v").toPandas()["v"].tolist()
    some = first(index.where(F.col("class") < f"{min((1 << 32) - 1, (2 * s.sample_rows << 32) // n):08x}"))  # classes are hashes; else each file sends that many rows
    some = np.array(some if len(some) == s.sample_rows else first(index))
    near = {qid: np.array(owner["v"].iloc[part].tolist()) for qid, part in owner.groupby("query_id").indices.items()}
    asked = [(np.array(v), near[qid]) for qid, v in zip(sample["query_id"], sample["qv"]) if qid in near]

    def measure(functions: int, width: float, queries: list) -> Choice | None:
        h = Hashing(dim, functions, replace(s, widths=(width,)))
        slots = h.key(np.floor(h.project(_unit(some))))
        need = np.concatenate([probe_ranks(h, q, h.key(np.floor(h.project(_unit(v)))), s.most_probes) for q, v in queries])
        probes = np.sort(need)[max(0, math.ceil(s.recall * len(need)) - 1)]
        if not np.isfinite(probes):
            return None
        share = np.mean([(probe_ranks(h, q, slots, s.most_probes) <= probes).mean() for q, _ in queries])
        return Choice(functions, int(probes), width, float(share), float((need <= probes).mean()))

    start = min(20, max(1, math.ceil(math.log2(max(2, n / s.bucket_target)))))
    best = None
    for width in s.widths:
        for functions in range(start + 3, 0, -1):
            found = measure(functions, width, asked[: s.choose_queries])
            if found and (best is None or found.share < best.share):
                best = found
            elif found and functions < start - 2:
                break
    best = best and measure(best.functions, best.width, asked)
    return best or everything


#: Buckets, about, whose sizes are broadcast; more are met by an exchange of the probes.
FEW_BUCKETS = 500_000


def of_buckets(asked: DataFrame, size: DataFrame) -> DataFrame:
    """``asked`` (a row for each probe) with what ``size`` tells of its bucket; probes of empty buckets go.

    Spark takes the probes for as small as the queries they are made of, so left to itself it would broadcast them.
    """
    return asked.join(F.broadcast(size) if size.count() <= FEW_BUCKETS else size.hint("merge"), "bucket")


def in_lots(asked: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """``asked`` with each query's lot within its block, and (block, lots): queries of a block dealt by their ids."""
    lots = F.ceil(F.greatest(F.count("*") / s.lot_queries, F.sum(F.size("visits")) / s.lot_visits)).cast("int")
    loads = asked.groupBy("block").agg(lots.alias("lots"))
    dealt = asked.join(loads, "block").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int"))
    return dealt.drop("lots"), loads


def search(vectors: DataFrame, is_query: Column, s: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row with ``is_query``."""
    spark, parts = vectors.sparkSession, fanout(vectors)
    sized = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sized["dim"] if sized else 0
    vectors = vectors.where(F.size(vector) == dim)
    index = stash(classes(vectors, s.k, vec_id, vector), "vectors")
    queries = stash(
        vectors.where(F.coalesce(is_query, F.lit(False)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("query_id"), F.transform(vector, lambda x: x.cast("double")).alias("qv")).where(usable(F.col("qv"))).dropDuplicates(["query_id"]), "queries"
    )
    n = index.count()
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(s.sample_queries).toPandas()
    if not n or not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    choice = calibrate(index, n, dim, sample, s)
    functions, probes = choice.functions, choice.probes
    s = replace(s, widths=(choice.width,), tables=s.tables if functions else 1)
    h = spark.sparkContext.broadcast(Hashing(dim, functions, s))

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                keys = h.value.key(np.floor(h.value.project(_unit(np.array(pdf["v"].tolist())))))
                for t in range(s.tables):
                    yield pd.DataFrame({"bucket": keys[:, t] ^ t, "ids": pdf["ids"], "v": pdf["v"]})

    def probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qid, qv in zip(pdf["query_id"], pdf["qv"]):
                position = h.value.project(_unit(np.array(qv)[None]))[0]
                for t in range(s.tables):
                    yield pd.DataFrame({"query_id": qid, "bucket": np.unique(h.value.key(h.value.probes(position[t], probes))) ^ t})

    rows = index.mapInPandas(hash_rows, "bucket long, ids array<long>, v array<double>")
    # a large bucket is dealt to several parts by class; its probes go to all of them
    size = stash(rows.select("bucket").groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / s.bucket_rows).cast("int").alias("parts")), "sizes")
    large = size.where("parts > 1")
    blocks = math.ceil(n * s.tables / s.bucket_rows)
    block = lambda: F.pmod(F.xxhash64("bucket", "part"), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.join(large, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("ids"), F.coalesce("parts", F.lit(1))).cast("int"))
    asked = queries.repartition(parts).mapInPandas(probe_rows, "query_id long, bucket long")
    asked = of_buckets(asked, size).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.groupBy(block(), "query_id").agg(F.collect_set(F.struct("bucket", "part")).alias("visits"))
    asked, loads = in_lots(stash(asked, "visits"), s)
    asked = asked.join(queries, "query_id")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A lot of queries against the rows of one block, query by query."""
        none = pd.DataFrame({"query_id": [], "ids": pd.Series([], dtype=object), "score": []})  # Arrow makes no lists of floats
        if not len(left) or not len(right):
            return none
        where = left.reset_index(drop=True).groupby(["bucket", "part"]).indices
        first = np.array([ids[0] for ids in left["ids"]])
        pick = []
        for visits in right["visits"]:
            rows = np.concatenate([where.get((x["bucket"], x["part"]), np.zeros(0, np.int64)) for x in visits])
            pick.append(rows[np.unique(first[rows], return_index=True)[1]])  # tables hold the same classes
        some = [i for i, p in enumerate(pick) if len(p)]
        if not some:
            return none
        return pd.DataFrame(_best(right.iloc[some], left["ids"].reset_index(drop=True), np.array(left["v"].tolist()), s.k, [pick[i] for i in some]))

    lots = loads.select("block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    dealt = dealt.select(block(), "bucket", "part", "ids", "v").join(lots, "block")
    found = dealt.groupBy("block", "lot").cogroup(asked.groupBy("block", "lot")).applyInPandas(meet, FOUND)
    return rank(found, s.k)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the five nearest of every fiftieth vector."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
