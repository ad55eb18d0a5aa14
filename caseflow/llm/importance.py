"""Importance resampling towards a target distribution, by hashed n-grams, with Arrow kernels.

Texts are lower-cased (``ascii_lower``), split into words (``split_pattern_regex``) and flattened
(``list_flatten``); ``dictionary_encode`` gives every distinct word of a step one number. The indices beside each
other, shifted by one, form pairs; encoded once more and shifted by two, triples. So a CRC is taken once per
distinct word, pair and triple of a step, the longer one continued from the shorter, and ``take`` spreads the buckets
back over the text. Bucket counts of the corpus and of the target give each bucket a gain; a second pass adds up the
gains of every document by segments. The documents that are drawn are those with the largest sum of weight and Gumbel
noise, the noise from a hash of the id: sampling without replacement that a rerun repeats.

What reaches the driver is the bucket counts (``buckets`` rows) and the number of eligible documents. Ranks come from
one sort by ranges, never from a single task.

Defined results: null, empty and wordless texts have no features and weight 0; a null id is hashed as no digits and
sorts behind all others; rows that repeat are scored and ranked one by one; with an empty corpus or target the gains
follow from the counts that there are; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm._common import read, stash, steps
from caseflow.operators.worklog import numbered

#: What stands between words, once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Text bytes of a step: the more, the more often its distinct n-grams are met again.
STEP = 4 << 20


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    seed: int = 42
    #: Words that a document needs to be drawn, and the documents in a hundred that are.
    least_words: int = 20
    percent: int = 5


class Features:
    """The n-grams of a step of texts: ``bucket`` of each, ``text`` that holds it, and the words of each text."""

    def __init__(self, texts: pa.Array, buckets: int):
        # taken out as a copy: a slice that is cast keeps offsets into the whole buffer, and the lower-casing kernel reads from its start
        whole = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        lists = pc.split_pattern_regex(pc.ascii_lower(whole), BETWEEN)
        words, text = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(words), 0)  # a separator at either end leaves an empty word
        coded, text = pc.filter(words, real).dictionary_encode(), pc.filter(text, real).to_numpy()
        self.words = np.bincount(text, minlength=len(texts))
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        spaced = [b" " + w for w in distinct]
        crc, at = [zlib.crc32(w) for w in distinct], coded.indices.to_numpy().astype(np.int64)
        gram, found = at, [(np.array(crc, np.uint32)[at], text)]
        for n in (2, 3):
            inside = text[n - 1 :] == text[: len(text) - n + 1]
            pairs = pa.array((gram[: len(gram) - 1] << 32 | at[n - 1 :])[inside]).dictionary_encode()
            codes = pairs.dictionary.to_numpy()
            crc = list(map(zlib.crc32, map(spaced.__getitem__, (codes & 0xFFFFFFFF).tolist()), map(crc.__getitem__, (codes >> 32).tolist())))
            index = pairs.indices.to_numpy()
            found.append((np.array(crc, np.uint32).take(index), text[n - 1 :][inside]))
            # of the next, longer grams, those within one text begin with one of these
            gram = np.zeros(max(len(at) - n + 1, 0), np.int64)
            gram[inside] = index
        self.bucket = [c % np.uint32(buckets) for c, _ in found]
        self.text = [t for _, t in found]

    def counts(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(b, minlength=buckets) for b in self.bucket)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains of each text: features of one text are neighbours, so they are reduced by segments."""
        out = np.zeros(len(self.words), np.int64)
        for b, t in zip(self.bucket, self.text):
            if len(t):
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                out[t[first]] += np.add.reduceat(gains.take(b), first)
        return out

    def sizes(self) -> np.ndarray:
        return sum(np.bincount(t, minlength=len(self.words)) for t in self.text)


def bucket_counts(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> np.ndarray:
    """How many features fall in each bucket: each task sends its sums, at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for b in steps(batch, "__text", STEP):
                total += Features(b.column("__text"), settings.buckets).counts(settings.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(settings.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandfold log ratio of the smoothed shares of each bucket in target and corpus, rounded down."""
    n, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (all_s + n)) / float((s + 1) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise that belongs to a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "__text", STEP):
                f, ids = Features(b.column("__text"), settings.buckets), b.column("__id")
                weight = f.sums(gains)
                score = weight + np.array([noise(i, settings.seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, pa.int64()) for v in (f.words, f.sizes(), weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    src = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` counts the drawn rows from 1 and is null for the rest."""
    gains = bucket_gains(bucket_counts(docs, settings, text), bucket_counts(target, settings, target_text))
    rows = stash(scored(docs, gains, settings, text, doc_id), "scores")
    enough = F.col("n_words") >= settings.least_words
    drawn = settings.percent * rows.where(enough).count() // 100
    ranked = numbered(rows.where(enough), F.desc("score"), F.asc_nulls_last("doc_id"), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: a twentieth of the documents, drawn towards the benchmark's distribution."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
