"""Quality rules: per-text rule statistics, judged by an isolation forest.

The rule statistics of a text are exact counts over the whole text. The forest isolates rows of
statistics by random splits; rows that few splits isolate are anomalous. The forest is fitted on a
bounded sample of labelled rows (``Settings.fit_rows``); the threshold on its score is calibrated on
*all* labelled rows, from a histogram that Spark counts.

Defined results: null and empty text count as no words (all counts 0, ``base_failed`` true); rows
with equal ids are judged one by one; without any labelled row there is no threshold and the
verdict is the base rule alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm._common import stash

#: The white space that parts words, the symbols that are counted.
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_unique", "n_short")
FEATURES = ("word_length", "symbols", "copied", "variety", "shout", "marks", "short")


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    max_repeat_percent: int = 50
    trees: int = 100
    tree_rows: int = 256
    #: Most labelled rows that the forest is fitted on.
    fit_rows: int = 4096
    #: Least share of rows labelled good that the threshold keeps.
    keep_good: float = 0.995
    seed: int = 17


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window found twice or more."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    window = ids
    for k in range(1, width):  # ranks keep the key within 64 bits at any length
        window = np.unique(window[:-1] * len(known) + ids[k:], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    hit = np.zeros(len(words), bool)
    for k in range(width):
        hit[k : len(twice) + k] |= twice
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    codes = np.frombuffer(raw, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        lines,
        int(((codes >= 65) & (codes <= 90)).sum()),
        text.count("!") + text.count("?"),
        len(set(words)),
        sum(len(w) <= 3 for w in words),
    )


def rule_statistics(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and the columns of COUNTS, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t.as_py()) for t in b.column("__text")]
            cols = list(zip(*rows)) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), *(pa.array(c, pa.int64()) for c in cols)], [*keys, *COUNTS]
            )

    src = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join([f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} long" for c in COUNTS])
    return src.mapInArrow(run, schema)


def features() -> list[Column]:
    """The statistics as shares, comparable over lengths.

    Repeats are left to the base rule. Clean texts hold some capitals and a shared line or two, so
    only what goes beyond a usual share of them (a tenth, two fifths) counts.
    """
    c = {k: F.col(k).cast("double") for k in COUNTS}
    per = lambda a, b: F.coalesce(c[a] / F.nullif(c[b], F.lit(0.0)), F.lit(0.0))
    over = lambda share, usual: F.greatest(share - usual, F.lit(0.0))
    variety = F.when(c["n_words"] > 1, F.log(c["n_unique"]) / F.log(c["n_words"])).otherwise(1.0)
    made = [per("word_chars", "n_words"), per("n_symbols", "word_chars"), over(per("n_dup_lines", "n_lines"), 0.4), variety, over(per("n_upper", "word_chars"), 0.1), per("n_marks", "word_chars"), per("n_short", "n_words")]
    return [m.alias(f"f_{n}") for m, n in zip(made, FEATURES)]


class IsolationForest:
    """Trees of random splits; ``score`` nears 1 for rows that few splits isolate."""

    def __init__(self, rows: np.ndarray, trees: int, tree_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        # a full binary tree in heap order: children of i are 2i+1 and 2i+2; a leaf holds its path length
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, nodes), np.int16)
        self.split = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        for t in range(trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), self.size, replace=False)], rng)

    @staticmethod
    def mean_path(n: float) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, level: int, rows: np.ndarray, rng) -> None:
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else ()
        if level == self.depth or not len(spread):
            length, todo = level + self.mean_path(len(rows)), [(node, level)]
            while todo:  # rows that fall through keep the leaf's length down to the last level
                k, at = todo.pop()
                self.path[t, k] = length
                if at < self.depth:
                    todo += [(2 * k + 1, at + 1), (2 * k + 2, at + 1)]
            return
        f = int(rng.choice(spread))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        self.feature[t, node], self.split[t, node] = f, cut
        low = rows[:, f] < cut
        self._grow(t, 2 * node + 1, level + 1, rows[low], rng)
        self._grow(t, 2 * node + 2, level + 1, rows[~low], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, feature[node]] >= split[node])
            total += path[node]
        return 2.0 ** (-total / len(self.path) / max(self.mean_path(self.size), 1e-9))


def fit_forest(labelled: DataFrame, settings: Settings) -> IsolationForest | None:
    """A forest on at most ``fit_rows`` labelled rows of features, picked by hash (not by order of arrival)."""
    names = [f"f_{n}" for n in FEATURES]
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(settings.fit_rows).select(*names).toPandas()
    return IsolationForest(picked.to_numpy(float), settings.trees, settings.tree_rows, settings.seed) if len(picked) else None


def with_score(stats: DataFrame, forest: IsolationForest, name: str = "anomaly") -> DataFrame:
    """``stats`` (with feature columns) and the forest's score."""
    columns = [f"f_{n}" for n in FEATURES]

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x))], [*b.schema.names, name])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(run, f"{ddl}, {name} double")


def calibrate(scored: DataFrame, settings: Settings, bins: int = 1000) -> float:
    """The score above which a row is rejected, from all labelled rows.

    Among the thresholds that keep ``keep_good`` of the rows labelled good, the one that separates
    the labels best. Only a histogram of ``bins`` by two labels reaches the driver.
    """
    counted = scored.where(F.col("quality").isNotNull()).groupBy(F.floor(F.col("anomaly") * bins).cast("int").alias("bin"), (F.col("quality") > 0).alias("good")).count().collect()
    table = np.zeros((bins + 1, 2))
    for r in counted:
        table[min(bins, max(0, r["bin"])), int(r["good"])] += r["count"]
    above = table[::-1].cumsum(0)[::-1]  # rows at or above each bin
    bad, good = table.sum(0)
    if not bad or not good:
        return float("inf")
    lost, caught = above[:, 1] / good, above[:, 0] / bad
    allowed = lost <= 1 - settings.keep_good
    if not allowed.any():
        return float("inf")
    gain = np.where(allowed, caught - lost, -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] / bins)  # the middle of the gap between the labels


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, ``base_failed``, ``anomaly`` and ``kept`` for each row of ``docs`` (columns doc_id, text)."""
    stats = rule_statistics(docs, keys)
    failed = (F.col("n_words") < settings.min_words) | (100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words"))
    stats = stash(stats.select("*", failed.alias("base_failed"), *features()), "quality")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.where(~F.col("base_failed")).join(marks, "doc_id")
    forest = fit_forest(labelled, settings)
    if forest is None:
        return stats.select("*", F.lit(0.0).alias("anomaly"), (~F.col("base_failed")).alias("kept"))
    limit = calibrate(with_score(labelled, forest), settings)
    return with_score(stats, forest).withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * 1000) / 1000 < limit))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: counts and verdict of every document."""
    from caseflow.llm._common import read

    out = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
