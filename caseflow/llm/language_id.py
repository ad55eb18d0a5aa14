"""Language identification, with labelled spans for mixed-language text.

Script ranges narrow the candidate languages of each word; a word scores each candidate by the mean
log probability of its character 2-, 3- and 4-grams; Viterbi over the words, with a penalty for every
switch, labels spans. The language of a text is the one whose spans hold most letters; its score is
their share.

The n-gram counts cover all training rows. They are hashed into a fixed number of buckets, so what
reaches the driver is bounded by languages x buckets, whatever the corpus.

Defined results: null, empty and letterless text gives ``und`` with score 0 and no spans, as does
every text when nothing was learned; ties go to the smaller language name; equal rows are labelled
one by one; a word in a script that no learned language uses says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm._common import read, steps

ORDERS, BUCKETS = 3, 1 << 15

#: First code points of script ranges (Unicode blocks); what follows the last named range is "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@lru_cache(1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case code point if it is a letter, else 0; its script."""
    lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(0x40000):  # no letters are assigned beyond
        ch = chr(c)
        if ch.isalpha():
            lower[c] = ord(ch.lower()[0])
    starts = [s for s, _ in SCRIPTS] + [0x110000]
    for (a, name), b in zip(SCRIPTS, starts[1:]):
        script[a:b] = NAMES.index(name)
    return lower, script


@dataclass
class Grams:
    """Letters of a batch of texts: hashed n-grams per letter, words, and texts."""

    features: np.ndarray  # (letters, ORDERS)
    word_start: np.ndarray  # index of each word's first letter
    word_text: np.ndarray  # the text each word is in
    word_script: np.ndarray
    word_from: np.ndarray  # code points within the text
    word_to: np.ndarray


def grams(texts: list[str | None]) -> Grams:
    lower, script = letter_tables()
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    codes = np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.zeros(len(codes) + 3, np.uint64)
    x[2:-1] = lower[codes]
    at = np.flatnonzero(x)
    a, b, c, d = x[at - 2], x[at - 1], x[at], x[at + 1]
    a = np.where(b == 0, 0, a)
    mix = lambda v, salt: ((v + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    p, q, r = np.uint64(0x100000001B3), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    features = np.stack([mix(b * p + c, 1), mix(b * p + c * q + d, 2), mix(a * r + b * p + c * q + d, 3)], 1).astype(np.int64)
    first = np.flatnonzero(b == 0)
    begin = np.cumsum(sizes) - sizes
    place = at[first] - 2
    word_text = np.searchsorted(begin, place, "right") - 1
    lengths = np.diff(np.r_[first, len(at)])
    return Grams(features, first, word_text, script[codes[place]], place - begin[word_text], place - begin[word_text] + lengths)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (ORDERS * BUCKETS, languages): log probabilities
    allowed: np.ndarray  # (scripts, languages)
    penalty: float

    def word_scores(self, g: Grams) -> np.ndarray:
        s = np.zeros((len(g.features), len(self.languages)), np.float32)
        for k in range(ORDERS):
            s += self.table[k * BUCKETS + g.features[:, k]]
        s = np.add.reduceat(s, g.word_start, axis=0) / ORDERS if len(g.word_start) else s
        ok = self.allowed[g.word_script]
        s = np.where(ok, s, s.min(1, keepdims=True) - 4 * self.penalty)
        return np.where(ok.any(1, keepdims=True), s, 0.0).astype(np.float64)

    def label(self, texts: list[str | None]) -> tuple[Grams, np.ndarray]:
        """A language for each word, on the best path."""
        g = grams(texts)
        s = self.word_scores(g)
        best = np.zeros(len(s), np.int64)
        if not len(s):
            return g, best
        starts = np.flatnonzero(np.r_[True, np.diff(g.word_text) > 0])
        sizes = np.diff(np.r_[starts, len(s)])
        sums = np.add.reduceat(s, starts, axis=0)
        main = sums.argmax(1)
        best[:] = np.repeat(main, sizes)
        # one language is the best path where no run of words gains a penalty by leaving it
        every = np.arange(len(s))
        others = s.copy()
        others[every, best] = -np.inf
        gain = np.cumsum(np.where(len(self.languages) > 1, others.max(1), s[every, best] - 1) - s[every, best])
        before = np.r_[0.0, gain[:-1]]
        before -= np.repeat(before[starts], sizes)
        gain -= np.repeat(np.r_[0.0, gain[:-1]][starts], sizes)
        apart = np.repeat(np.arange(len(starts)), sizes) * -(2.0 * np.abs(np.r_[gain, before]).max() + 1)
        run = gain - (np.minimum.accumulate(before + apart) - apart)
        mixed = np.flatnonzero(np.maximum.reduceat(run, starts) > self.penalty - 1e-6)
        if len(mixed):
            self._viterbi(s, best, starts[mixed], sizes[mixed])
        return g, best

    def _viterbi(self, s: np.ndarray, best: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """The best path of several texts in step, longest first."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]))]  # texts with more than t words
        value = s[starts]
        moved, source = np.zeros(s.shape, bool), np.zeros(len(s), np.int64)
        for t in range(1, int(sizes[0])):
            n = live[t]
            v, at = value[:n], starts[:n] + t
            top = v.argmax(1)
            jump = v[np.arange(n), top] - self.penalty
            source[at], moved[at] = top, jump[:, None] > v
            value[:n] = s[at] + np.maximum(v, jump[:, None])
        state = value.argmax(1)
        for t in range(int(sizes[0]) - 1, -1, -1):
            n = live[t]
            at = starts[:n] + t
            best[at] = state[:n]
            if t:
                state[:n] = np.where(moved[at, state[:n]], source[at], state[:n])


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, feature, n) over all rows: n-gram buckets, and behind them letters by script."""
    total = ORDERS * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in steps(whole, "__text"):
                g = grams(b.column("__text").to_pylist())
                if not len(g.word_start):
                    continue
                langs = b.column("__lang").to_pylist()
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs])[g.word_text]
                letters = np.diff(np.r_[g.word_start, len(g.features)])
                per_letter = np.repeat(code, letters)
                for k, name in enumerate(names):
                    row = counts.setdefault(name, np.zeros(total + len(NAMES), np.int64))
                    f = g.features[per_letter == k]
                    for o in range(ORDERS):
                        row[o * BUCKETS : (o + 1) * BUCKETS] += np.bincount(f[:, o], minlength=BUCKETS)
                    row[total:] += np.bincount(g.word_script[code == k], letters[code == k], len(NAMES)).astype(np.int64)
        for name, row in counts.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some.astype(np.int32)), pa.array(row[some])], ["lang", "feature", "n"])

    src = docs.select(F.col(text).alias("__text"), F.col(lang).alias("__lang")).where("__text is not null and __lang is not null")
    return src.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", penalty: float = 12.0, least_script: float = 0.005) -> Model:
    """A model from all rows with text and language."""
    found = count_grams(docs, text, lang).toPandas()
    languages, total = sorted(found["lang"].unique().tolist()), ORDERS * BUCKETS
    counts = np.zeros((total + len(NAMES), len(languages)))
    counts[found["feature"], found["lang"].map(languages.index).astype(int)] = found["n"]
    grams_of = counts[:total].reshape(ORDERS, BUCKETS, -1) + 0.5
    table = np.log(grams_of / grams_of.sum(1, keepdims=True)).reshape(total, -1).astype(np.float32)
    letters = counts[total:]
    return Model(languages, table, letters >= least_script * np.maximum(letters.sum(0), 1), penalty)


def label_spans(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_spans: bool = True) -> DataFrame:
    """``keep``, lang_pred, score and spans (code points of the first and behind the last word, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, whatever the corpus
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in steps(whole, "__text"):
                n = b.num_rows
                pred, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
                if m.languages:
                    g, best = m.label(b.column("__text").to_pylist())
                    share = np.zeros((n, len(m.languages)))
                    np.add.at(share, (g.word_text, best), (g.word_to - g.word_from).astype(float))
                    letters = share.sum(1)
                    for i in np.flatnonzero(letters):
                        k = int(share[i].argmax())
                        pred[i], score[i] = m.languages[k], float(share[i, k] / letters[i])
                    if with_spans and len(best):
                        new = np.flatnonzero(np.r_[True, (np.diff(g.word_text) > 0) | (np.diff(best) != 0)])
                        for i, last in zip(new, np.r_[new[1:] - 1, len(best) - 1]):
                            spans[g.word_text[i]].append({"start": int(g.word_from[i]), "end": int(g.word_to[last]), "lang": m.languages[best[i]]})
                columns, names = [*(b.column(k) for k in keep), pa.array(pred), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"]
                if with_spans:
                    columns, names = [*columns, pa.array(spans, span_type)], [*names, "spans"]
                yield pa.RecordBatch.from_arrays(columns, names)

    src = docs.select(*keep, F.col(text).alias("__text"))
    ddl = ", ".join([*(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string, score double"])
    return src.mapInArrow(run, ddl + (", spans array<struct<start: long, end: long, lang: string>>" if with_spans else ""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every document, and the number of its spans."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")))
    return label_spans(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
