"""Removal of long byte strings that occur more than once, by a logarithmic family of suffix arrays.

Every ``length``-byte window of a text has one anchor: the k-mer in it with the smallest hash. Equal
windows have equal anchors, so windows can only repeat where anchors do. Consecutive windows with the
same anchor form a stretch. One exchange by anchor leaves the stretches whose anchor occurs again;
equal stretches become one class with a count, and only one text per class is fetched.

The classes are dealt by anchor to buckets of bounded size. A bucket adds its classes batch by batch
to a family of suffix arrays: a new batch gets its suffix array, which is merge-scanned against every
existing level for common prefixes of ``length`` bytes, and levels of equal size merge, so there are
logarithmically many. Windows found again, or of a class counted twice, are repeated; every member of
the class gets them back. Anchors with very many classes are dealt by the bytes around them instead, and
what is still too much for a bucket by the windows themselves.

Stretches are one class by two 64-bit hashes; two different ones of n fall together with a chance of
about n * n / 2 ** 129. Everything else is compared by its bytes.

Defined results: null and short texts repeat nothing; matches never cross texts; rows that repeat a
doc_id are texts of their own, so two equal rows of ``length`` bytes or more lose everything; other
columns are kept by ``remove_repeats``, whose text drops bytes of characters that were cut in two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm._common import read, shielded, stash, steps


@dataclass(frozen=True)
class Settings:
    length: int = 200
    kmer: int = 64
    #: Windows that a bucket's suffix arrays should hold, and those of one batch.
    bucket_windows: int = 120_000
    batch_windows: int = 16_384
    #: Classes of one anchor beyond which its windows are dealt by the bytes around it.
    hot_classes: int = 1_000
    #: Bytes of a text that are hashed at once.
    piece_bytes: int = 4 << 20


# ---- anchors

BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Hashes:
    """Hash of any substring of a buffer in constant time."""

    def __init__(self, buffer: bytes):
        x = np.frombuffer(buffer, np.uint8)
        up, self.down = powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))[x] * up[:-1], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def stretches(texts: list[bytes], s: Settings) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, first window, windows, anchor within it, hashes of anchor and stretch."""
    buffer = b"".join(texts)
    n, width = len(buffer), s.length - s.kmer + 1
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    long = size >= s.length
    if not long.any():
        return {k: np.zeros(0, np.int64) for k in ("text", "first", "windows", "anchor", "khash", "shash")}
    edge = np.zeros(n + 1, np.int8)
    edge[(end - size)[long]] += 1
    edge[(end - s.length + 1)[long]] -= 1
    window = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    h = Hashes(buffer)
    kmers = n - s.kmer + 1
    khash = mixed((h.sums[s.kmer :] - h.sums[:kmers]) * h.down[:kmers])
    low = np.uint64((1 << 30) - 1)
    least = (khash & ~low) | np.arange(kmers, dtype=np.uint64)
    done = 1
    while 2 * done <= width:
        least[:-done] = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least[: done - width] = np.minimum(least[: done - width], least[width - done :])
    anchor = (least[window] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    first, windows, at = window[new], np.diff(np.r_[new, len(window)]), anchor[new]
    text = np.searchsorted(end, first, "right")
    return {
        "text": text,
        "first": first - (end - size)[text],
        "windows": windows,
        "anchor": at - first,
        "khash": khash[at].view(np.int64),
        "shash": (h(first, first + windows - 1 + s.length) ^ mixed(windows.astype(np.uint64))).view(np.int64),
    }


def anchored(docs: DataFrame, s: Settings) -> DataFrame:
    """All stretches of all texts; ``docs`` has __id, __tag and __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, "__text"):
                row, offset, pieces = [], [], []
                for k, t in enumerate(b.column("__text").to_pylist()):
                    raw = (t or "").encode()
                    for start in range(0, max(1, len(raw) - s.length + 1), s.piece_bytes):  # pieces share the windows' overhang
                        row.append(k), offset.append(start), pieces.append(raw[start : start + s.piece_bytes + s.length - 1])
                group, used = [], 0
                for k, p in enumerate(pieces):
                    group.append(k)
                    used += len(p)
                    if used >= s.piece_bytes or k == len(pieces) - 1:
                        g = stretches([pieces[i] for i in group], s)
                        if len(g["text"]):
                            rows = np.array([row[i] for i in group])[g["text"]]
                            first = g["first"] + np.array([offset[i] for i in group])[g["text"]]
                            yield pa.RecordBatch.from_arrays(
                                [b.column("__id").take(pa.array(rows)), b.column("__tag").take(pa.array(rows)), pa.array(g["khash"]), pa.array(g["shash"]), pa.array(first), pa.array(g["windows"].astype(np.int16)), pa.array(g["anchor"].astype(np.int16))],
                                ["__id", "__tag", "khash", "shash", "first", "windows", "anchor"],
                            )
                        group, used = [], 0

    return docs.mapInArrow(run, "__id long, __tag int, khash long, shash long, first long, windows short, anchor short")


# ---- the family of suffix arrays


@dataclass
class SuffixArray:
    """A text, and places in it in the order of the suffixes that begin there, by their first ``length`` bytes."""

    text: bytes
    places: np.ndarray
    #: What the caller calls the suffixes.
    numbers: np.ndarray

    @staticmethod
    def of(text: bytes, places: np.ndarray, numbers: np.ndarray, length: int) -> SuffixArray:
        order = np.argsort(heads(text, places, length), kind="stable")
        return SuffixArray(text, places[order], numbers[order])


def heads(text: bytes, places: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` bytes of the suffixes at ``places``, for comparing."""
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)
    return np.ascontiguousarray(view[places]).view(f"S{length}").ravel()


def common_prefixes(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """The bytes that each head of ``a`` shares with that of ``b``, ``length`` at most."""
    differ = a.view(np.uint8).reshape(-1, length) != b.view(np.uint8).reshape(-1, length)
    return np.where(differ.any(1), differ.argmax(1), length)


class SuffixFamily:
    """Levels of suffix arrays, each of twice as many batches as the one before. ``add`` marks the suffixes that match another one for ``length`` bytes."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[SuffixArray | None] = []
        self.hit = np.zeros(0, bool)

    def add(self, text: bytes, places: np.ndarray, repeated: np.ndarray) -> None:
        """A batch: suffixes of ``text`` at ``places`` with ``length`` bytes or more; ``repeated`` ones are known to match."""
        batch = SuffixArray.of(text, places, np.arange(len(places)) + len(self.hit), self.length)
        self.hit = np.r_[self.hit, repeated]
        own = heads(batch.text, batch.places, self.length)
        alike = common_prefixes(own[1:], own[:-1], self.length) >= self.length  # neighbours in the array
        self.hit[batch.numbers[np.r_[alike, False] | np.r_[False, alike]]] = True
        meets = [self._scan(level, batch.numbers, own) if level else None for level in self.levels]
        size = 0  # levels of equal size merge, as digits carry
        while size < len(self.levels) and self.levels[size] is not None:
            old = self.levels[size]
            place = meets[size] if not size else np.searchsorted(heads(old.text, old.places, self.length), heads(batch.text, batch.places, self.length))
            batch = SuffixArray(old.text + batch.text, np.insert(old.places, place, batch.places + len(old.text)), np.insert(old.numbers, place, batch.numbers))
            self.levels[size] = None
            size += 1
        self.levels += [None] * (size + 1 - len(self.levels))
        self.levels[size] = batch

    def _scan(self, level: SuffixArray, numbers: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Merge-scan: where the batch's suffixes go in the level; those whose neighbour there begins alike match it."""
        theirs = heads(level.text, level.places, self.length)
        place = np.searchsorted(theirs, own)
        behind = np.minimum(place, len(theirs) - 1)
        match = common_prefixes(theirs[behind], own, self.length) >= self.length
        self.hit[numbers[match]] = True
        self.hit[level.numbers[behind[match]]] = True
        return place


def repeated_windows(pdf: pd.DataFrame, s: Settings, keys: tuple[str, str]) -> pd.DataFrame:
    """The runs of repeated windows of each body in one bucket, as (keys, low, high), high behind the last window."""
    family, batch, members, used = SuffixFamily(s.length), [], [], 0

    def flush():
        nonlocal batch, used
        if batch:
            offsets = np.cumsum([0, *(len(b) for b, _, _ in batch)])
            starts = np.concatenate([np.arange(w) + o for o, (_, w, _) in zip(offsets, batch)])
            family.add(b"".join(b for b, _, _ in batch), starts, np.concatenate([np.full(w, n > 1) for _, w, n in batch]))
        batch, used = [], 0

    for body, w, n in zip(pdf["body"], pdf["windows"], pdf["n"]):
        batch.append((body, int(w), int(n)))
        members.append(int(w))
        used += int(w)
        if used >= s.batch_windows:
            flush()
    flush()
    hit = family.hit
    owner = np.repeat(np.arange(len(members)), members)
    inside = np.arange(len(hit)) - np.repeat(np.cumsum(members) - members, members)
    edge = np.r_[True, owner[1:] != owner[:-1]] if len(hit) else np.zeros(0, bool)
    begin = np.flatnonzero(hit & (edge | ~np.r_[False, hit[:-1]]))
    last = np.flatnonzero(hit & (np.r_[edge[1:], True] | ~np.r_[hit[1:], False]))
    k = owner[begin]
    base = pdf["base"].to_numpy()[k]
    return pd.DataFrame({**{c: pdf[c].to_numpy()[k] for c in keys}, "low": base + inside[begin], "high": base + inside[last] + 1})


# ---- the jobs


def class_texts(keyed: DataFrame, wanted: DataFrame, s: Settings, text: str) -> DataFrame:
    """One text per class (several parts for hot anchors): khash, shash, n, group, base, windows, body.

    Every column of ``keyed`` goes in, so that the exchange of the texts is the one that ``find_repeats`` needs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("khash", "shash", "n", "group", "base", "windows", "body")}
            texts, held = b.column(text), 0
            for k, cuts in enumerate(b.column("__cuts").to_pylist()):
                raw = (texts[k].as_py() or "").encode()
                for c in cuts:
                    parts = [(0, c["windows"], c["khash"])]
                    if c["hot"]:
                        parts = _parts(raw, c, s)
                    for base, windows, group in parts:
                        at = c["first"] + base
                        body = raw[at : at + windows - 1 + s.length]
                        held += len(body)
                        for name, v in zip(out, (c["khash"], c["shash"], c["n"], group, base, windows, body)):
                            out[name].append(v)
                if held > (4 << 20):
                    yield _class_batch(out)
                    out, held = {c: [] for c in out}, 0
            yield _class_batch(out)

    ddl = "khash long, shash long, n long, group long, base int, windows int, body binary"
    each = wanted.groupBy("__id", "__tag").agg(F.collect_list(F.struct("first", "windows", "anchor", "khash", "shash", "n", "hot")).alias("__cuts")).withColumnsRenamed({"__id": "__c_id", "__tag": "__c_tag"})
    return keyed.join(each, (keyed["__id"] == each["__c_id"]) & (keyed["__tag"] == each["__c_tag"])).mapInArrow(run, ddl)


def _parts(raw: bytes, c: dict, s: Settings, slices: int = 8) -> list[tuple[int, int, int]]:
    """A hot anchor's windows in slices by their distance from it; each is dealt by the bytes common to its windows."""
    out, width = [], (s.length - s.kmer) // slices + 1
    w = 0
    while w < c["windows"]:
        distance = c["anchor"] - w
        slice_no = distance // width
        last = min(c["windows"] - 1, c["anchor"] - slice_no * width)  # the last window of this slice
        anchor = c["first"] + c["anchor"]
        # every window of the full slice holds [low, high)
        low, high = anchor - slice_no * width, anchor - (slice_no * width + width - 1) + s.length
        core = raw[max(0, low) : high]
        key = hashlib.blake2b(core, digest_size=8, salt=bytes([slice_no])).digest()
        out.append((w, last - w + 1, int.from_bytes(key, "little", signed=True)))
        w = last + 1
    return out


def _class_batch(out: dict[str, list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def in_buckets(bodies: DataFrame, buckets: int, s: Settings, keys: tuple[str, str], kinds: str) -> DataFrame:
    """(keys, low, high): repeated windows of bodies, a family of suffix arrays per bucket of groups."""
    work = lambda pdf: repeated_windows(pdf, s, keys)
    return bodies.groupBy(F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket")).applyInPandas(work, f"{kinds}, low int, high int")


def hot_runs(parts: DataFrame, buckets: int, s: Settings) -> DataFrame:
    """(khash, shash, low, high) of parts of hot anchors. Equal parts are one, with their members counted together.

    A group that still holds more windows than a bucket is dealt by its windows: equal ones, by their bytes, combine
    before the exchange, so a string that very many texts hold is one row a task.
    """
    parts = parts.withColumn("part", F.md5("body"))
    once = stash(parts.groupBy("group", "part").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("body").alias("body")), "parts")
    crowded = once.groupBy("group").agg(F.sum("windows").alias("load")).where(F.col("load") > s.bucket_windows).select("group", F.lit(True).alias("crowded"))
    once = once.withColumn("base", F.lit(0)).join(stash(crowded, "crowded"), "group", "left")
    usual = in_buckets(once.where("crowded is null"), buckets, s, ("group", "part"), "group long, part string")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                p = b.slice(low, 256)
                count = p.column("windows").to_numpy()
                at = np.concatenate([np.arange(w) for w in count])
                row = pa.array(np.repeat(np.arange(len(count)), count))
                bodies = p.column("body").to_pylist()
                held = pa.array([bodies[k][i : i + s.length] for k, i in zip(row.to_numpy(), at)], pa.binary())
                yield pa.RecordBatch.from_arrays([p.column("group").take(row), p.column("part").take(row), p.column("n").take(row), pa.array(at.astype(np.int32)), held], ["group", "part", "n", "low", "window"])

    each = once.where("crowded").select("group", "part", "n", "windows", "body").mapInArrow(split, "group long, part string, n long, low int, window binary")
    each = stash(each, "windows")
    again = stash(each.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window"), "windows")
    found = usual.unionByName(each.join(again, "window").select("group", "part", "low", (F.col("low") + 1).alias("high")))
    return found.join(parts.select("khash", "shash", "group", "part", "base"), ["group", "part"]).select("khash", "shash", (F.col("low") + F.col("base")).alias("low"), (F.col("high") + F.col("base")).alias("high"))


def find_repeats(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__repeats``: array<struct<start, end>> of repeated bytes (null if none), unmerged.

    Rows are known by two hashes of their id and text, so repeated and null ids do no harm.
    """
    return shielded(docs, (doc_id, text), lambda rows: _with_repeats(rows, s, doc_id, text), "__repeats")


def _with_repeats(docs: DataFrame, s: Settings, doc_id: str, text: str) -> DataFrame:
    keyed = docs.select("*", F.xxhash64(doc_id, text).alias("__id"), F.hash(text).alias("__tag"))
    all_stretches = anchored(keyed.select("__id", "__tag", F.col(text).alias("__text")), s)
    # counts combine before they are exchanged; as both sides of the join are plain tables, Spark can split its large partitions
    recurring = stash(all_stretches.groupBy("khash").agg(F.count("*").alias("times")).where("times > 1").select("khash"), "anchors")
    again = stash(all_stretches.join(recurring, "khash"), "stretches")
    classes = again.groupBy("khash", "shash").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__tag", "first", "windows", "anchor")).alias("rep"))
    classes = stash(classes, "classes")
    windows = classes.agg(F.sum("rep.windows")).first()[0] or 0
    buckets = max(1, windows // s.bucket_windows)
    # as a plain table, so that Spark can broadcast it or split the classes of a hot anchor
    hot = stash(classes.groupBy("khash").count().where(F.col("count") > s.hot_classes).select("khash", F.lit(True).alias("hot")), "hot")
    wanted = classes.join(hot, "khash", "left").select("khash", "shash", "n", "rep.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    runs = in_buckets(class_texts(keyed, wanted.where("not hot"), s, text), buckets, s, ("khash", "shash"), "khash long, shash long")
    if hot.limit(1).count():
        runs = runs.unionByName(hot_runs(stash(class_texts(keyed, wanted.where("hot"), s, text), "parts"), buckets, s))
    span = F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") - 1 + s.length).alias("end"))
    found = again.join(runs, ["khash", "shash"]).select("__id", "__tag", span.alias("span"))  # a row per run, so that this join can be split as well
    found = found.groupBy(F.col("__id").alias("__f_id"), F.col("__tag").alias("__f_tag")).agg(F.collect_list("span").alias("__repeats"))
    met = keyed.join(found, (keyed["__id"] == found["__f_id"]) & (keyed["__tag"] == found["__f_tag"]), "left")
    return met.drop("__id", "__tag", "__f_id", "__f_tag")


def cut_out(raw: bytes, repeats: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``raw``, and the maximal removed runs."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in repeats or ()):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), runs


def measure_repeats(found: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans, kept_sha256 from ``find_repeats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = [], b.column("__text")
            for k, repeats in enumerate(b.column("__repeats").to_pylist()):
                raw = (texts[k].as_py() or "").encode()
                left, runs = cut_out(raw, repeats)
                rows.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()]))], [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    src = found.select(*keep, F.col(text).alias("__text"), "__repeats")
    ddl = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    return src.mapInArrow(run, ddl)


def remove_repeats(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes gone from ``text``; null stays null."""
    return shielded(docs, (doc_id, text), lambda rows: _without_repeats(rows, s, doc_id, text))


def _without_repeats(docs: DataFrame, s: Settings, doc_id: str, text: str) -> DataFrame:
    found = _with_repeats(docs, s, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(text), []
            for k, repeats in enumerate(b.column("__repeats").to_pylist()):
                t = texts[k].as_py()
                out.append(t if t is None or not repeats else cut_out(t.encode(), repeats)[0].decode("utf-8", "ignore"))
            columns = [pa.array(out, b.schema.field(c).type) if c == text else b.column(c) for c in b.schema.names if c != "__repeats"]
            yield pa.RecordBatch.from_arrays(columns, [c for c in b.schema.names if c != "__repeats"])

    return found.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: repeated strings of 200 bytes in all documents."""
    return measure_repeats(find_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")))
