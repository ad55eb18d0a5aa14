"""Fill-in-middle: texts cut in prefix, middle and suffix, and reordered, with a wavelet matrix to locate the cuts.

The bytes of many texts form one sequence of character classes (``BLANK`` to ``MORE_CLOSING``), held as a wavelet
matrix. The tokens before a byte are the words that close before it: the sum of two ranks. A cut after the u-th
token is found by bisection on that sum, for all texts of a step at once; code points are three ranks more. A
token is a word with the white space before it; white space at the end of a text is a token of its own.

Which form a document gets, and where it is cut, follows from a hash of its id alone, so a rerun or another
partitioning gives the same rows.

Defined results: null text is empty; an empty text and one that holds a mark stay plain (their counts are null);
a null id is hashed as no digits; rows that repeat are cut alike; an empty table gives no rows; other columns are
ignored. A text of any length is cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm._common import read, steps

#: Classes of a byte: white space; a character of one byte; the first byte of a longer character; a later byte of
#: one. The last byte of a word closes it.
BLANK, SINGLE, SINGLE_CLOSING, FIRST, MORE, MORE_CLOSING = range(6)
LEVELS = 3

FORM = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    #: Documents in a hundred that are reordered, and those of them with the suffix first.
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class BitVector:
    """Bits with rank in constant time: words of 64 bits and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """A sequence of small symbols with rank: one bit vector a level, each level sorted stably by the bit of the one before."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.size = [], len(symbols)
        for k in reversed(range(levels)):
            ones = (symbols >> k) & 1 == 1
            self.levels.append((k, BitVector(ones), len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in front of each position."""
        first = np.zeros(1, np.int64)
        for k, bits, zeros in self.levels:
            if symbol >> k & 1:
                at, first = zeros + bits.rank(at), zeros + bits.rank(first)
            else:
                at, first = at - bits.rank(at), first - bits.rank(first)
        return at - first


def byte_classes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that lie one behind the other and end at ``ends``."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    later = (data & 0xC0) == 0x80
    closing = np.ones(len(data), bool)
    closing[:-1] = blank[1:]
    closing[ends[ends > 0] - 1] = True
    closing &= ~blank
    # the last byte of a longer character is never its first
    kinds = np.where(later, np.where(closing, MORE_CLOSING, MORE), np.where(data >= 0x80, FIRST, np.where(closing, SINGLE_CLOSING, SINGLE)))
    return np.where(blank, BLANK, kinds).astype(np.uint8)


class Boundaries:
    """Token and code point counts of texts, and the place of any token's end."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.matrix = WaveletMatrix(byte_classes(data, self.ends), LEVELS)
        self.closed_before = self._closed(self.starts)
        self.words = self._closed(self.ends) - self.closed_before
        trailing = np.zeros(len(texts), bool)
        some = sizes > 0
        trailing[some] = self.matrix.rank(BLANK, self.ends[some]) > self.matrix.rank(BLANK, self.ends[some] - 1)
        self.tokens = self.words + trailing

    def _closed(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(SINGLE_CLOSING, at) + self.matrix.rank(MORE_CLOSING, at)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The position behind the first ``units`` tokens of each text."""
        wanted = self.closed_before + np.minimum(units, self.words)
        low, high = self.starts.copy(), self.ends.copy()
        while (low < high).any():
            middle = (low + high) // 2
            enough = self._closed(middle) >= wanted
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return np.where(units > self.words, self.ends, low)

    def chars(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code points between two positions: all bytes that aren't later bytes of a character."""
        return (b - a) - sum(self.matrix.rank(c, b) - self.matrix.rank(c, a) for c in (MORE, MORE_CLOSING))


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str, s: Settings = Settings()) -> bytes:
    p, x, m = s.prefix.encode(), s.suffix.encode(), s.middle.encode()
    return p + prefix + x + suffix + m + middle if form == "psm" else x + suffix + p + prefix + m + middle


def restored(output: bytes, form: str, s: Settings = Settings()) -> bytes:
    """The text behind an output; marks occur once each there, as texts that hold one stay plain."""
    if form == "plain":
        return output
    p, x, m = s.prefix.encode(), s.suffix.encode(), s.middle.encode()
    head, _, middle = output.partition(m)
    if form == "psm":
        prefix, _, suffix = head.removeprefix(p).partition(x)
    else:
        suffix, _, prefix = head.removeprefix(x).partition(p)
    return prefix + middle + suffix


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 that belong to a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def _reordered(ids: list[int | None], texts: list[bytes], s: Settings) -> dict[str, list]:
    marks = [m.encode() for m in (s.prefix, s.suffix, s.middle)]
    found = Boundaries(texts)
    drawn = np.array([draws(i, s.seed) for i in ids], np.int64).reshape(-1, 4)
    one, two = drawn[:, 0] % (found.tokens + 1), drawn[:, 1] % (found.tokens + 1)
    a, b = found.cut(np.minimum(one, two)), found.cut(np.maximum(one, two))
    prefix_chars, middle_chars = found.chars(found.starts, a), found.chars(a, b)
    out: dict[str, list] = {c: [] for c in ("form", "prefix_chars", "middle_chars", "output", "restored")}
    for k, text in enumerate(texts):
        x, y = int(a[k] - found.starts[k]), int(b[k] - found.starts[k])
        if not text or drawn[k, 2] % 100 >= s.rate or any(m in text for m in marks):
            form, output, counts = "plain", text, (None, None)
        else:
            form = "spm" if drawn[k, 3] % 100 < s.suffix_first else "psm"
            output, counts = arranged(text[:x], text[x:y], text[y:], form, s), (int(prefix_chars[k]), int(middle_chars[k]))
        for c, v in zip(out, (form, *counts, output, restored(output, form, s))):
            out[c].append(v)
    return {"doc_id": ids, "n": found.tokens.tolist(), **out}


def _mapped(docs: DataFrame, settings: Settings, text: str, doc_id: str, digests: bool) -> DataFrame:
    schema = FORM if not digests else FORM.replace("output string, restored string", "output_sha256 string, restored_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "__text"):
                texts = pc.fill_null(pc.cast(b.column("__text"), pa.binary()), b"").to_pylist()
                rows = _reordered(b.column("__id").to_pylist(), texts, settings)
                last = [rows.pop("output"), rows.pop("restored")]
                columns = [pa.array(rows[c], pa.string() if c == "form" else pa.int64()) for c in rows]
                if digests:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in v]) for v in last]
                else:
                    columns += [pa.array(v, pa.binary()).cast(pa.string()) for v in last]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    src = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(run, schema)


def reorder(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: FORM, with the output and the text that is rebuilt from it."""
    return _mapped(docs, settings, text, doc_id, False)


def reordered_digests(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As ``reorder``, but with SHA-256 digests of the output and of the rebuilt text."""
    return _mapped(docs, settings, text, doc_id, True)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all documents in fill-in-middle form."""
    return reordered_digests(read(spark, sf_dir, "documents"))


ORACLE = r"""
with cut as (
    select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id) as h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
    from documents),
drawn as (
    select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
        ('0x' || substr(h, 17, 8))::bigint % 100 as c, ('0x' || substr(h, 25, 8))::bigint % 100 as d
    from cut),
formed as (
    select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 50 then 'plain' when d < 80 then 'spm' else 'psm' end as form,
        coalesce(array_to_string(u[1:least(a, b)], ''), '') as p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') as m,
        coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') as s
    from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from formed
"""
