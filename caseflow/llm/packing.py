"""Packing token sequences into fixed windows: bounded-space, online, best fit.

Each partition keeps ``open_windows`` open. A piece goes to the fullest window with room for it; if
none has room, a new window opens while there is space for one, else the fullest window takes the
first part of the piece, is full, and is emitted. What is open at a partition's end is merged in
rounds of ``fan_in`` partitions until one task holds the last few windows: every round sees at most
``fan_in * open_windows`` windows per task, whatever the corpus. Only the very last window of all can
be short of its size.

Defined results: null text is empty and packs as its end token alone; repeated rows are packed one
by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm._common import read, stash

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@dataclass(frozen=True)
class Settings:
    window: int = 2048
    end_token: int = 1
    open_windows: int = 32
    fan_in: int = 16


@dataclass
class Window:
    used: int = 0
    #: (doc_id, start, ids as bytes, doc_tokens)
    pieces: list = field(default_factory=list)

    def add(self, doc_id, start, ids, doc_tokens) -> None:
        self.pieces.append((doc_id, start, ids, doc_tokens))
        self.used += len(ids) // 4


class Packer:
    """Open windows and their placement rule; ``full`` collects finished windows."""

    def __init__(self, settings: Settings):
        self.s, self.open, self.full = settings, [], []

    def place(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        size = self.s.window
        while ids:
            n = len(ids) // 4
            if n >= size:
                w = Window()
                w.add(doc_id, start, ids[: 4 * size], doc_tokens)
                self.full.append(w)
                start, ids = start + size, ids[4 * size :]
                continue
            fits = [w for w in self.open if w.used + n <= size]
            if fits:
                w, take = max(fits, key=lambda w: w.used), n
            elif len(self.open) < self.s.open_windows:
                self.open.append(w := Window())
                take = n
            else:
                w = max(self.open, key=lambda w: w.used)
                take = size - w.used
            w.add(doc_id, start, ids[: 4 * take], doc_tokens)
            start, ids = start + take, ids[4 * take :]
            if w.used == size:
                self.open.remove(w)
                self.full.append(w)

    def drain(self) -> list[Window]:
        done, self.full = self.full, []
        return done

    def merge_open(self) -> None:
        """Fill the open windows from each other, the emptiest into the fullest, until one at most is not full."""
        todo, self.open = sorted(self.open, key=lambda w: w.used), []
        while todo:
            w = todo.pop()
            while todo and w.used < self.s.window:
                doc_id, start, ids, doc_tokens = todo[0].pieces.pop()
                take = min(len(ids) // 4, self.s.window - w.used)
                w.add(doc_id, start, ids[: 4 * take], doc_tokens)
                todo[0].used -= len(ids) // 4
                if len(ids) > 4 * take:
                    todo[0].add(doc_id, start + take, ids[4 * take :], doc_tokens)
                if not todo[0].pieces:
                    todo.pop(0)
            (self.full if w.used == self.s.window else self.open).append(w)


def rows_of(windows: list[Window], first: int) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in COLUMNS}
    for k, w in enumerate(windows):
        offset = 0
        for doc_id, start, ids, doc_tokens in w.pieces:
            for c, v in zip(COLUMNS, (doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, first + k, offset)):
                out[c].append(v)
            offset += len(ids) // 4
    return out


def byte_level_encoder(file: bytes):
    """text -> ids as little-endian unsigned 32-bit integers, from the content of a byte-level BPE file of the tokenizers library.

    The file's merges are given to tiktoken as ranks: the same ids at several times the speed.
    """
    import tiktoken

    from caseflow.llm.bpe_automaton import byte_letters

    spec, letters = json.loads(file), byte_letters()
    ranks = {bytes(map(letters.__getitem__, label)): t for label, t in spec["model"]["vocab"].items()}
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    #: Fixed value: the split pattern of byte-level files that name none.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coder = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks={b: t for b, t in ranks.items() if b.decode("latin-1") not in specials}, special_tokens=specials)

    def encode(text: str) -> bytes:
        return coder.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes() if text else b""

    return encode


def pack_documents(docs: DataFrame, path: str, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: COLUMNS, in windows of ``settings.window`` tokens."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = byte_level_encoder(shared.value), Packer(settings), np.array([settings.end_token], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        made = 0
        for b in batches:
            ids, texts = b.column("__id").to_pylist(), b.column("__text")
            for k, i in enumerate(ids):
                coded = encode(texts[k].as_py() or "") + end
                packer.place(i, 0, coded, len(coded) // 4)
            done = packer.drain()
            if done:
                yield _batch(rows_of(done, (part << 36) + made))
                made += len(done)
        packer.merge_open()
        done = packer.drain()
        yield _batch(rows_of(done, (part << 36) + made))
        for k, w in enumerate(packer.open):
            yield _left(w, part)

    src = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    packed = stash(src.mapInArrow(first_round, f"{PIECE}, part int, ids binary"), "pack")
    done, left = [packed.where("ids is null").select(*COLUMNS)], packed.where("ids is not null")
    parts, level = left.agg(F.max("part")).first()[0], 1
    while parts is not None:
        last = parts < settings.fan_in
        merged = stash(_merge(left, settings, level, last), "pack")
        done.append(merged.where("ids is null").select(*COLUMNS))
        if last:
            break
        left, parts, level = merged.where("ids is not null"), parts // settings.fan_in, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    n = len(rows["doc_id"])
    return pa.RecordBatch.from_arrays([*(pa.array(rows[c], pa.int64()) for c in COLUMNS), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.binary())], [*COLUMNS, "part", "ids"])


def _left(w: Window, part: int) -> pa.RecordBatch:
    b = _batch(rows_of([w], 0))
    return pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([part] * b.num_rows, pa.int32()), pa.array([p[2] for p in w.pieces], pa.binary())], b.schema.names)


def _merge(left: DataFrame, settings: Settings, level: int, last: bool) -> DataFrame:
    """One round: the open windows of ``fan_in`` parts become full windows and at most one that is not."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        packer, part = Packer(settings), int(key[0])
        for r in pdf.sort_values(["part", "offset", "doc_id", "start"]).itertuples():
            packer.place(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), r.ids, int(r.doc_tokens))
        packer.merge_open()
        windows = packer.drain() + (packer.open if last else [])
        out = [pd.DataFrame(rows_of(windows, (level << 56) + (part << 36))).assign(part=None, ids=None)]
        if not last:
            for w in packer.open:
                out.append(pd.DataFrame(rows_of([w], 0)).assign(part=part, ids=[p[2] for p in w.pieces]))
        return pd.concat([o for o in out if len(o)] or out[:1])

    return left.groupBy((F.col("part") / settings.fan_in).cast("int").alias("group")).applyInPandas(run, f"{PIECE}, part int, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents in windows of 2048 tokens."""
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
