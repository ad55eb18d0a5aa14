"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. Rows are dealt to units, the rows that one task meets in a row. A unit sorts the fingerprints of its texts (the
   first bits of SHA-256), splits them by owner, and sends each owner the gaps between them in Golomb code: a few bits
   more than log2(range / rows) each. A fingerprint that a unit holds twice is sent once, so a text that
   a third of all rows share costs one entry a unit.
2. An owner decodes its messages and answers each with a bitmap: which of its fingerprints another unit holds too.
3. Units turn the bitmaps into marks on rows. What isn't marked is unique and done; its text goes nowhere.
4. Marked rows (suspects) are grouped by their normalised bytes. Spark combines copies within a task before the exchange
   and compares the bytes themselves, so texts that merely share a fingerprint part here.

Fingerprints are as long as the corpus needs (``spare_bits`` beyond log2 of its rows), so about one unique row in
2 ** spare_bits is a suspect for nothing. Rows, messages, answers and suspects are tables in the shared folder:
a lost executor costs a reread. No list of documents or fingerprints reaches the driver.

Texts are equal when they are after deleting ``BLANKS``. Of equal texts the row with the most code points stays; of those
that with the smallest id (null last), of those the first met.

Defined results: null text counts as empty; empty texts are copies of each other; rows that repeat an id are rows of
their own, of which one stays; an empty table gives no rows; columns of any name are kept by ``drop_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from caseflow.llm._common import fanout, read, stash, steps
from caseflow.sources.shared import open_store, work_path

#: Fixed value: the characters that don't count, space and the controls from tab to carriage return.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Settings:
    #: Rows of a unit: its fingerprints, and its bitmap, are held in memory at once.
    unit_rows: int = 1 << 16
    spare_bits: int = 10
    #: Fingerprints that one owner decodes, about.
    owner_rows: int = 1 << 21
    #: Answers of so many units lie in one folder.
    units_in_folder: int = 256


# ---- the code


def golomb_encode(values: np.ndarray, universe: int) -> bytes:
    """Sorted distinct integers below ``universe`` as gaps: quotients by a power of two in unary, then the remainders.

    The divisor is the power of two next to 0.69 times the mean gap, which is the best one for evenly spread values.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, round(float(np.log2(max(1.0, 0.69 * universe / n)))))
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    rest = (gaps[:, None] >> np.arange(k)) & 1
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(coded: bytes, n: int) -> np.ndarray:
    """The ``n`` integers behind ``coded``."""
    if not n:
        return np.zeros(0, np.int64)
    k, tail = coded[0], (n * coded[0] + 7) // 8
    body = np.frombuffer(coded, np.uint8, offset=1)
    zeros = np.flatnonzero(np.unpackbits(body[: len(body) - tail]) == 0)[:n]
    quotients = np.diff(zeros, prepend=-1) - 1
    rest = np.unpackbits(body[len(body) - tail :])[: n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + (rest << np.arange(k)).sum(axis=1) + 1) - 1


def fingerprints(digests: list[bytes], bits: int) -> np.ndarray:
    """The first ``bits`` bits of each digest."""
    whole = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
    return (whole >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """What all units and owners agree on: the bits of a fingerprint, and the range of fingerprints of each owner."""

    bits: int
    owners: int

    @property
    def width(self) -> int:
        return -(-(1 << self.bits) // self.owners)


def planned(rows: int, parts: int, s: Settings = Settings()) -> Plan:
    bits = min(62, max(16, int(rows).bit_length() + s.spare_bits))
    return Plan(bits, max(1, parts, -(-rows // s.owner_rows)))


def messages_of(found: np.ndarray, plan: Plan) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
    """The distinct fingerprints of a unit in order, and (owner, number, code) of each message with them."""
    distinct = np.unique(found)
    owner = distinct // plan.width
    cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
    return distinct, [(int(owner[a]), int(b - a), golomb_encode(distinct[a:b] - owner[a] * plan.width, plan.width)) for a, b in zip(cuts, cuts[1:])]


def answers_of(sent: list[np.ndarray]) -> list[bytes]:
    """For each message to one owner the bitmap of what another unit has sent as well."""
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    shared = values[counts > 1]
    return [np.packbits(np.isin(one, shared, assume_unique=True)).tobytes() for one in sent]


# ---- the jobs


def _parts(docs: DataFrame, text: str, plan: Plan, s: Settings) -> DataFrame:
    """Rows (unit, slot, digest, chars, row) and, with null rows, what the units send (unit, owner, n, code).

    A message also keeps which slots stand behind each of its fingerprints (``slots``, by the order of
    fingerprints; ``spread``: how many there are of each), for the unit's own use.
    """
    src = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    kinds = {"unit": LongType(), "slot": IntegerType(), "digest": BinaryType(), "chars": LongType(), "owner": LongType(), "n": IntegerType(), "code": BinaryType(), "slots": BinaryType(), "spread": BinaryType()}
    schema = StructType([StructField(c, t) for c, t in kinds.items()] + [StructField("row", src.schema["row"].dataType)])
    own = {"unit": pa.int64(), "slot": pa.int32(), "digest": pa.binary(), "chars": pa.int64(), "owner": pa.int64(), "n": pa.int32(), "code": pa.binary(), "slots": pa.binary(), "spread": pa.binary()}

    def table(size: int, row: pa.Array, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in own.items()), row], [*own, "row"])

    def sent(unit: int, digests: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
        found = fingerprints(digests, plan.bits)
        order = np.argsort(found, kind="stable").astype("<i4")
        distinct, messages = messages_of(found, plan)
        ends = np.searchsorted(found[order], distinct, side="right")
        out = {c: [] for c in ("unit", "owner", "n", "code", "slots", "spread")}
        at = 0
        for owner, n, code in messages:
            first = int(ends[at - 1]) if at else 0
            many = np.diff(ends[at : at + n], prepend=first).astype("<i4")
            for c, v in zip(out, (unit, owner, n, code, order[first : int(ends[at + n - 1])].tobytes(), many.tobytes())):
                out[c].append(v)
            at += n
        return table(len(messages), pa.nulls(len(messages), kind), **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, kind = TaskContext.get().partitionId() << 24, [], None
        for batch in batches:
            for b in steps(batch, "text"):
                texts, row = pc.fill_null(b.column("text"), ""), b.column("row")
                kind = row.type
                digests = [hashlib.sha256(t.translate(None, BLANKS)).digest() for t in pc.cast(texts, pa.binary()).to_pylist()]
                chars = pc.cast(pc.utf8_length(texts), pa.int64())
                at = 0
                while at < len(digests):
                    take = min(len(digests) - at, s.unit_rows - len(held))
                    yield table(take, row.slice(at, take), unit=[unit] * take, slot=range(len(held), len(held) + take), digest=digests[at : at + take], chars=chars.slice(at, take))
                    held += digests[at : at + take]
                    at += take
                    if len(held) == s.unit_rows:
                        yield sent(unit, held, kind)
                        unit, held = unit + 1, []
        if held:
            yield sent(unit, held, kind)

    return stash(src.mapInArrow(run, schema), "parts")


def _answers(parts: DataFrame, plan: Plan, s: Settings) -> DataFrame:
    """(unit, folder, marks): for each unit the bitmap of its rows, by slot, whose fingerprint isn't alone."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        sent = [golomb_decode(c, n) for c, n in zip(group["code"], group["n"])]
        return pd.DataFrame({"unit": group["unit"], "owner": group["owner"], "bitmap": answers_of(sent)})

    def marks(group: pd.DataFrame) -> pd.DataFrame:
        slots, marked = [], []
        for r in group.itertuples():
            many = np.frombuffer(r.spread, "<i4")
            shared = np.unpackbits(np.frombuffer(r.bitmap, np.uint8))[: len(many)].astype(bool)
            slots.append(np.frombuffer(r.slots, "<i4"))
            marked.append(np.repeat(shared | (many > 1), many))
        out = np.zeros(sum(map(len, slots)), np.uint8)
        out[np.concatenate(slots)] = np.concatenate(marked)
        unit = int(group["unit"].iloc[0])
        return pd.DataFrame({"unit": [unit], "folder": [unit // s.units_in_folder], "marks": [np.packbits(out).tobytes()]})

    sent = parts.where("code is not null")
    answered = sent.select("unit", "owner", "n", "code").groupBy("owner").applyInPandas(answer, "unit long, owner long, bitmap binary")
    met = sent.select("unit", "owner", "slots", "spread").join(answered, ["unit", "owner"])
    return met.groupBy("unit").applyInPandas(marks, "unit long, folder long, marks binary")


def _told_apart(rows: DataFrame, folder: str, suspect: bool, s: Settings) -> DataFrame:
    """Those of ``rows`` (with unit and slot) that are marked, or those that aren't: each task reads the bitmaps of the units that it meets."""

    def marks(unit: int) -> np.ndarray:
        store, path = open_store(f"{folder}/folder={unit // s.units_in_folder}")
        (one,) = ds.dataset(path, filesystem=store, format="parquet").to_table(["marks"], filter=ds.field("unit") == unit).column(0).to_pylist()
        return np.unpackbits(np.frombuffer(one, np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            unit, slot = b.column("unit").to_numpy(), b.column("slot").to_numpy()
            found = np.zeros(b.num_rows, bool)
            for u in np.unique(unit).tolist():
                if u not in known:
                    known = {u: marks(u)}  # a unit's rows lie together
                here = unit == u
                found[here] = known[u][slot[here]] == suspect
            yield b.filter(pa.array(found))

    return rows.mapInArrow(run, rows.schema)


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` as (doc_id, keep_id, group_size, kept, text_sha256, row): ``row`` holds the columns ``keep`` (all)."""
    plan = planned(docs.count(), fanout(docs), settings)
    parts = _parts(docs, text, plan, settings)
    folder = work_path(docs.sparkSession, "answers")
    _answers(parts, plan, settings).write.partitionBy("folder").parquet(folder)
    row, ident = F.struct(*(F.col("row")[c].alias(c) for c in keep or docs.columns)).alias("row"), F.col("row")[doc_id].cast("long").alias("doc_id")
    rows = parts.where("slot is not null")
    alone = _told_apart(rows.select("unit", "slot", "digest", ident, row), folder, False, settings)
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "row")
    suspects = stash(_told_apart(rows.select("unit", "slot", "digest", "chars", ident, F.col("row")[text].cast("string").alias("text"), row), folder, True, settings), "suspects")
    bare = F.translate(F.coalesce("text", F.lit("")), BLANKS.decode(), "")
    best = F.min(F.struct((-F.col("chars")).alias("shorter"), F.isnull("doc_id").alias("unnamed"), "doc_id", "unit", "slot"))
    classes = suspects.groupBy("digest", bare.alias("bare")).agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", "best", "group_size")
    met = suspects.join(classes, "digest")
    kept = (F.col("unit") == F.col("best.unit")) & (F.col("slot") == F.col("best.slot"))
    copies = met.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest", "row")
    return alone.unionByName(copies).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return grouped(rows, keep=["doc_id"], settings=settings).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    return grouped(docs, text, doc_id, settings=settings).where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: exact copies among all documents."""
    return exact_copies(read(spark, sf_dir, "documents"))


ORACLE = r"""
with plain as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents),
placed as (
    select doc_id, bare, count(*) over (partition by bare) as group_size,
        first_value(doc_id) over (partition by bare order by length(t) desc, doc_id) as keep_id
    from plain)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from placed
"""
