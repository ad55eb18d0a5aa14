"""WARC records in ZIP-packaged archives: write, list, and range-read without extraction.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.cdxj`` (a line per record: id, offset, length, type). Tasks
write archives of bounded size into the shared folder; a retried task writes new files and only the
files of tasks that ended are listed. A reader finds the end-of-directory record (ZIP64 if there is
one) in the archive's tail, parses the central directory, reads the index member by its range, and
then reads each record by its own range.

Defined results: null html is an empty payload; of records with equal payloads of at least
``least_bytes`` bytes those with the largest page_id are responses, the others revisits; rows that
repeat both page_id and payload are all responses; a null page_id counts as smaller than any other
and keeps its row; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm._common import fanout, read, shared_dir, stash, steps
from caseflow.sources.shared import open_store

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

#: Signatures of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def bare_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, html_digest: str) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    body = b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{html_digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(body)),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n") + pack.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of one record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def page_of(urn: str | None):
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


# ---- ZIP directories


def read_range(f, start: int, length: int) -> bytes:
    got = f.read_at(length, start)
    if len(got) != length:
        raise EOFError(f"{length} bytes wanted at {start}, {len(got)} found")
    return got


def zip_members(f) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, length) of the stored members, from the central directory alone."""
    size = f.size()
    tail_from = max(0, size - 22 - 65535 - 20)  # a comment may follow the record, a ZIP64 locator precede it
    tail = read_range(f, tail_from, size - tail_from)
    at = tail.rfind(END)
    while at >= 0 and struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22:
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        if at < 20 or tail[at - 20 : at - 16] != LOCATOR64:
            raise ValueError("a ZIP64 archive without a locator")
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = read_range(f, where, 56)
        if record[:4] != END64:
            raise ValueError("a ZIP64 locator that leads nowhere")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, members, at = read_range(f, start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("a central directory cut short")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, name_len, extra_len, note_len = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values of the fields that overflow, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + n
        if method == 0:
            local = read_range(f, header, 30)
            if local[:4] != LOCAL:
                raise ValueError(f"no member at {header}")
            members[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + name_len + extra_len + note_len
    return members


# ---- Spark jobs


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, revisit, refers_to: what to write for each page.

    Only digests that occur more than once enter the join; Spark splits its large partitions, so a
    payload that a third of the pages share is no single task's work.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    seen = seen.where(F.octet_length("payload") >= least_bytes).groupBy(F.sha1("payload").alias("sha")).agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    joined = page.join(seen.where("n > 1").select("sha", "first"), "sha", "left")
    revisit = F.coalesce((F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 128 << 20) -> DataFrame:
    """Archives of about ``archive_bytes`` under ``folder``; returns (archive, records), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        current = None

        def finish():
            name, out, pack, data, index, _ = current
            data.close()
            pack.writestr(INDEX, "".join(index))
            pack.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], ["archive", "records"])

        for b in batches:
            for r in (r for part in steps(b, "payload") for r in part.to_pylist()):
                if current is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{top}/{name}")
                    pack = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)  # the stream can't seek; zipfile appends descriptors
                    current = [name, out, pack, pack.open(DATA, "w", force_zip64=True), [], 0]
                raw = record_bytes(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"], bare_sha1(r["payload"]))
                current[3].write(raw)
                current[4].append(json.dumps({"id": r["page_id"], "offset": current[5], "length": len(raw), "type": "revisit" if r["revisit"] else "response"}) + "\n")
                current[5] += len(raw)
                if current[5] >= archive_bytes:
                    yield finish()
                    current = None
        if current is not None:
            yield finish()

    return stash(records.mapInArrow(run, "archive string, records long"), "warc")


def list_records(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, start, length) of every record, from the archives' directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                with store.open_input_file(f"{top}/{name}") as f:
                    members = zip_members(f)
                    base, index = members[DATA][0], read_range(f, *members[INDEX])
                lines = [json.loads(x) for x in io.BytesIO(index)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([base + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], ["archive", "start", "length"])

    return archives.select("archive").mapInArrow(run, "archive string, start long, length long")


def read_records(ranges: DataFrame, folder: str, with_body: bool = False) -> DataFrame:
    """One row per record, each read by its own range and checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        for b in batches:
            rows = sorted(b.to_pylist(), key=lambda r: (r["archive"], r["start"]))
            out, name, f = [], None, None
            for r in rows:
                if r["archive"] != name:
                    if f is not None:
                        f.close()
                    name, f = r["archive"], store.open_input_file(f"{top}/{r['archive']}")
                head, body = parse_record(read_range(f, r["start"], r["length"]))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and bare_sha1(body) != digest:
                    raise ValueError(f"record at {r['start']} of {name} doesn't have its digest")
                out.append((page_of(head["warc-record-id"]), len(body) if head["warc-type"] == "response" else int(head["x-payload-length"]), digest, head["warc-type"], page_of(head.get("warc-refers-to")), body if with_body else None))
            if f is not None:
                f.close()
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"]
            n = 5 + with_body
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types)], names[:n])

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ranges.mapInArrow(run, ddl + (", body binary" if with_body else ""))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every page written to archives and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(plan_records(read(spark, sf_dir, "pages")), folder)
    ranges = list_records(archives, folder)
    return read_records(ranges.repartition(max(fanout(ranges), 2)), folder)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, max(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p),
bits AS (SELECT *, list_transform(range(0, 40), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i + 1]) - 1), 4, '0')) AS nibbles FROM d),
flat AS (SELECT *, array_to_string(nibbles, '') AS s FROM bits)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast(list_sum(list_transform(range(0, 5), lambda j: cast(s[i * 5 + j + 1] AS integer) * (1 << (4 - j)))) AS bigint) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM flat
"""
