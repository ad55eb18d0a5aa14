"""Packing against the library's ids; archives by round trip."""

import io
import uuid
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import packing, warc_archive
from caseflow.llm._common import shared_dir
from conftest import same_as_sql


def check_packed(rows, texts, settings, encode):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, copies in texts.items():
        pieces = sorted((p for p in by_doc.pop(doc_id)), key=lambda p: p["start"])
        ids = np.array([*encode(copies[0] or ""), settings.end_token], "<u4")
        if len(copies) == 1:
            at = 0
            for p in pieces:
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
        else:
            assert sum(p["length"] for p in pieces) == len(copies) * len(ids)
    assert not by_doc
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= settings.window
        short += at < settings.window
    assert short <= 1


def test_documents(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: [r["text"]] for r in docs.collect()}
    check_packed(packing.query(spark, sf_dir).collect(), texts, packing.Settings(), lambda x: t.encode(x, add_special_tokens=False).ids)


def test_many_partitions_and_edge_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(k, f"word{k} " * (k % 40)) for k in range(200)] + [(500, None), (501, ""), (502, "long <|endoftext|> " * 900), (503, "twice"), (503, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23).withColumn("start", F.lit("clash"))
    small = packing.Settings(window=64, open_windows=3, fan_in=4)
    out = packing.pack_documents(docs, path, small).collect()
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(text)
    check_packed(out, texts, small, lambda x: t.encode(x, add_special_tokens=False).ids)
    assert packing.pack_documents(docs.limit(0), path, small).count() == 0


def test_very_long_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "A long text of many words, 12 at a time. " * 60_000 + "x" * 50_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    encode = lambda x: Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids
    check_packed(packing.pack_documents(docs, path).collect(), {1: [text], 2: ["short"]}, packing.Settings(), encode)


def test_no_pages_and_clashing_columns(spark):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], "page_id long, url string, html string, sha string, size int, n int")
    archives = warc_archive.write_archives(warc_archive.plan_records(none), folder)
    assert warc_archive.read_records(warc_archive.list_records(archives, folder), folder).count() == 0
    page = spark.createDataFrame([(1, "u", "é" * 400_000, "x", 1, 1)], none.schema)
    archives = warc_archive.write_archives(warc_archive.plan_records(page), folder)
    assert warc_archive.read_records(warc_archive.list_records(archives, folder), folder).first()["payload_bytes"] == 800_000


def test_pages_equal_sql(spark, sf_dir):
    assert same_as_sql(spark, warc_archive.query, warc_archive.ORACLE, sf_dir) > 0


def test_round_trip_with_copies(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", None), (4, "u", ""), (5, None, "é\r\n\r\n"), (None, "x\r\nInjected: y", "aa"), (2, "u", "aa"), (6, "u", "z" * 300_000)]
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archives = warc_archive.write_archives(warc_archive.plan_records(pages), folder, archive_bytes=200)
    out = warc_archive.read_records(warc_archive.list_records(archives, folder), folder, with_body=True).collect()
    assert archives.count() > 1 and len(out) == len(rows)
    found = sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["record_type"], r["refers_to"], bytes(r["body"])) for r in out)
    assert found == [(-1, 2, "revisit", 2, b""), (1, 2, "revisit", 2, b""), (2, 2, "response", None, b"aa"), (2, 2, "response", None, b"aa"), (3, 0, "revisit", 4, b""), (4, 0, "response", None, b""), (5, 6, "response", None, "é\r\n\r\n".encode()), (6, 300_000, "response", None, b"z" * 300_000)]
    with zipfile.ZipFile(f"{folder}/{archives.first()['archive']}".removeprefix("file://")) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    least = warc_archive.plan_records(pages, least_bytes=1)
    assert {(r["page_id"], r["revisit"]) for r in least.where("page_id in (3, 4)").collect()} == {(3, False), (4, False)}


class Buffer:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment that looks like a record"])
def test_directories(comment, monkeypatch):
    def made(zip64):
        out = io.BytesIO()
        with monkeypatch.context() as m:
            if zip64:
                m.setattr(zipfile, "ZIP64_LIMIT", 10)
                m.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("first", b"x" * 50)
                z.writestr("zweité", b"data")
                z.writestr("packed", b"y" * 500, zipfile.ZIP_DEFLATED)
                z.comment = comment
        return out.getvalue()

    for zip64 in (False, True):
        data = made(zip64)
        assert (b"PK\x06\x06" in data) == zip64
        members = warc_archive.zip_members(Buffer(data))
        assert set(members) == {"first", "zweité"}
        at, n = members["zweité"]
        assert data[at : at + n] == b"data"


def test_broken_archives():
    with pytest.raises(ValueError):
        warc_archive.zip_members(Buffer(b"nothing here" * 10))
    with pytest.raises(ValueError):
        warc_archive.parse_record(zlib.compress(b"HTTP/1.1\r\n\r\n", wbits=31))
