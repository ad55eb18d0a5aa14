"""Text files in which markers begin pages, as a data source that many tasks read one file with, and as a stream.

A file is dealt out in byte ranges. A page belongs to the range in which its marker begins: the task of a range looks for
the first marker behind its start and reads on, past its end, until the next range's first marker. So no split
points have to be found beforehand, and a task holds one page and one block, not a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from caseflow.sources.shared import open_store

ROWS = "path string, page_no int, text string"
MARKER = r"\[P(?:Á|A)GINA (\d+)\]"
RANGE = 8 << 20
BLOCK = 1 << 20
#: Bytes that a marker has at most.
LONGEST = 256
_SPACE = " \t\n\x0b\f\r"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def pages_in(path: str, start: int, end: int, marker: str = MARKER, block: int = BLOCK) -> Iterator[tuple[str, int, str]]:
    """The pages whose markers begin in the bytes ``start`` to ``end`` of a file."""
    store, at = open_store(path)
    found = re.compile(marker.encode())
    with store.open_input_file(at) as f:
        f.seek(start)
        buffer, base, page, body = b"", start, None, []
        while True:
            more = f.read(block)
            buffer += more
            # a marker may go on in the next block
            safe = len(buffer) if not more else max(0, len(buffer) - LONGEST)
            done = 0
            for m in found.finditer(buffer):
                if m.start() >= safe and more:
                    break
                if page is not None:
                    body.append(buffer[done : m.start()])
                    yield path, page, b"".join(body).decode("utf-8", "replace").strip(_SPACE)
                if base + m.start() >= end:
                    return
                page, body, done = int(m[1]), [], m.end()
            keep = max(done, safe)
            if page is not None:
                body.append(buffer[done:keep])
            elif base + keep >= end:
                return
            buffer, base = buffer[keep:], base + keep
            if not more:
                break
        if page is not None:
            yield path, page, b"".join(body).decode("utf-8", "replace").strip(_SPACE)


def _files(path: str) -> list[fs.FileInfo]:
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path.removeprefix(at).split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and not hidden(f)), key=lambda f: (f.mtime_ns, f.path))


class _Reading:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.marker = options.get("marker", MARKER)
        self.size = int(options.get("rangeBytes", RANGE))
        self.scheme = "file://" if self.path.startswith("file:") else ""

    def ranges(self, files: list[fs.FileInfo]) -> list[Range]:
        return [Range(f"{self.scheme}{f.path}", a, min(a + self.size, f.size)) for f in files for a in range(0, f.size, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from pages_in(partition.path, partition.start, partition.end, self.marker)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges(_files(self.path)) or [Range(self.path, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return super().read(partition) if partition.end else iter(())


class _Stream(_Reading, DataSourceStreamReader):
    """Files in the order in which they were put in place; a file is put there whole."""

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        last = (_files(self.path) or [None])[-1]
        return {"time": last.mtime_ns, "path": last.path} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        place = lambda o: (o["time"], o["path"])
        return self.ranges([f for f in _files(self.path) if place(start) < (f.mtime_ns, f.path) <= place(end)])

    def commit(self, end: dict) -> None:
        """Nothing is held."""


class PageFiles(DataSource):
    """``format("pages")``; options: marker, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def read_pages(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """(path, page_no, text) of the files below ``path``; text before a file's first marker belongs to no page."""
    spark.dataSource.register(PageFiles)
    return (spark.readStream if stream else spark.read).format("pages").options(**options).load(path)
