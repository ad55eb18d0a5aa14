"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it names none: a folder of our own in local mode, as in tests; an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="caseflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """Where a new work table of this driver lies; ``clear_work`` deletes it."""
    _made.append(f"{shared_dir(spark)}/caseflow-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear_work() -> int:
    """Delete the work tables that this driver has made so far, and say how many there were.

    For when what was computed has been written: frames that came from operators still read these tables.
    """
    count = 0
    while _made:
        path = _made.pop()
        store, top = open_store(path)
        if store.get_file_info(top).type == fs.FileType.Directory:
            drop_folder(path)
            count += 1
    return count


def stream_of(batch: DataFrame, path: str) -> DataFrame:
    """The files of a Parquet table as a stream; the table may be a folder or a single file."""
    spark, name = batch.sparkSession, path.rsplit("/", 1)[-1]
    reader = spark.readStream.schema(batch.schema)
    single = any(f.rstrip("/").endswith("/" + name) for f in batch.inputFiles())
    return reader.option("pathGlobFilter", name).parquet(path.rsplit("/", 1)[0]) if single else reader.parquet(path)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file: a URI, or a plain path on a mounted store."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def numbered_folders(path: str, prefix: str = "batch=") -> list[int]:
    """The numbers n of the complete tables ``path``/``prefix``n, in order."""
    store, top = open_store(path)
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    numbers = [int(f.base_name.removeprefix(prefix)) for f in found if f.base_name.startswith(prefix)]
    return sorted(n for n in numbers if store.get_file_info(f"{top}/{prefix}{n}/_SUCCESS").type != fs.FileType.NotFound)


def drop_folder(path: str) -> None:
    store, top = open_store(path)
    store.delete_dir(top)
