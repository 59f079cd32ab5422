"""Small files on whatever file system Spark reads: the commit log's storage.

Paths go through Hadoop's file systems, so a table lives wherever Spark's own files can. A commit is
published by giving a complete file its name, which fails if the name is taken: of two writers one loses.
That is atomic on local disks and HDFS. An object store whose connector renames by copying has a moment in
which two writers may both pass; there, let one writer at a time write a table.
"""

from __future__ import annotations

import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer published the same version first."""


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return (parsed.path if parsed.scheme else path) if parsed.scheme in ("", "file") else None


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    if (at := _local(folder)) is not None:
        return sorted(os.listdir(at)) if os.path.isdir(at) else []
    p, fs = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    if (at := _local(path)) is not None:
        return os.path.exists(at)
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, path: str) -> str:
    if (at := _local(path)) is not None:
        with open(at, encoding="utf-8") as f:
            return f.read()
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """The text as a new file; CommitConflict if there is one of that name."""
    folder, _, name = path.rpartition("/")
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if (at := _local(path)) is not None:
        os.makedirs(_local(folder), exist_ok=True)
        with open(_local(temp), "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(_local(temp), at)
        except FileExistsError as e:
            raise CommitConflict(f"{path} is taken") from e
        finally:
            os.unlink(_local(temp))
        return
    jvm = spark.sparkContext._jvm
    p, fs = _hadoop(spark, temp)
    out = fs.create(p, True)
    out.write(text.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(p, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception as e:
        fs.delete(p, False)
        raise CommitConflict(f"{path} is taken") from e


def publish_once(spark: SparkSession, path: str, text: str) -> None:
    """As publish, for a file that says the same whoever wrote it."""
    try:
        publish(spark, path, text)
    except CommitConflict:
        pass


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    if (at := _local(path)) is not None:
        return os.path.getsize(at) if os.path.isfile(at) else sum(e.stat().st_size for e in os.scandir(at) if e.is_file()) if os.path.isdir(at) else 0
    p, fs = _hadoop(spark, path)
    return fs.getContentSummary(p).getLength()


def ages(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Names in a folder with the seconds since each was changed."""
    if (at := _local(folder)) is not None:
        return [(e.name, time.time() - e.stat().st_mtime) for e in os.scandir(at)] if os.path.isdir(at) else []
    p, fs = _hadoop(spark, folder)
    return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder, with all in it, if it is there."""
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)
