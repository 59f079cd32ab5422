"""Shared pieces of the training-data operators: shared-folder tables and files, input helpers.

Every intermediate goes to the folder the cluster names in ``spark.checkpoint.dir``; only where that is
unset and all of Spark runs on one machine (tests, notebooks) is a folder of our own made. Nothing is kept on
one executor's disk, so a lost executor costs recomputation of its tasks and nothing else.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every scratch column an operator adds to a caller's frame.
SCRATCH = "__llm_"

#: A word is a maximal run of anything but space and the control characters TAB to CR.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, with a local master alone, one made here
    where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ivmspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; no two calls share one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back: later reads recompute nothing,
    and a lost executor loses none of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def q(name: str) -> str:
    """A column's name as a quoted identifier: any name is one column, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> "F.Column":
    return F.col(q(name))


def cols(df: DataFrame) -> list:
    return [col(c) for c in df.columns]


def free(df: DataFrame, name: str) -> str:
    """The name, or with a number after it the first that no column has (names differ by case or not)."""
    taken = {c.lower() for c in df.columns}
    return next(x for i in range(len(taken) + 1) if (x := f"{name}_{i}" if i else name).lower() not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_safe_key(column) -> "F.Column":
    """A string column as a key that is never null, null and '' apart."""
    c = col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


# ---- raw files in the shared folder, from executors -------------------------------------------------


def _filesystem(uri: str):
    """(filesystem, path) for a folder URI: plain paths and file: go to the local mount, other schemes
    to the store client pyarrow has for them."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path if parsed.scheme else uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write the byte chunks as one file; returns its length. A retried task writes another name, so a
    half-written file is never listed."""
    store, path = _filesystem(uri)
    if hasattr(store, "create_dir"):
        store.create_dir(os.path.dirname(path), recursive=True)
    n = 0
    with store.open_output_stream(path, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    return n


def open_file(uri: str):
    """A seekable binary file object on the shared store."""
    store, path = _filesystem(uri)
    return store.open_input_file(path)


def read_file(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()


# ---- Arrow helpers ----------------------------------------------------------------------------------

#: Arrow batches that go to a Python worker hold no more than this, whatever the row count; one text that
#: is larger comes alone.
BATCH_BYTES, BATCH_ROWS = "4m", 1024


#: The one model a Python worker keeps from task to task, under its key.
_RESIDENT: dict = {}


def resident(key, make):
    """A model that takes time to make, kept by the worker until a task of another operator comes."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def release() -> None:
    if _RESIDENT:
        import gc

        _RESIDENT.clear()
        gc.collect()


def arrow_map(df: DataFrame, run, schema, model: bool = False) -> DataFrame:
    """mapInArrow, columns by their places, with batches of bounded bytes, so that a worker's memory doesn't follow the texts' length.
    The two settings are left in the session: the plan reads them when it runs. model: run asks for a
    resident one; other tasks let go of what an earlier operator's has left in the worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def clean(batches):
        release()
        yield from run(batches)

    # by place: a name with a dot in it isn't taken for a column there
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run if model else clean, schema)


def utf8(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column) -> list[str]:
    """An Arrow string column as str, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]
