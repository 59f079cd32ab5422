"""A table's change feed as a Spark data source, for batch and streaming readers.

    spark.dataSource.register(ChangeFeed)
    spark.read.format("ivm_changes").option("path", table(spark, name).path).option("after", 3).load()
    spark.readStream.format("ivm_changes").option("path", ...).load()

Rows are those of the commits' segments, with the weight and ``_version`` columns; a base counts as all its
rows. Offsets are versions; each Parquet file of a commit is one partition, read where it is needed.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.zset import WEIGHT

VERSION = "_version"


def _fs(path: str):
    from urllib.parse import urlparse

    from pyarrow import fs

    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path if parsed.scheme else path
    return fs.FileSystem.from_uri(path)


def _commits(path: str) -> list[dict]:
    from pyarrow import fs

    store, root = _fs(f"{path}/_log")
    names = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name[:-5].isdigit() and f.base_name.endswith(".json")]
    out = []
    for n in sorted(names):
        with store.open_input_stream(n) as f:
            out.append(json.loads(f.read()))
    return out


class Part(InputPartition):
    def __init__(self, file: str, version: int, signed: bool):
        self.file, self.version, self.signed = file, version, signed


def _parts(path: str, lo: int, hi: int) -> list[Part]:
    from pyarrow import fs

    out = []
    for c in _commits(path):
        main = c["streams"].get("")
        if main and lo < c["version"] <= hi:
            store, folder = _fs(main["segment"] or main["base"])
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.base_name.endswith(".parquet"):
                    prefix = (main["segment"] or main["base"]).rstrip("/")
                    out.append(Part(f"{prefix}/{f.base_name}", c["version"], bool(main["segment"])))
    return out


def _read(schema: StructType, part: Part):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    store, file = _fs(part.file)
    for batch in pq.ParquetFile(store.open_input_file(file)).iter_batches(8192):
        n, columns = batch.num_rows, []
        for f in want:
            if f.name == VERSION:
                columns.append(pa.array([part.version] * n, pa.int64()))
            elif f.name == WEIGHT and not part.signed:
                columns.append(pa.array([1] * n, pa.int64()))
            else:
                columns.append(batch.column(f.name).cast(f.type))
        yield pa.RecordBatch.from_arrays(columns, schema=want)


class _Batch(DataSourceReader):
    def __init__(self, path: str, schema: StructType, lo: int, hi: int | None):
        self.path, self.schema, self.lo, self.hi = path, schema, lo, hi

    def partitions(self):
        hi = self.hi if self.hi is not None else max(c["version"] for c in _commits(self.path))
        return _parts(self.path, self.lo, hi) or [Part("", 0, True)]

    def read(self, partition):
        if partition.file:
            yield from _read(self.schema, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, after: int):
        self.path, self.schema, self.after = path, schema, after

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max(c["version"] for c in _commits(self.path))}

    def partitions(self, start: dict, end: dict):
        return _parts(self.path, start["version"], end["version"])

    def read(self, partition):
        yield from _read(self.schema, partition)

    def commit(self, end: dict) -> None:
        pass


class ChangeFeed(DataSource):
    """Options: path, the table's folder; after, the version behind the first to read (default: all);
    upto, the last (batch only)."""

    @classmethod
    def name(cls) -> str:
        return "ivm_changes"

    def schema(self) -> StructType:
        schemas = [s["schema"] for c in _commits(self.options["path"]) if (s := c["streams"].get(""))]
        return StructType([*StructType.fromJson(schemas[-1]).fields, StructField(WEIGHT, LongType()), StructField(VERSION, LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        upto = self.options.get("upto")
        return _Batch(self.options["path"], schema, int(self.options.get("after", -1)), None if upto is None else int(upto))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"], schema, int(self.options.get("after", -1)))
