"""Change sources: what a plan reads. Each has a pin, a relation as of a pin, and windows between pins."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Protocol
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.zset import WEIGHT, Delta, as_zset, consolidate, present, restrict, rewind
from . import log
from .store import SMALL, SMALL_BYTES, Pin, table, tagged_versions


class ChangeSource(Protocol):
    @property
    def ref(self) -> str: ...

    def pin(self, spark: SparkSession, last: Pin | None = None) -> Pin: ...

    def snapshot(self, spark: SparkSession, pin: Pin) -> DataFrame: ...

    def window(self, spark: SparkSession, pin: Pin, last: Pin | None, p: float | None) -> Delta: ...

    def before(self, spark: SparkSession, pin: Pin, last: Pin, window: Delta) -> DataFrame: ...


def full(df: DataFrame) -> Delta:
    return Delta(as_zset(df), is_full=True, unit=True)


@dataclass(frozen=True)
class TableSource:
    """A versioned table. versions: how many of them a run takes at most; None: all there are."""

    name: str
    versions: int | None = None

    @property
    def ref(self) -> str:
        return self.name

    def pin(self, spark: SparkSession, last: Pin | None = None) -> Pin:
        """The newest version, or as far from the last as a run goes."""
        pin = table(spark, self.name).pin()
        if self.versions and last and last.table_id == pin.table_id:
            return Pin(min(pin.version, last.version + self.versions), pin.table_id)
        return pin

    def snapshot(self, spark: SparkSession, pin: Pin) -> DataFrame:
        return table(spark, self.name).snapshot(pin.version)

    def before(self, spark: SparkSession, pin: Pin, last: Pin, window: Delta) -> DataFrame:
        return table(spark, self.name).snapshot(last.version)

    def key(self, spark: SparkSession) -> tuple[str, ...]:
        return tuple(table(spark, self.name).latest().pk or ())

    def rows(self, spark: SparkSession, pin: Pin) -> int:
        return table(spark, self.name).rows(pin.version)

    def window(self, spark: SparkSession, pin: Pin, last: Pin | None, p: float | None = None) -> Delta:
        """The change in (last, pin]. All rows instead, marked full, if there is no last, the table is
        another one now, the log no longer covers the window, or the change has more than a share p of the
        rows (an update counts twice)."""
        t = table(spark, self.name)
        if last is None or last.table_id != pin.table_id:
            return full(t.snapshot(pin.version))
        if last.version >= pin.version:
            return Delta(as_zset(spark.createDataFrame([], t.schema())), rows=0, unit=True, keyed=bool(t.latest().pk))
        found = t.changes(last.version, pin.version)
        if found is None:
            return full(t.snapshot(pin.version))
        most = None if p is None or p >= 1 else p * max(1, t.rows(pin.version))
        # the log has an upper bound; only where that passes is the consolidated window counted
        if most is not None and t.changed_rows(last.version, pin.version) > most:
            n = found.rows if found.rows is not None else found.zset.count()
            if n > most:
                return full(t.snapshot(pin.version))
        if found.rows is None and not t.changed_rows(last.version, pin.version):
            return replace(found, rows=0)
        return found


def changes_at_tag(spark: SparkSession, name: str, tag: str) -> Delta:
    """The consolidated change of all commits of a tag, and of no other; a tag not known is an empty one."""
    return table(spark, name).changes_of(tagged_versions(spark, name, tag))


def table_changes(spark: SparkSession, name: str, after: Pin | None, *, p: float | None = None) -> tuple[Delta, Pin]:
    """For a reader that keeps its own pin: the change since then, all rows if none, and the pin to keep."""
    source = TableSource(name)
    pin = source.pin(spark)
    return source.window(spark, pin, after, p), pin


def delta_of(spark: SparkSession, source: ChangeSource | str, pin: Pin, last: Pin | None, *, p: float | None = None) -> Delta:
    """A source's consolidated change in (last, pin], or all its rows, marked full, where there is none."""
    return (TableSource(source) if isinstance(source, str) else source).window(spark, pin, last, p)


def pin_table(spark: SparkSession, name: str) -> Pin:
    return table(spark, name).pin()


def read_as_of(spark: SparkSession, name: str, version: int) -> DataFrame:
    return table(spark, name).snapshot(version)


# ---- change logs of other engines --------------------------------------------------------------------


@dataclass(frozen=True)
class ChangelogLayout:
    """Names in a foreign producer's folder. The sidecar is JSON: table -> mode, pk, floor, f, f_base."""

    sidecar: str = "_changelog.json"
    epoch: str = "_epoch"
    weight: str = "_weight"
    warm: str = "__changelog"
    band: str = "__band"
    cold: str = "__base"


def spark_uri(location: str) -> str:
    """A folder as Spark reads it: no query, no last slash, s3 by Spark's connector."""
    if "://" not in location:
        return location.rstrip("/")
    u = urlsplit(location)
    return urlunsplit(("s3a" if u.scheme == "s3" else u.scheme, u.netloc, u.path.rstrip("/"), "", ""))


@dataclass(frozen=True)
class ChangelogSource:
    """A table that another engine publishes as Parquet parts stamped with an ordered epoch. Modes:
    overwrite (one file, replaced), append (parts, rows only added), merge (a base and signed change parts).
    Pins are epochs, kept as text, with the version 0."""

    folder: str
    name: str
    layout: ChangelogLayout = ChangelogLayout()

    @property
    def ref(self) -> str:
        return f"changelog:{spark_uri(self.folder)}::{self.name}"

    def _entry(self, spark: SparkSession) -> dict:
        path = f"{spark_uri(self.folder)}/{self.layout.sidecar}"
        found = json.loads(log.read(spark, path)).get(self.name) if log.exists(spark, path) else None
        if not found or found.get("f") is None:
            raise ValueError(f"{path} says nothing of {self.name}")
        return found

    def _parts(self, spark: SparkSession, suffix: str = "") -> list[str]:
        folder = f"{spark_uri(self.folder)}/{self.name}{suffix}"
        return [f"{folder}/{n}" for n in log.names(spark, folder) if n.endswith(".parquet")]

    def _signed(self, spark: SparkSession, lo, hi) -> DataFrame | None:
        """Signed changes of epochs in (lo, hi], of both tiers, or None if there are no parts."""
        parts = self._parts(spark, self.layout.warm) + self._parts(spark, self.layout.band)
        if not parts:
            return None
        df = spark.read.option("mergeSchema", "true").parquet(*parts)
        f = F.col(self.layout.epoch).cast("string")
        df = df.where((f <= str(hi)) if lo is None else (f > str(lo)) & (f <= str(hi)))
        return df.withColumn(WEIGHT, F.col(self.layout.weight).cast("long")).drop(self.layout.epoch, self.layout.weight)

    def pin(self, spark: SparkSession, last: Pin | None = None) -> Pin:
        return Pin(0, str(self._entry(spark)["f"]))

    def snapshot(self, spark: SparkSession, pin: Pin) -> DataFrame:
        e = self._entry(spark)
        single = f"{spark_uri(self.folder)}/{self.name}.parquet"
        if e["mode"] == "overwrite":
            return spark.read.parquet(single)
        if e["mode"] == "append":
            df = spark.read.option("mergeSchema", "true").parquet(*self._parts(spark))
            return df.where(F.col(self.layout.epoch).cast("string") <= pin.table_id).drop(self.layout.epoch)
        cold = self._parts(spark, self.layout.cold) or ([single] if log.exists(spark, single) else [])
        signed = self._signed(spark, e.get("f_base"), pin.table_id)
        if signed is None and not cold:
            raise ValueError(f"{self.ref} has neither base nor changes")
        net = None if signed is None else consolidate(signed)
        if not cold:
            return present(net)
        base = spark.read.parquet(*cold)
        base = base.drop(*[c for c in (self.layout.epoch, self.layout.weight) if c in base.columns])
        if net is None:
            return base
        pk = [e["pk"]] if isinstance(e["pk"], str) else list(e["pk"])
        return restrict(base, net.select(*pk).distinct(), pk, "left_anti").unionByName(present(net).select(*base.columns))

    def before(self, spark: SparkSession, pin: Pin, last: Pin, window: Delta) -> DataFrame:
        return rewind(self.snapshot(spark, pin), window.zset)

    def window(self, spark: SparkSession, pin: Pin, last: Pin | None, p: float | None = None) -> Delta:
        e, now = self._entry(spark), self.snapshot(spark, pin)
        if last is not None and last.table_id >= pin.table_id:
            return Delta(as_zset(now).limit(0), rows=0)
        floor = e.get("floor")
        if e["mode"] == "overwrite" or last is None or (floor is not None and last.table_id < str(floor)):
            return full(now)
        if e["mode"] == "append":
            parts = self._parts(spark)
            df = spark.read.option("mergeSchema", "true").parquet(*parts)
            f = F.col(self.layout.epoch).cast("string")
            found = as_zset(df.where((f > last.table_id) & (f <= pin.table_id)).drop(self.layout.epoch))
        else:
            signed = self._signed(spark, last.table_id, pin.table_id)
            if signed is None:
                return full(now)
            found = consolidate(signed.select(*now.columns, WEIGHT))
        unit = e["mode"] == "append"
        if p is not None and p < 1:
            n = found.count()
            if n and n > p * max(1, now.count()):
                return full(now)
            return Delta(found, rows=n, unit=unit, bytes=SMALL_BYTES + 1)
        return Delta(found, unit=unit)


def small(delta: Delta) -> bool:
    """Whether the change's rows are of a known size fit to broadcast."""
    return delta.rows is not None and delta.rows <= SMALL and (delta.bytes is None or delta.bytes <= SMALL_BYTES)
