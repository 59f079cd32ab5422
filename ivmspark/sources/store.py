"""Versioned tables over Parquet: a change log first, with snapshots to read from.

A table is a folder: ``_log/<version>.json`` for each commit, and Parquet folders. A commit names a
segment, the consolidated Z-set that the version adds, or a base, a whole relation; its counts answer
emptiness and change fractions without a Spark job. Files are written before the commit that names them, so
a crash leaves only files nobody reads. A commit may carry *sidecars*, named relations that move with the
table in the same commit: an aggregate's state is one, and can't drift from its output.

Writers are optimistic. A change that was computed from the table's rows is published as the version after
the one it was computed from; if another writer has taken that, it is a CommitConflict, the files are
removed, and the caller starts over. A change that doesn't depend on the rows (an insert) is published anew
behind the other writer's.

A snapshot is the newest base at or before the version and the segments after it. Segments that only add
rows are appended; else, with a primary key, that is an anti-join of the base by the changed keys, and
without one the rows' weights are summed. Each commit carries the table's *tip*: every stream's schema, base
and live segments, and the last run's metadata. So a reader needs the newest commit, however long the log.

Segments of about one size are merged into one as they gather (each row is rewritten a logarithm of times),
and a base is written anew only after changes of ``BASE_SHARE`` of its rows, so upkeep follows the changes,
not the table. Neither makes a version or a change. ``vacuum`` gives up windows and snapshots from before a
version and deletes what only they need: files, log entries, and what crashed writers left.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import warnings
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.zset import RESERVED, WEIGHT, Delta, as_zset, check_groupable, check_names, consolidate, diff, expand, present, q, restrict, union
from . import log

#: Segments of about one size that are merged into one; the share of a table's rows in segments after which
#: it gets a new base.
MERGE_AFTER, BASE_SHARE = 8, 0.5
#: Times that a change is published anew behind other writers', or computed anew after them.
ATTEMPTS = 8
#: A change of up to so many rows, in files of up to so many bytes, may be broadcast.
SMALL, SMALL_BYTES = 100_000, 8_000_000
#: Rows that a task has of what is dealt out by known numbers of rows; hashes of keys looked at one by one.
PART_ROWS, _LOOK = 1_000_000, 1000
MAIN = ""


@dataclass(frozen=True)
class Pin:
    """A version of one table; the id tells a table from another made later under its name."""

    version: int
    table_id: str


@dataclass(frozen=True)
class Commit:
    version: int
    table_id: str
    kind: str
    ts: float
    pk: tuple[str, ...] | None
    meta: dict
    streams: dict[str, dict] = field(default_factory=dict)  # name -> base, segment, schema, n_ins, n_del, n_rows
    #: Every stream as of this version: schema, pk, rows, base, base_at, segments (lo, hi, path, n_ins, n_del, unit).
    tip: dict[str, dict] = field(default_factory=dict)
    #: The newest run's metadata, and whether others have written rows since.
    stamp: dict | None = None
    others: bool = False


def root(spark: SparkSession) -> str:
    """Where tables live: spark.ivmspark.root, else a folder of the warehouse."""
    at = spark.conf.get("spark.ivmspark.root", None)
    return (at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/ivmspark").rstrip("/")


#: Commits read so far, by table path and version. They never change; a table made anew under a path has
#: another id, which the latest commit, read by each VersionedTable for itself, gives away.
_COMMITS: dict[str, dict[int, Commit]] = {}


def attempted(step, attempts: int = ATTEMPTS):
    """What step gives, tried again where another writer was first."""
    for left in reversed(range(attempts)):
        try:
            return step()
        except log.CommitConflict:
            if not left:
                raise


@dataclass(frozen=True)
class Listing:
    """One look at a log folder."""

    versions: list[int]
    floor: int
    bases: list[tuple[str, int, str]]  # stream, version, file
    runs: list[tuple[str, int, int, str]]  # stream, lo, hi, file


_MARK = re.compile(r"(base|run)-(\w*)-(\d+)(?:-(\d+))?\.json$")


class VersionedTable:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.path = f"{root(spark)}/{name.replace('.', '/')}"
        self._looked = False

    # ---- the log

    def _list(self) -> Listing:
        versions, floor, bases, runs = [], 0, [], []
        for n in log.names(self.spark, f"{self.path}/_log"):
            if n.endswith(".json") and n[:-5].isdigit():
                versions.append(int(n[:-5]))
            elif n.startswith("floor-"):
                floor = max(floor, int(n[6:-5]))
            elif m := _MARK.match(n):
                kind, stream, lo, hi = m.groups()
                bases.append((stream, int(lo), n)) if kind == "base" else runs.append((stream, int(lo), int(hi), n))
        return Listing(versions, floor, bases, runs)

    def exists(self) -> bool:
        return bool(self._list().versions)

    def _load(self, version: int) -> Commit:
        d = json.loads(log.read(self.spark, f"{self.path}/_log/{version:020d}.json"))
        return Commit(**(d | {"pk": None if d["pk"] is None else tuple(d["pk"])}))

    def commit_at(self, version: int) -> Commit:
        known = _COMMITS.setdefault(self.path, {})
        if not self._looked:
            last = self._load(self._list().versions[-1])
            if any(c.table_id != last.table_id for c in known.values()):
                known.clear()
            known[last.version] = last
            self._looked = True
        if version not in known:
            known[version] = self._load(version)
        return known[version]

    def history(self) -> list[Commit]:
        """All commits that are kept, newest first."""
        return [self.commit_at(v) for v in reversed(self._list().versions)]

    def head(self) -> int:
        """The newest version; -1 where there is no table."""
        return max(self._list().versions, default=-1)

    def latest(self) -> Commit:
        if (head := self.head()) < 0:
            raise ValueError(f"no table {self.name}")
        return self.commit_at(head)

    def pin(self) -> Pin:
        c = self.latest()
        return Pin(c.version, c.table_id)

    def floor(self) -> int:
        """Windows that start before this version, and snapshots before it, are given up."""
        return self._list().floor

    def _mark(self, name: str) -> dict:
        return json.loads(log.read(self.spark, f"{self.path}/_log/{name}"))

    def _live(self, version: int, stream: str, look: Listing | None = None) -> dict | None:
        """A stream's tip as of a version, with the bases and merged segments written since for it."""
        tip = self.commit_at(version).tip.get(stream)
        if tip is None:
            return None
        look = look or self._list()
        base, at, segments = tip["base"], tip["base_at"], tip["segments"]
        for _, v, name in sorted(b for b in look.bases if b[0] == stream and at < b[1] <= version):
            base, at = self._mark(name)["path"], v
        segments = [s for s in segments if s["hi"] > at]
        for _, lo, hi, name in sorted((r for r in look.runs if r[0] == stream and at <= r[1] and r[2] <= version), key=lambda r: r[1] - r[2]):
            within = [s for s in segments if lo <= s["lo"] and s["hi"] <= hi]
            if len(within) > 1 and within == [s for s in segments if s["lo"] < hi and s["hi"] > lo]:
                k = segments.index(within[0])
                segments = [*segments[:k], self._mark(name), *segments[k + len(within) :]]
        return tip | {"base": base, "base_at": at, "segments": segments}

    # ---- reading

    def schema(self, stream: str = MAIN) -> StructType | None:
        tip = self.latest().tip.get(stream)
        return tip and StructType.fromJson(tip["schema"])

    def columns(self, stream: str = MAIN) -> list[str]:
        s = self.schema(stream)
        return s.names if s else []

    def _parquet(self, schema: StructType, *paths: str, weighted: bool = False) -> DataFrame:
        if weighted:
            schema = StructType([*schema.fields]).add(WEIGHT, "long")
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _entries(self, lo: int, hi: int, stream: str) -> list[dict]:
        return [s for v in self._list().versions if lo < v <= hi and (s := self.commit_at(v).streams.get(stream))]

    def snapshot(self, version: int | None = None, stream: str = MAIN) -> DataFrame:
        """The relation as of a version, the latest if none is given."""
        look = self._list()
        version = max(look.versions, default=-1) if version is None else version
        if version < 0:
            raise ValueError(f"no table {self.name}")
        if version < look.floor:
            raise ValueError(f"{self.name}: version {version} is before the retained {look.floor}")
        live = self._live(version, stream, look)
        if live is None:
            raise ValueError(f"{self.name} has no {stream or 'data'}")
        schema, segments = StructType.fromJson(live["schema"]), live["segments"]
        base = self._parquet(schema, live["base"]) if live["base"] else None
        if not segments:
            return self._parquet(schema) if base is None else base
        changes = self._parquet(schema, *[s["path"] for s in segments], weighted=True)
        if not any(s["n_del"] for s in segments):
            added = (changes if all(s["unit"] for s in segments) else expand(changes)).drop(WEIGHT)
            return added if base is None else base.unionByName(added)
        net = changes if len(segments) == 1 else consolidate(changes)
        if base is None:
            return present(net)
        if pk := live["pk"]:
            small = sum(s["n_del"] for s in segments) <= SMALL
            gone = net.where(F.col(WEIGHT) < 0).select(*[F.col(q(c)) for c in pk])
            if not small and (parts := parted(self.spark, live["rows"])):
                return without(base, gone, pk, parts).unionByName(net.where(F.col(WEIGHT) > 0).drop(WEIGHT))
            return restrict(base, gone, pk, "left_anti", small).unionByName(net.where(F.col(WEIGHT) > 0).drop(WEIGHT))
        return present(union(as_zset(base), net))

    def changes(self, lo: int, hi: int, stream: str = MAIN) -> Delta | None:
        """The consolidated change of (lo, hi], or None where the log no longer covers it."""
        if lo < self.floor() or any(s.get("base") for s in self._entries(lo, hi, stream)):
            return None
        return self.changes_of([v for v in self._list().versions if lo < v <= hi], stream)

    def changes_of(self, versions, stream: str = MAIN) -> Delta:
        """The consolidated change of these versions alone; a base counts as all its rows."""
        schema = self.schema(stream)
        entries = [s for v in versions if (s := self.commit_at(v).streams.get(stream))]
        segments = [s for s in entries if s.get("segment")]
        bases = [s for s in entries if s.get("base")]
        parts = [self._parquet(schema, *[s["segment"] for s in segments], weighted=True)]
        parts += [as_zset(self._parquet(schema, s["base"])) for s in bases]
        n = sum(s["n_ins"] + s["n_del"] for s in entries)
        exact = len(segments) <= 1 and not bases  # else rows of several commits may cancel
        keyed = bool(self.latest().tip[stream]["pk"])
        unit = keyed or exact and all(s["unit"] for s in segments)
        return Delta(parts[0] if exact else consolidate(union(*parts)), rows=n if exact or not n else None, unit=unit, bytes=sum(s["bytes"] for s in entries), keyed=keyed)

    def changed_rows(self, lo: int, hi: int, stream: str = MAIN) -> int:
        """How many rows the commits of (lo, hi] wrote: at least as many as the consolidated window has."""
        return sum(s["n_ins"] + s["n_del"] for s in self._entries(lo, hi, stream) if s.get("segment"))

    def rows(self, version: int | None = None, stream: str = MAIN) -> int:
        """Rows as of a version, from the log."""
        tip = (self.latest() if version is None else self.commit_at(version)).tip.get(stream)
        return tip["rows"] if tip else 0

    # ---- writing

    def write_stream(self, df: DataFrame, *, segment: bool, pk=None, unique: bool = False) -> dict:
        """Write a base or a segment and describe it for a commit. Rows are counted as they are written. It
        is checked against its key, unless it is unique as made: no key may have two rows."""
        folder = f"{self.path}/data/{'seg' if segment else 'base'}-{uuid.uuid4().hex}"
        schema = StructType([f for f in df.schema.fields if f.name != WEIGHT])
        w = F.col(WEIGHT) if segment else F.lit(1).cast("long")
        seen = Observation()
        df.observe(seen, F.sum(F.when(w > 0, w)).alias("up"), F.sum(F.when(w < 0, -w)).alias("down"), F.max(F.abs(w)).alias("most")).write.parquet(folder)
        n_ins, n_del, most = (seen.get[x] or 0 for x in ("up", "down", "most"))
        if pk and n_ins and not unique:
            back = self._parquet(schema, folder, weighted=segment)
            live = back.where(F.col(WEIGHT) > 0) if segment else back
            twice = several(live, pk, F.sum(WEIGHT) if segment else None)
            if twice:
                log.remove(self.spark, folder)
                raise ValueError(f"{self.name}: the key {tuple(pk)} has several rows, for one at {[tuple(r) for r in twice]}")
        size = log.size(self.spark, folder)
        return {"base": None if segment else folder, "segment": folder if segment else None, "schema": schema.jsonValue(), "n_ins": n_ins, "n_del": n_del, "unit": most <= 1, "bytes": size, "pk": list(pk) if pk else None}

    def _tip(self, expected: int, version: int, streams: dict[str, dict]) -> dict[str, dict]:
        """Every stream's tip with a commit's streams on it."""
        look = self._list() if expected >= 0 else None
        tip = {name: self._live(expected, name, look) for name in self.commit_at(expected).tip} if expected >= 0 else {}
        for name, s in streams.items():
            was = tip.get(name)
            if s["base"]:
                tip[name] = {"schema": s["schema"], "pk": s["pk"], "rows": s["n_ins"], "base": s["base"], "base_at": version, "segments": []}
            else:
                one = {"lo": version - 1, "hi": version, "path": s["segment"]} | {k: s[k] for k in ("n_ins", "n_del", "unit")}
                was = was or {"schema": s["schema"], "pk": s["pk"], "rows": 0, "base": None, "base_at": -1, "segments": []}
                tip[name] = was | {"rows": was["rows"] + s["n_ins"] - s["n_del"], "segments": [*was["segments"], one]}
        return tip

    def publish(self, kind: str, streams: dict[str, dict], meta: dict, pk, *, expected: int) -> Commit:
        """The version after expected (-1: none yet); CommitConflict if there is one already."""
        before, version = self.commit_at(expected) if expected >= 0 else None, expected + 1
        stamped = META in meta
        d = {
            "version": version, "table_id": before.table_id if before else uuid.uuid4().hex, "kind": kind, "ts": time.time(), "pk": list(pk) if pk else None,
            "meta": meta, "streams": streams, "tip": self._tip(expected, version, streams),
            "stamp": meta[META] if stamped else before and before.stamp, "others": not stamped and bool(streams or before and before.others),
        }
        log.publish(self.spark, f"{self.path}/_log/{version:020d}.json", json.dumps(d))
        return self.commit_at(version)

    def _publish(self, kind: str, streams: dict[str, dict], meta: dict, pk, expected: int | None) -> Commit:
        """As publish; if expected is None, behind whatever there is. What can't be published is removed."""
        try:
            if expected is not None:
                return self.publish(kind, streams, meta, pk, expected=expected)
            return attempted(lambda: self.publish(kind, streams, meta, pk, expected=self.head()))
        except Exception:
            for s in streams.values():
                log.remove(self.spark, s["base"] or s["segment"])
            raise

    def create(self, df: DataFrame, *, pk=None, meta: dict | None = None, sidecars: dict[str, tuple[DataFrame, tuple]] | None = None, kind: str = "bootstrap", unique: bool = False) -> Commit:
        """The first commit: a base, with its sidecars' bases. unique: the key needs no check."""
        if self.exists():
            raise log.CommitConflict(f"{self.name} exists")
        pk = (pk,) if isinstance(pk, str) else pk
        check_names(df.columns, self.name)
        check_groupable(df)
        streams = {MAIN: self.write_stream(df, segment=False, pk=pk, unique=unique)}
        for name, (side, key) in (sidecars or {}).items():
            streams[name] = self.write_stream(side, segment=False, pk=key, unique=True)
        done = self._publish(kind, streams, meta or {}, pk, -1)
        self.show()
        return done

    def adopt(self, path: str, *, pk=None) -> Commit:
        """The first commit, over Parquet files that are there and stay where they are."""
        pk = (pk,) if isinstance(pk, str) else pk
        df = self.spark.read.parquet(path)
        n = df.count()
        entry = {"base": path, "segment": None, "schema": df.schema.jsonValue(), "n_ins": n, "n_del": 0, "unit": True, "bytes": log.size(self.spark, path), "pk": list(pk) if pk else None}
        done = self.publish("adopt", {MAIN: entry}, {}, pk, expected=-1)
        self.show()
        return done

    def commit(self, zset: DataFrame | None, *, kind: str = "write", meta: dict | None = None, sidecars: dict[str, tuple[DataFrame, tuple, bool]] | None = None, unique: bool = False, expected: int | None = None) -> Commit:
        """One more version: a consolidated Z-set, nothing (a heartbeat), and sidecars as (frame, key,
        whole), whole ones replacing what was there. unique: the key needs no check. expected: the version
        that all of it was computed from, and CommitConflict if the table has moved on; None: it holds
        whatever there is."""
        last, streams = self.latest(), {}
        if zset is not None:
            check_names([c for c in zset.columns if c != WEIGHT], self.name)
            known = self.columns()
            if set(known) != {c for c in zset.columns if c != WEIGHT}:
                raise ValueError(f"{self.name} has columns {known}, the change has {[c for c in zset.columns if c != WEIGHT]}")
            schema = self.schema()
            zset = zset.select(*[F.col(q(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields], WEIGHT)
            streams[MAIN] = self.write_stream(zset, segment=True, pk=last.pk, unique=unique)
        for name, (side, key, whole) in (sidecars or {}).items():
            streams[name] = self.write_stream(side, segment=not whole, pk=key, unique=True)
        for name in [n for n, s in streams.items() if s["segment"] and not s["n_ins"] and not s["n_del"]]:
            log.remove(self.spark, streams.pop(name)["segment"])
        done = self._publish(kind, streams, meta or {}, last.pk, expected)
        for name in streams:
            self._upkeep(name, done.version)
        if MAIN in streams:
            self.show()
        return done

    # ---- as a view

    def sql(self) -> str:
        """The newest snapshot as a query."""
        live = self._live(self.head(), MAIN)
        names = [q(f["name"]) for f in live["schema"]["fields"]]
        cols, w = ", ".join(names), q(WEIGHT)
        file = lambda path: f"parquet.`{path}`"
        base = f"SELECT {cols} FROM {file(live['base'])}" if live["base"] else None
        if not live["segments"]:
            return base or f"SELECT {cols} FROM VALUES (0) WHERE false"
        every = " UNION ALL ".join(f"SELECT {cols}, {w} FROM {file(s['path'])}" for s in live["segments"])
        net = f"SELECT {cols}, sum({w}) AS {w} FROM ({every}) GROUP BY {cols} HAVING sum({w}) <> 0"
        if base and (pk := live["pk"]):
            on = " AND ".join(f"b.{q(c)} <=> g.{q(c)}" for c in pk)
            return f"WITH net AS ({net}) SELECT {', '.join('b.' + n for n in names)} FROM {file(live['base'])} b LEFT ANTI JOIN (SELECT * FROM net WHERE {w} < 0) g ON {on} UNION ALL SELECT {cols} FROM net WHERE {w} > 0"
        every += f" UNION ALL SELECT {cols}, 1L FROM {file(live['base'])}" if base else ""
        return f"SELECT {cols} FROM (SELECT {cols}, sum({w}) AS {w} FROM ({every}) GROUP BY {cols} HAVING sum({w}) > 0) LATERAL VIEW explode(sequence(1L, {w})) AS {q(RESERVED + 'i')}"

    def show(self) -> None:
        """Make the table what its name means in SQL: a view of its newest snapshot, in the database before
        the dot. Commits do it unless spark.ivmspark.views is false: it costs as much as a small job. Where the
        catalog won't have the view (there is a table of that name, say) the commit stands, with a warning."""
        if self.spark.conf.get("spark.ivmspark.views", "true") != "true" or self.name.count(".") > 1:
            return
        try:
            self._show()
        except AnalysisException as e:
            warnings.warn(f"{self.name} is not shown in SQL: {e}", stacklevel=2)

    def _show(self) -> None:
        db, _, name = self.name.rpartition(".")
        if db:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {q(db)}")
        self.spark.sql(f"CREATE OR REPLACE VIEW {q(db) + '.' if db else ''}{q(name)} AS {self.sql()}")

    # ---- upkeep

    def _upkeep(self, stream: str, version: int) -> None:
        """After a commit: a new base if much has changed since the last one, else merge what has gathered."""
        live = self._live(version, stream)
        segments = live["segments"]
        size = lambda s: s["n_ins"] + s["n_del"]
        if len(segments) > 2 and sum(map(size, segments)) > BASE_SHARE * max(1, live["rows"]):
            return self.compact(stream, version)
        # the newest segments, as far back as none is much larger than all after it
        k, total = len(segments), 0
        while k and size(segments[k - 1]) <= 2 * max(total, 1000):
            k -= 1
            total += size(segments[k])
        if len(segments) - k >= MERGE_AFTER:
            self._merge(stream, live, segments[k:])

    def _merge(self, stream: str, live: dict, segments: list[dict]) -> None:
        """One segment for several that follow one another."""
        schema, lo, hi = StructType.fromJson(live["schema"]), segments[0]["lo"], segments[-1]["hi"]
        net = consolidate(self._parquet(schema, *[s["path"] for s in segments], weighted=True))
        s = self.write_stream(net, segment=True)
        one = {"lo": lo, "hi": hi, "path": s["segment"]} | {k: s[k] for k in ("n_ins", "n_del", "unit")}
        self._note(f"run-{stream}-{lo:020d}-{hi:020d}.json", one, s["segment"])

    def _note(self, name: str, what: dict, folder: str) -> None:
        try:
            log.publish(self.spark, f"{self.path}/_log/{name}", json.dumps(what))
        except log.CommitConflict:
            log.remove(self.spark, folder)

    def compact(self, stream: str = MAIN, version: int | None = None) -> None:
        """A base for the latest version. Readers see no new version and no change."""
        version = self.head() if version is None else version
        live = self._live(version, stream)
        if live is None or live["base"] and not live["segments"]:
            return
        folder = f"{self.path}/data/base-{uuid.uuid4().hex}"
        self.snapshot(version, stream).write.parquet(folder)
        self._note(f"base-{stream}-{version:020d}.json", {"path": folder}, folder)

    def vacuum(self, floor: int, orphans_after: float = 86_400.0) -> int:
        """Give up what is from before a version: its windows and snapshots, then their files and log
        entries, and files of no commit that are older than so many seconds. How many folders went."""
        look = self._list()
        floor = min(floor, max(look.versions, default=0))
        log.publish_once(self.spark, f"{self.path}/_log/floor-{floor:020d}.json", "{}")
        used, kept = set(), [v for v in look.versions if v >= floor]
        for v in kept:
            for stream in self.commit_at(v).tip:
                live = self._live(v, stream, look)
                used |= {live["base"], *(s["path"] for s in live["segments"])}
            if v > floor:
                used |= {x for s in self.commit_at(v).streams.values() for x in (s["base"], s["segment"])}
        marks = {name: self._mark(name)["path"] for _, *_, name in (*look.bases, *look.runs)}
        old = {x for v in look.versions if v <= floor for s in self.commit_at(v).streams.values() for x in (s["base"], s["segment"])} | set(marks.values())
        for v in look.versions:
            if v < floor:
                log.remove(self.spark, f"{self.path}/_log/{v:020d}.json")
                _COMMITS.get(self.path, {}).pop(v, None)
        for name, path in marks.items():
            if path not in used:
                log.remove(self.spark, f"{self.path}/_log/{name}")
        n = 0
        for name, age in log.ages(self.spark, f"{self.path}/data"):
            folder = f"{self.path}/data/{name}"
            if folder not in used and (folder in old or age > orphans_after):
                log.remove(self.spark, folder)
                n += 1
        self.show()
        return n

    def drop(self) -> None:
        if self.exists() and self.spark.conf.get("spark.ivmspark.views", "true") == "true" and self.name.count(".") <= 1:
            try:
                self.spark.sql(f"DROP VIEW IF EXISTS {'.'.join(map(q, self.name.split('.')))}")
            except AnalysisException as e:  # it is a table of someone's
                warnings.warn(f"{self.name} stays in SQL: {e}", stacklevel=2)
        log.remove(self.spark, self.path)
        _COMMITS.pop(self.path, None)
        self._looked = False

    # ---- plain changes, for tables that people write

    def insert(self, df: DataFrame, **meta) -> Commit:
        return self.commit(consolidate(as_zset(df.select(*[F.col(q(c)) for c in self.columns()]))), kind="insert", meta=meta)

    def _from(self, change, kind: str, meta: dict) -> Commit:
        """Commit a change computed from the table's rows, anew where another writer was first."""

        def step():
            head = self.head()
            return self.commit(change(self.snapshot(head)), kind=kind, meta=meta, expected=head)

        return attempted(step)

    def delete(self, where: str, **meta) -> Commit:
        return self._from(lambda now: consolidate(as_zset(now.where(where), -1)), "delete", meta)

    def update(self, where: str, **values: str) -> Commit:
        """Rows where the condition holds, with columns set to SQL expressions over the old row."""

        def change(now):
            old = now.where(where)
            new = old.select(*[F.expr(values[f.name]).cast(f.dataType).alias(f.name) if f.name in values else F.col(q(f.name)) for f in self.schema().fields])
            return diff(new, old)

        return self._from(change, "update", {})

    def overwrite(self, df: DataFrame, **meta) -> Commit:
        """Replace the rows; only what differs is written."""
        return self._from(lambda now: diff(df.select(*[F.col(q(c)) for c in self.columns()]), now), "overwrite", meta)

    def merge(self, zset: DataFrame, **meta) -> Commit:
        return self.commit(consolidate(zset), kind="merge", meta=meta)


def several(live: DataFrame, pk, n=None) -> list:
    """Some keys that have several rows, or a sum n above 1. Only a key's hash is dealt out; where a hash comes
    twice, which is rare but for keys that do, its keys are looked at themselves."""
    keys, h, n = [F.col(q(c)) for c in pk], RESERVED + "h", F.count("*") if n is None else n
    if len(pk) == 1 or any(x in live.schema[c].dataType.simpleString() for c in pk for x in ("map<", "collate")):  # equal, but not of one hash
        return live.groupBy(*keys).agg(n.alias(WEIGHT)).where(F.col(WEIGHT) > 1).drop(WEIGHT).take(3)
    hashed = live.withColumn(h, F.xxhash64(*keys))
    met = [r[0] for r in hashed.groupBy(h).agg(n.alias(WEIGHT)).where(F.col(WEIGHT) > 1).select(h).take(_LOOK)]
    if not met:
        return []
    few = hashed if len(met) == _LOOK else hashed.where(F.col(h).isin(met))
    return few.groupBy(*keys).agg(n.alias(WEIGHT)).where(F.col(WEIGHT) > 1).drop(WEIGHT).take(3)


def parted(spark: SparkSession, rows: int) -> int:
    """How many parts so many rows are dealt to, so that no task has more of them as they grow; 0 where the
    session's number of partitions is enough."""
    parts = -(-rows // PART_ROWS)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def without(base: DataFrame, gone: DataFrame, pk, parts: int) -> DataFrame:
    """The rows whose key is not among gone, null equal to null, dealt to so many parts: the key as one struct,
    of which a field's null is a value as any other."""
    k, g = RESERVED + "k", RESERVED + "gone"
    key = F.struct(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(pk)])
    rows = base.select(key.alias(k), *[F.col(q(c)) for c in base.columns if c not in pk]).repartition(parts, k)
    left = rows.join(gone.select(key.alias(g)).repartition(parts, g), F.col(k) == F.col(g), "left_anti")
    return left.select(*[F.col(f"{k}.c{list(pk).index(c)}").alias(c) if c in pk else F.col(q(c)) for c in base.columns])


def table(spark: SparkSession, name: str) -> VersionedTable:
    return VersionedTable(spark, name)


# ---- commit metadata ---------------------------------------------------------------------------------

META = "ivmspark"


def run_meta(kind: str, pins: dict[str, Pin], tag: str | None = None, plan: str | None = None) -> dict:
    """What a run's commit says: its kind, how far each source has been read, tag, the plan's print."""
    return {META: {"kind": kind, "sources": {s: [p.version, p.table_id] for s, p in pins.items()}, "tag": tag, "plan": plan}}


def _last_stamped(spark: SparkSession, name: str) -> dict | None:
    t = table(spark, name)
    return t.latest().stamp if t.exists() else None


def read_watermarks(spark: SparkSession, name: str) -> dict[str, Pin] | None:
    """How far each source had been read at the table's last run; None if no run has written it."""
    meta = _last_stamped(spark, name)
    return {s: Pin(*p) for s, p in meta["sources"].items()} if meta else None


def read_plan_print(spark: SparkSession, name: str) -> str | None:
    meta = _last_stamped(spark, name)
    return meta and meta.get("plan")


def read_tag(spark: SparkSession, name: str) -> str | None:
    meta = _last_stamped(spark, name)
    return meta and meta.get("tag")


def tagged_versions(spark: SparkSession, name: str, tag: str) -> list[int]:
    t = table(spark, name)
    return sorted(c.version for c in t.history() if c.meta.get(META, {}).get("tag") == tag) if t.exists() else []
