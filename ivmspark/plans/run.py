"""One maintenance step of one output: skip, bootstrap, incremental, or comprehensive with a diff."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.zset import WEIGHT, Delta, Settled, as_zset, check_names, consolidate, diff, present, q, restrict, settled, union
from ..sources.change import ChangeSource, TableSource
from ..sources import log
from ..sources.store import SMALL, SMALL_BYTES, Pin, attempted, read_tag, run_meta, table


def as_source(source) -> ChangeSource:
    return TableSource(source) if isinstance(source, str) else source


@dataclass
class RunContext:
    """What a run reads: each source as of its pin (new), as of the last run (old), and between (delta)."""

    spark: SparkSession
    sources: dict[str, ChangeSource]
    pins: dict[str, Pin]
    last: dict[str, Pin] | None
    p: dict[str, float | None] = field(default_factory=dict)
    _windows: dict[str, Delta] = field(default_factory=dict)
    _new: dict[str, DataFrame] = field(default_factory=dict)
    _old: dict[str, DataFrame] = field(default_factory=dict)
    #: Sidecars the run's closures want in its commit: name -> (frame, key, whole).
    sidecars: dict[str, tuple] = field(default_factory=dict)
    _kept: list[DataFrame] = field(default_factory=list)
    #: Whether frames are only looked at: then no job is spent on how a join is best dealt out.
    look: bool = False
    #: Whether the result is known to have no two rows of a key of the output, so that it isn't checked.
    unique: bool = False

    def keep(self, df: DataFrame) -> DataFrame:
        """Computed once for the run's several writes; let go when the run ends. Sources are read as of
        pins, so a part that is lost is made again the same."""
        df = df.persist()
        self._kept.append(df)
        return df

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    def _ref(self, source) -> str:
        ref = as_source(source).ref
        if ref not in self.pins:
            raise ValueError(f"{ref} is not a source of this run: {sorted(self.pins)}")
        return ref

    def new(self, source) -> DataFrame:
        ref = self._ref(source)
        if ref not in self._new:
            self._new[ref] = self.sources[ref].snapshot(self.spark, self.pins[ref])
        return self._new[ref]

    def old(self, source) -> DataFrame:
        """As of the last run. Asks for a window, so only a source that has one can be asked."""
        ref = self._ref(source)
        if not self.last or ref not in self.last:
            raise ValueError(f"{ref} has not been read by an earlier run")
        if self.last[ref] == self.pins[ref]:
            return self.new(source)
        if ref not in self._old:
            self._old[ref] = self.sources[ref].before(self.spark, self.pins[ref], self.last[ref], self.delta(source))
        return self._old[ref]

    def key(self, source) -> tuple[str, ...]:
        """The source's primary key; empty if it has none."""
        key = getattr(self.sources[self._ref(source)], "key", None)
        return key(self.spark) if key else ()

    def rows(self, source) -> int | None:
        """The source's rows, where they are known without a job."""
        ref = self._ref(source)
        rows = getattr(self.sources[ref], "rows", None)
        return rows(self.spark, self.pins[ref]) if rows else None

    def delta(self, source) -> Delta:
        ref = self._ref(source)
        if ref not in self._windows:
            last = (self.last or {}).get(ref)
            self._windows[ref] = self.sources[ref].window(self.spark, self.pins[ref], last, self.p.get(ref))
        return self._windows[ref]


@dataclass(frozen=True)
class RunResult:
    """status: bootstrap, incremental, comprehensive or skipped. changed: whether the output's rows did."""

    status: str
    pins: dict[str, Pin]
    changed: bool


@dataclass
class Step:
    """A run's decision up to the write: what the terminals share. head: the output's version that it is
    made from, -1 if there is none; the write fails if another one has come meanwhile."""

    ctx: RunContext
    head: int
    skipped: bool
    #: Whether the output is this plan's as of its watermarks, with nothing written by others since.
    fits: bool

    @property
    def exists(self) -> bool:
        return self.head >= 0


def begin(spark: SparkSession, output: str, sources, p, tag: str | None, plan_print: str | None) -> Step:
    sources = {s.ref: s for s in map(as_source, sources)}
    if not sources:
        raise ValueError(f"{output}: a run needs a source")
    limits = p if isinstance(p, dict) else {ref: p for ref in sources}
    t = table(spark, output)
    head = t.head()
    commit = t.commit_at(head) if head >= 0 else None
    stamp = commit and commit.stamp
    last = {s: Pin(*pin) for s, pin in stamp["sources"].items()} if stamp else None
    pins = {ref: s.pin(spark, (last or {}).get(ref)) for ref, s in sources.items()}
    own = last is not None and stamp.get("plan") == plan_print
    same = own and all(last.get(ref) == pin for ref, pin in pins.items())
    fits = own and not commit.others and all(ref in last for ref in pins)
    return Step(RunContext(spark, sources, pins, last, limits), head, same, fits)


def run(
    spark: SparkSession, output: str, *, sources, pk, full: Callable[[RunContext], DataFrame],
    delta: Callable[[RunContext], DataFrame | None] | None = None, p=None, tag: str | None = None, plan_print: str | None = None,
) -> RunResult:
    """One step: skipped if nothing is new; else exactly one commit. full gives the whole output; delta,
    if there is one, its change as a Z-set, or None to have it recomputed. A recomputation is compared with
    the output, so readers downstream see only what really differs. Where another run of the output was
    first, all of it is done again, from what that one left: overlapping runs come out as if in turn."""
    pk = (pk,) if isinstance(pk, str) else tuple(pk or ())

    def once() -> RunResult:
        step = begin(spark, output, sources, p, tag, plan_print)
        if step.skipped:
            return RunResult("skipped", step.ctx.pins, False)
        try:
            return _run(step, spark, output, pk, full, delta, tag, plan_print)
        finally:
            step.ctx.release()

    return attempted(once)


def _run(step: Step, spark: SparkSession, output: str, pk, full, delta, tag, plan_print) -> RunResult:
    ctx = step.ctx
    if not step.exists:
        df = full(ctx)
        _require_key(df.columns, pk, output)
        t = table(spark, output)
        sides = {name: (frame, key) for name, (frame, key, _) in ctx.sidecars.items()}
        t.create(df, pk=pk, meta=run_meta("bootstrap", ctx.pins, tag, plan_print), sidecars=sides, unique=ctx.unique)
        return RunResult("bootstrap", ctx.pins, True)
    zset, status, unique = None, "incremental", False
    if delta is not None and step.fits:
        zset = delta(ctx)
    if zset is None:
        ctx.sidecars.clear()
        status = "comprehensive"
        df = full(ctx)
        _require_key(df.columns, pk, output)
        zset = diff(df, table(spark, output).snapshot(step.head))
    else:
        unique = ctx.unique or isinstance(zset, Settled) and zset.unique_by is not None and set(zset.unique_by) <= set(pk)
        zset = settled(zset)
        _require_key([c for c in zset.columns if c != WEIGHT], pk, output)
    changed = apply_zset(spark, output, zset, run_meta(status, ctx.pins, tag, plan_print), ctx.sidecars, unique=unique, expected=step.head)
    return RunResult(status, ctx.pins, changed)


def _require_key(columns, pk, output: str) -> None:
    missing = [c for c in pk if c not in columns]
    if missing:
        from .builder import BuildError

        raise BuildError(f"{output}: the result is missing the PK column(s) {missing}")


def apply_zset(spark: SparkSession, output: str, zset: DataFrame, meta: dict, sidecars: dict | None = None, kind: str = "run", unique: bool = False, expected: int | None = None) -> bool:
    """Delete, update and insert in one commit, with the run's metadata; a change of no rows is a
    heartbeat, which moves the watermarks and shows no change. expected: the output's version that the
    change was computed from, if it was from any; CommitConflict if there is a newer one. Whether rows
    changed."""
    done = table(spark, output).commit(zset, kind=kind, meta=meta, sidecars=sidecars, unique=unique, expected=expected)
    return "" in done.streams


def heartbeat(spark: SparkSession, output: str, meta: dict, expected: int | None = None) -> None:
    table(spark, output).commit(None, kind="heartbeat", meta=meta, expected=expected)


def current(spark: SparkSession, output: str) -> DataFrame:
    return table(spark, output).snapshot()


# ---- append-only outputs ----------------------------------------------------------------------------

DROPS = "drops"


class AppendConflict(ValueError):
    """A change that an append-only output can't take: a retraction, or another image of a key."""


def drop_log(spark: SparkSession, output: str) -> DataFrame | None:
    """What an append-only output has refused so far, with signs in the weight column; None if nothing."""
    t = table(spark, output)
    return t.snapshot(stream=DROPS).withColumnRenamed("sign", WEIGHT) if t.schema(DROPS) else None


def run_append(
    spark: SparkSession, output: str, *, sources, pk=None, full, delta=None, p=None, tag: str | None = None,
    fail_on_conflict: bool = True, log_drops: bool = True, plan_print: str | None = None,
) -> RunResult:
    """As run, for an output whose rows are only ever added. Retractions, and rows whose key is there with
    another image, are conflicts: AppendConflict before anything is written, or, with fail_on_conflict
    off, dropped and logged in the same commit. A row that is there already is passed over."""
    pk = (pk,) if isinstance(pk, str) else tuple(pk or ())

    def once() -> RunResult:
        step = begin(spark, output, sources, p, tag, plan_print)
        if step.skipped:
            return RunResult("skipped", step.ctx.pins, False)
        try:
            return _run_append(step, spark, output, pk, full, delta, tag, fail_on_conflict, log_drops, plan_print)
        finally:
            step.ctx.release()

    return attempted(once)


def _run_append(step: Step, spark, output: str, pk, full, delta, tag, fail_on_conflict: bool, log_drops: bool, plan_print) -> RunResult:
    ctx, t = step.ctx, table(spark, output)
    if not step.exists:
        df = full(ctx)
        _require_key(df.columns, pk, output)
        df = _one_image(df, pk, output) if pk else df
        t.create(df, pk=pk, meta=run_meta("bootstrap", ctx.pins, tag, plan_print))
        return RunResult("bootstrap", ctx.pins, True)
    zset, status = None, "incremental"
    if delta is not None and step.fits:
        zset = delta(ctx)
    if zset is None:
        status = "comprehensive"
        if not pk:
            raise ValueError(f"{output}: without a pk a recomputation can't tell old rows from new ones")
        df = full(ctx)
        zset = diff(df, t.snapshot(step.head))
    names = t.columns()
    zset = settled(zset).select(*names, WEIGHT)
    _require_key(names, pk, output)
    changed = _append(spark, t, zset, pk, fail_on_conflict, log_drops, run_meta(status, ctx.pins, tag, plan_print), step.head)
    return RunResult(status, ctx.pins, changed)


def _one_image(df: DataFrame, pk, output: str) -> DataFrame:
    twice = df.distinct().groupBy(*[F.col(q(c)) for c in pk]).count().where("count > 1").take(3)
    if twice:
        raise AppendConflict(f"{output}: several images of one key in one run, at {[tuple(r)[:-1] for r in twice]}")
    return df.distinct()


def _append(spark, t, zset: DataFrame, pk, fail: bool, log_drops: bool, meta: dict, head: int) -> bool:
    # written once: the checks and the commit read this, not the plan again
    held = t.write_stream(zset, segment=True)
    names = t.columns()
    try:
        change = t._parquet(t.schema(), held["segment"], weighted=True) if held["n_ins"] + held["n_del"] else zset.limit(0)
        gone = change.where(F.col(WEIGHT) < 0)
        fresh = change.where(F.col(WEIGHT) > 0)
        other = None
        if pk and held["n_ins"]:
            _one_image(fresh.drop(WEIGHT), pk, t.name)
            keys = fresh.select(*pk)
            there = restrict(t.snapshot(head), keys, pk, small=held["n_ins"] <= SMALL and held["bytes"] <= SMALL_BYTES).select(*names)
            # what is there already cancels; what is left of a key that is there is another image
            rest = consolidate(union(fresh.withColumn(WEIGHT, F.lit(1).cast("long")), as_zset(there, -1))).where(F.col(WEIGHT) > 0)
            other = restrict(rest, there.select(*pk), pk)
            fresh = restrict(rest, there.select(*pk), pk, "left_anti")
        conflicts = held["n_del"] or (other is not None and other.take(1))
        if conflicts and fail:
            what = f"{held['n_del']} retraction(s)" if held["n_del"] else "another image of a key that is there"
            raise AppendConflict(f"{t.name} only takes new rows; the change has {what}")
        sidecars = {}
        if conflicts and log_drops:
            drops = gone if other is None else gone.unionByName(other)
            drops = drops.withColumnRenamed(WEIGHT, "sign")
            sidecars[DROPS] = (as_zset(drops.select(*names, "sign")), (), False) if t.schema(DROPS) else (drops.select(*names, "sign"), (), True)
        done = t.commit(fresh, kind="append", meta=meta, sidecars=sidecars, expected=head)
    finally:
        log.remove(spark, held["segment"])
    return "" in done.streams


# ---- engine-neutral bridge --------------------------------------------------------------------------


def apply_changes(spark: SparkSession, name: str, changes: DataFrame, pk, *, tag: str | None = None, full: bool = False) -> bool:
    """Land a foreign Z-set (or, without weights, rows) on a table: nothing if its last commit has this
    tag; made if it isn't there; full: the changes are the whole relation, and only what differs lands.
    Images of changed keys are taken from the table, so a foreign image that is off by a bit retracts all
    the same. Whether rows changed."""
    pk = (pk,) if isinstance(pk, str) else tuple(pk)
    check_names([c for c in changes.columns if c != WEIGHT], name)
    t = table(spark, name)
    meta = run_meta("ingest", {}, tag)

    def once() -> bool:
        head = t.head()
        if head < 0:
            t.create(present(changes), pk=pk, meta=meta)
            return True
        if tag is not None and read_tag(spark, name) == tag:
            return False
        there = t.snapshot(head)
        if full:
            zset = diff(present(changes).select(*there.columns), there)
        else:
            change = consolidate(changes if WEIGHT in changes.columns else as_zset(changes))
            keys = change.select(*pk).distinct()
            now = present(change).select(*there.columns)
            zset = diff(now, restrict(there, keys, pk))
        return apply_zset(spark, name, zset, meta, kind="ingest", expected=head)

    return attempted(once)
