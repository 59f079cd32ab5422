"""Grouped aggregates kept up to date from a state of accumulators.

The state is a sidecar of the output, committed with it. A change is folded in one pass: per group, each
family's accumulator over the inserted and over the deleted rows. State, fold and, for groups that lost
rows, a rescan of what can't be taken back give the new accumulators; output rows are read off old and new
ones, so neither the output nor untouched groups are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.agg import Family, Metric, Rows
from ..sources.store import table
from .zset import RESERVED, WEIGHT, Settled, by_bits, q, restrict

STATE = "aggregate"
_N = Rows().name
_OLD, _NEW = RESERVED + "old", RESERVED + "new"


def families(metrics) -> list[Family]:
    """Row count first, then each family the metrics need, once."""
    return list(dict.fromkeys([Rows(), *(m.family for _, m in metrics)]))


def required_columns(by, metrics) -> list[str]:
    return list(dict.fromkeys([*by, *(c for _, m in metrics for c in m.family.columns)]))


def _check(columns, by, metrics, output: str) -> None:
    missing = [c for c in required_columns(by, metrics) if c not in columns]
    if missing:
        raise ValueError(f"{output}: .aggregate needs column(s) {missing}, the plan has {list(columns)}")


def rebuild(rows: DataFrame, by, fams) -> DataFrame:
    """All groups' accumulators, in one partial and one final aggregation."""
    return rows.groupBy(*[F.col(q(b)) for b in by]).agg(*[f.state(F.lit(True)).alias(f.name) for f in fams])


def _sides(rows: DataFrame, by, fams) -> DataFrame:
    """Per group of rows at +1 and -1: accumulators of inserts (i), of deletes (d), and whether it lost rows."""
    gain, loss = F.col(WEIGHT) > 0, F.col(WEIGHT) < 0
    parts = [f.state(c).alias(f"{RESERVED}{side}{f.name}") for f in fams for side, c in (("i", gain), ("d", loss))]
    return rows.groupBy(*[F.col(q(b)) for b in by]).agg(*parts, F.bool_or(loss).alias(RESERVED + "lost"))


def fold(change: DataFrame, by, fams, unit: bool = False) -> DataFrame:
    """Per group of a Z-set: accumulators of inserts (i), of deletes (d), and whether it lost rows. unit: no
    weight is beyond 1. Else a row counts once for each binary digit of its weight, in an accumulator for
    each power of two; at most 63 of them make the group's, so a weight of any size is a few rows."""
    if unit:
        return _sides(change, by, fams)
    power = RESERVED + "power"
    parts = _sides(by_bits(change, power), [*by, power], fams)
    held = F.collect_list(F.struct(*[F.col(q(c)) for c in parts.columns if c not in by]))
    rows = parts.groupBy(*[F.col(q(b)) for b in by]).agg(held.alias(RESERVED + "held"))

    def whole(f: Family, side: str) -> F.Column:
        name = f"{RESERVED}{side}{f.name}"
        kind = parts.schema[name].dataType
        none = F.lit(None).cast(kind)
        return F.aggregate(RESERVED + "held", none, lambda acc, x: f.merge(acc, f.times(x[name], x[power]), none).cast(kind)).alias(name)

    out = [whole(f, side) for f in fams for side in "id"]
    lost = F.exists(RESERVED + "held", lambda x: x[RESERVED + "lost"]).alias(RESERVED + "lost")
    return rows.select(*[F.col(q(b)) for b in by], *out, lost)


def derive(state: DataFrame, by, metrics) -> DataFrame:
    """Output rows of the groups that have rows."""
    values = [m.derive(F.col(q(m.family.name))).alias(k) for k, m in metrics]
    return state.where(F.col(f"{q(_N)}.n") > 0).select(*[F.col(q(b)) for b in by], *values)


def _joined(left: DataFrame, right: DataFrame, by, how: str = "left") -> DataFrame:
    """left with right's columns, groups matched null to null; right's keys renamed away."""
    right = right.select(*[F.col(q(b)).alias(f"{RESERVED}g{i}") for i, b in enumerate(by)], *[F.col(q(c)) for c in right.columns if c not in by])
    on = F.expr(" AND ".join(f"{q(b)} <=> {RESERVED}g{i}" for i, b in enumerate(by)))
    return left.join(right, on, how).drop(*[f"{RESERVED}g{i}" for i in range(len(by))])


def merged(state: DataFrame, folded: DataFrame, rescan: DataFrame | None, by, fams) -> DataFrame:
    """The groups of a fold with their accumulators: old (null for a new group) and new (null for a group
    that has no rows left), as structs."""
    names = [f.name for f in fams]
    both = _joined(folded, state.select(*[F.col(q(b)) for b in by], *[F.col(q(n)) for n in names]), by)
    if rescan is not None:
        both = _joined(both, rescan, by)
    out = []
    for f in fams:
        a, i, d = (F.col(q(x + f.name)) for x in ("", RESERVED + "i", RESERVED + "d"))
        new = f.merge(a, i, d)
        if f.rescan:
            new = F.when(F.col(RESERVED + "lost"), F.col(q(RESERVED + "r" + f.name))).otherwise(new)
        out.append(new.cast(state.schema[f.name].dataType).alias(f.name))
    old = F.when(F.col(f"{q(_N)}.n").isNotNull(), F.struct(*[F.col(q(n)) for n in names]))
    both = both.select(*[F.col(q(b)) for b in by], old.alias(_OLD), F.struct(*out).alias(_NEW))
    return both.withColumn(_NEW, F.when(F.col(f"{_NEW}.{q(_N)}.n") > 0, F.col(_NEW)))


def moved(old, new) -> F.Column:
    """Rows of a change: the new value at +1 and the old one at -1, where they differ. No grouping needed:
    a group has one value before and one after."""
    plus = F.struct(new.alias("row"), F.lit(1).cast("long").alias("w"))
    minus = F.struct(old.alias("row"), F.lit(-1).cast("long").alias("w"))
    same = old.eqNullSafe(new)
    return F.filter(F.array(plus, minus), lambda x: ~same & x["row"].isNotNull())


def change_of(both: DataFrame, by, old, new, names) -> DataFrame:
    """The Z-set of (by, *names) that turns old structs into new ones."""
    e = RESERVED + "e"
    rows = both.select(*[F.col(q(b)) for b in by], F.explode(moved(old, new)).alias(e))
    return rows.select(*[F.col(q(b)) for b in by], *[F.col(f"{e}.row.{q(n)}").alias(n) for n in names], F.col(f"{e}.w").alias(WEIGHT))


def closures(output: str, by, metrics, compiled):
    metrics: list[tuple[str, Metric]] = list(metrics)
    fams = families(metrics)

    def full(ctx) -> DataFrame:
        rows = compiled(ctx).current()
        _check(rows.columns, by, metrics, output)
        state = rebuild(rows, by, fams)
        ctx.sidecars[STATE] = (state, by, True)
        return derive(state, by, metrics)

    def delta(ctx) -> DataFrame | None:
        t = table(ctx.spark, output)
        if t.columns(STATE) != [*by, *(f.name for f in fams)]:
            return None
        plan = compiled(ctx)
        # additive families take a row in and out as they come; others shouldn't rescan for rows that cancel
        again = [f for f in fams if f.rescan]
        change = plan.delta(consolidated=bool(again))
        if change is None:
            return None
        _check(change.columns, by, metrics, output)
        state = t.snapshot(stream=STATE)
        folded = fold(change, by, fams, plan.unit)
        rescan = None
        if again:
            lost = folded.where(F.col(RESERVED + "lost")).select(*[F.col(q(b)) for b in by])
            members = restrict(plan.current(), lost, by, small=plan.small)
            rescan = members.groupBy(*[F.col(q(b)) for b in by]).agg(*[f.state(F.lit(True)).alias(RESERVED + "r" + f.name) for f in again])
        both = ctx.keep(merged(state, folded, rescan, by, fams))
        old, new = F.col(_OLD), F.col(_NEW)
        ctx.sidecars[STATE] = (change_of(both, by, old, new, [f.name for f in fams]), by, False)
        out = [F.when(s.isNotNull(), F.struct(*[m.derive(s[m.family.name]).alias(k) for k, m in metrics])) for s in (old, new)]
        return Settled(change_of(both, by, *out, [k for k, _ in metrics]), tuple(by))

    return full, delta
