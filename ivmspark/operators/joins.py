"""Joins kept up to date from their sides' changes.

A leaf's columns are one struct named by its alias, so ``o.qty`` and ``o.*`` mean in a plan what they mean
in SQL, and nothing is renamed.

An inner join is linear in either side: its change is (change of L) join (new R) and (old L) join (change of
R), weights going through. An outer, semi or anti join is linear in the side it keeps, if only that changed.
Elsewhere affected keys are recomputed: with K the keys of either side's change, the change of the join is
(new L, R at K joined) less (old L, R at K joined), null keys included. Changes and keys are broadcast if
they are of a known, small size; otherwise they meet the other side in an equi-join.

Where neither side is unique on the columns of an inner join, a key has as many pairs as its rows on one side
times those on the other. Such pairs are counted by key first, and where they are many, a key's rows are cut:
those of the left are dealt to parts, those of the right go to each of them (see Spread).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.change import small
from ..sources.store import PART_ROWS
from .zset import RESERVED, WEIGHT, consolidate, negate, q, union

HOW = {
    "inner": "inner", "left": "left", "left_outer": "left", "leftouter": "left", "right": "right", "right_outer": "right", "rightouter": "right",
    "full": "full", "outer": "full", "full_outer": "full", "fullouter": "full",
    "semi": "left_semi", "left_semi": "left_semi", "leftsemi": "left_semi", "anti": "left_anti", "left_anti": "left_anti", "leftanti": "left_anti",
}


@dataclass
class NodeState:
    """A node of the plan at a run. cols: (alias, column) pairs it gives. current and old: frames, made when
    asked for. delta: its change, or None if there is none. small: the change is of a known, small size. unit:
    no weight in it is beyond 1. keyed: no image is there twice."""

    cols: list[tuple[str, str]]
    current: Callable[[], DataFrame]
    old: Callable[[], DataFrame]
    delta: DataFrame | None
    full: bool = False
    small: bool = False
    unit: bool = True
    keyed: bool = False
    #: Columns that tell the node's rows apart, if known; what columns determine which; rows of a source.
    rowkey: frozenset | None = None
    fds: list[tuple[frozenset, frozenset]] = field(default_factory=list)
    rows: int | None = None
    #: How many parts the node's pairs are dealt to; 0: it has none that are many.
    parts: Callable[[], int] = lambda: 0

    def unique_on(self, columns) -> bool:
        """Whether no two rows have these columns the same."""
        found = set(columns)
        while more := [b for a, b in self.fds if a <= found and not b <= found]:
            found.update(*more)
        return self.rowkey is not None and self.rowkey <= found

    @property
    def aliases(self) -> list[str]:
        return list(dict.fromkeys(a for a, _ in self.cols))


def packed(df: DataFrame, alias: str) -> DataFrame:
    """A relation, or Z-set, with its columns in one struct."""
    fields = [F.col(q(c)) for c in df.columns if c != WEIGHT]
    return df.select(F.struct(*fields).alias(alias), *([WEIGHT] if WEIGHT in df.columns else []))


def leaf(alias: str, ctx, ref, used: Callable[[str], bool] | None = None) -> NodeState:
    """used: which columns the plan asks for. A source with a primary key is read by these and its key alone:
    its rows stay apart, and where only other columns changed there is no change."""
    now, key = ctx.new(ref), ctx.key(ref)
    cols = [(alias, c) for c in now.columns]
    names = [c for c in now.columns if c in key or used(c)] if used and key else now.columns
    cut = lambda df: packed(df.select(*[F.col(q(c)) for c in names], *([WEIGHT] if WEIGHT in df.columns else [])), alias)
    current = lambda: cut(ctx.new(ref))
    known = {"rows": ctx.rows(ref)}
    if key:
        own = frozenset((alias, c) for c in key)
        known |= {"rowkey": own, "fds": [(own, frozenset(cols))]}
    if ctx.last is None:
        return NodeState(cols, current, current, None, **known)
    delta = ctx.delta(ref)
    if delta.is_full:
        return NodeState(cols, current, current, None, full=True, **known)
    if delta.is_empty():
        return NodeState(cols, current, current, None, keyed=delta.keyed, **known)
    changed = cut(delta.zset) if len(names) == len(cols) else consolidate(cut(delta.zset))
    return NodeState(cols, current, lambda: cut(ctx.old(ref)), changed, small=small(delta), unit=delta.unit, keyed=delta.keyed, **known)


class Spread:
    """How the pairs of an inner join are dealt out. A key of many pairs is cut: each row of the left is in one of
    its parts, by its hash, and each of the right in all of them, so every pair is met once."""

    def __init__(self, ctx, left: NodeState, right: NodeState, on):
        self.left, self.right = left, right
        self.sides = [[a for a, _ in on], [b for _, b in on]]
        counts = []
        for side, (node, columns) in enumerate(zip((left, right), self.sides)):
            rows = node.current().select(*self._keys(columns, side))
            # rows that went count too: what was joined is taken back
            rows = rows if node.delta is None else rows.unionByName(node.delta.select(*self._keys(columns, side)))
            counts.append(rows.groupBy(*rows.columns).agg(F.count("*").alias(f"{RESERVED}n{side}")))
        k = range(len(on))
        pairs = F.col(RESERVED + "n0").cast("double") * F.col(RESERVED + "n1")
        met = counts[0].join(counts[1], [F.col(self._k(i, 0)) == F.col(self._k(i, 1)) for i in k])
        self.keys = ctx.keep(met.select(*[self._k(i, side) for i in k for side in (0, 1)], F.ceil(pairs / (PART_ROWS // 4)).cast("int").alias(self.CUT), pairs.alias(RESERVED + "pairs")))
        self.parts = max(1, -int(-(self.keys.agg(F.sum(RESERVED + "pairs")).first()[0] or 0) // PART_ROWS))

    CUT, AT = RESERVED + "cut", RESERVED + "at"

    @staticmethod
    def _k(i: int, side: int) -> str:
        return f"{RESERVED}j{side}_{i}"

    def _keys(self, columns, side: int) -> list:
        return [F.expr(f"{q(a)}.{q(c)}").alias(self._k(i, side)) for i, (a, c) in enumerate(columns)]

    def _dealt(self, frame: DataFrame, side: int) -> DataFrame:
        node, columns = (self.left, self.right)[side], self.sides[side]
        keys, at = [self._k(i, side) for i in range(len(columns))], f"{self.AT}{side}"
        heavy = self.keys.where(F.col(self.CUT) > 1).select(*[F.col(k).alias(k + "h") for k in keys], self.CUT)
        df = frame.select("*", *self._keys(columns, side)).join(F.broadcast(heavy), [F.col(k) == F.col(k + "h") for k in keys], "left")
        cut = F.coalesce(F.col(self.CUT), F.lit(1))
        told = sorted(node.rowkey)
        part = F.explode(F.sequence(F.lit(0), cut - 1)) if side else F.pmod(F.xxhash64(*[F.expr(f"{q(a)}.{q(c)}") for a, c in told]), cut).cast("int")
        kept = [F.col(q(a)) for a in node.aliases] + ([F.col(WEIGHT)] if WEIGHT in frame.columns else [])
        return df.select(*kept, *keys, part.alias(at)).repartition(self.parts, *keys, at)

    def join(self, left: DataFrame, right: DataFrame) -> DataFrame:
        on = [F.col(self._k(i, 0)) == F.col(self._k(i, 1)) for i in range(len(self.sides[0]))]
        on.append(F.col(self.AT + "0") == F.col(self.AT + "1"))
        return self._dealt(left, 0).join(self._dealt(right, 1), on).drop(*[self._k(i, s) for i in range(len(self.sides[0])) for s in (0, 1)], self.AT + "0", self.AT + "1")


def _spread(ctx, left: NodeState, right: NodeState, on, kind: str) -> Callable[[], Spread | None]:
    """The way to deal out a join's pairs, or None where they are as few as the rows of a side, or few at all."""
    sides = ((left, [a for a, _ in on]), (right, [b for _, b in on]))
    few = None not in (left.rows, right.rows) and left.rows * right.rows <= PART_ROWS
    if ctx.look or kind != "inner" or None in (left.rowkey, right.rowkey) or few or any(n.unique_on(c) for n, c in sides):
        return lambda: None
    # keys of two types, or of a collation, may be equal to several of the other side
    types = [[n.current().select(F.expr(f"{q(a)}.{q(c)}")).schema[0].dataType.simpleString() for a, c in columns] for n, columns in sides]
    if types[0] != types[1] or any("collate" in t for t in types[0]):
        return lambda: None
    made: list[Spread] = []

    def spread() -> Spread | None:
        if not made:
            made.append(Spread(ctx, left, right, on))
        return made[0] if made[0].parts > 1 else None

    return spread


def join_frames(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """on: ((alias, column), (alias, column)) pairs."""
    condition = [F.expr(f"{q(a)}.{q(c)}") == F.expr(f"{q(b)}.{q(d)}") for (a, c), (b, d) in on]
    return left.join(right, condition, HOW.get(how, how))


def _key_frame(node: NodeState, columns) -> DataFrame:
    """The keys of a node's change."""
    return node.delta.select(*[F.expr(f"{q(a)}.{q(c)}").alias(f"{RESERVED}k{i}") for i, (a, c) in enumerate(columns)])


def _at(frame: DataFrame, keys: DataFrame, columns, broadcast: bool) -> DataFrame:
    """The rows of a frame whose key is among keys, null among them."""
    keys = F.broadcast(keys) if broadcast else keys
    condition = " AND ".join(f"{q(a)}.{q(c)} <=> {RESERVED}k{i}" for i, (a, c) in enumerate(columns))
    return frame.join(keys, F.expr(condition), "left_semi")


def _known(left: NodeState, right: NodeState, on, kind: str) -> dict:
    """What is known of an inner join's rows: a pair of rows comes once, and what is joined on is equal."""
    if kind != "inner" or left.rowkey is None or right.rowkey is None:
        return {}
    equal = [(frozenset([a]), frozenset([b])) for pair in on for a, b in (pair, pair[::-1])]
    return {"rowkey": left.rowkey | right.rowkey, "fds": [*left.fds, *right.fds, *equal]}


def join(ctx, left: NodeState, right: NodeState, on, how: str, key_filter: bool = True, settle: bool = True) -> NodeState:
    """settle: consolidate the change, so that a join above sees only keys that did change."""
    kind = HOW[how]
    cols = left.cols if kind in ("left_semi", "left_anti") else left.cols + right.cols
    spread = _spread(ctx, left, right, on, kind)
    met = lambda l, r: s.join(l, r) if (s := spread()) else join_frames(l, r, on, how)
    current = lambda: met(left.current(), right.current())
    old = lambda: met(left.old(), right.old())
    known = _known(left, right, on, kind) | {"parts": lambda: max(s.parts if (s := spread()) else 0, left.parts(), right.parts())}
    if left.full or right.full:
        return NodeState(cols, current, current, None, full=True, **known)
    if left.delta is None and right.delta is None:
        return NodeState(cols, current, current, None, **known)
    delta = _linear(left, right, on, kind, spread())
    if delta is None:
        delta = _recomputed(left, right, on, kind, key_filter)
    delta = delta.select(*[F.col(q(a)) for a in dict.fromkeys(a for a, _ in cols)], WEIGHT)
    # a few rows can match any number: a join's change is of no known size. Its rows' weights are products of
    # weights; summing equal rows leaves them at 1 only if there are none on either side
    unit, keyed = (left.delta is None or left.unit) and (right.delta is None or right.unit), left.keyed and right.keyed
    return NodeState(cols, current, old, consolidate(delta, known["parts"]()) if settle else delta, unit=unit and (keyed or not settle), keyed=keyed, **known)


def _linear(left: NodeState, right: NodeState, on, kind: str, spread: Spread | None = None) -> DataFrame | None:
    """The change by joining the changes themselves, where weights go through the join: an inner join is
    linear in either side, the others in the side that they keep, if only that one changed."""
    if kind == "inner":
        terms, cols = [], [F.col(q(a)) for a in dict.fromkeys([*left.aliases, *right.aliases])]
        if spread:
            terms += [spread.join(left.delta, right.current())] if left.delta is not None else []
            terms += [spread.join(left.old() if left.delta is not None else left.current(), right.delta)] if right.delta is not None else []
            return union(*[t.select(*cols, WEIGHT) for t in terms])
        if left.delta is not None:
            terms.append(join_frames(F.broadcast(left.delta) if left.small else left.delta, right.current(), on, kind))
        if right.delta is not None:
            before = left.old() if left.delta is not None else left.current()
            terms.append(join_frames(before, F.broadcast(right.delta) if right.small else right.delta, on, kind))
        return union(*[t.select(*cols, WEIGHT) for t in terms])
    if kind in ("left", "left_semi", "left_anti") and right.delta is None:
        there = _at(right.current(), _key_frame(left, [a for a, _ in on]).distinct(), [b for _, b in on], left.small)
        return join_frames(left.delta, there, on, kind)
    if kind == "right" and left.delta is None:
        there = _at(left.current(), _key_frame(right, [b for _, b in on]).distinct(), [a for a, _ in on], right.small)
        return join_frames(there, right.delta, on, kind)
    return None


def _recomputed(left: NodeState, right: NodeState, on, kind: str, key_filter: bool) -> DataFrame:
    """The join at the changed keys as it is now, less as it was."""
    sides = [(left, [a for a, _ in on]), (right, [b for _, b in on])]
    changed = [(n, k) for n, k in sides if n.delta is not None]
    keys = _key_frame(*changed[0])
    for other in changed[1:]:
        keys = keys.union(_key_frame(*other))
    keys = keys.distinct()
    broadcast = all(n.small for n, _ in changed)

    def state(l: DataFrame, r: DataFrame) -> DataFrame:
        if key_filter:
            l, r = _at(l, keys, sides[0][1], broadcast), _at(r, keys, sides[1][1], broadcast)
        return join_frames(l, r, on, kind).withColumn(WEIGHT, F.lit(1).cast("long"))

    return union(state(left.current(), right.current()), negate(state(left.old(), right.old())))
