"""Plans: a join tree over sources, a pipeline of row-wise stages, and at most one of sql, aggregate,
accumulate or reduce on top. Plans hold no data and never change: each method gives a new plan."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.acc import Scan
from ..functions.agg import Metric, Reduce
from ..operators.joins import HOW, NodeState, join, leaf
from ..operators.zset import RESERVED, WEIGHT, Settled, as_zset, consolidate, q
from ..sources.change import ChangelogLayout, ChangelogSource, TableSource
from ..sources.store import several
from .run import RunContext, RunResult, as_source, run, run_append


class BuildError(ValueError):
    """A plan that can't be."""


@dataclass(frozen=True)
class Leaf:
    source: Any
    p: float | None
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    left: Leaf | Join
    right: Leaf | Join
    on: Any
    how: str


def leaves(node) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else leaves(node.left) + leaves(node.right)


def joins(node) -> list[Join]:
    return [] if isinstance(node, Leaf) else [node, *joins(node.left), *joins(node.right)]


#: A column of a leaf as it is, in a select list, under its name or another.
_PLAIN = re.compile(r"(\w+)\.(\w+)(?:\s+AS\s+(\w+))?", re.I)


def split_items(text: str) -> list[str]:
    """A select list cut at the commas that are in no brackets and no quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote and (quote == "`" or text[i - 1] != "\\") else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in [*out, text[start:].strip()] if x]


def key_columns(pk) -> tuple[str, ...]:
    return (pk,) if isinstance(pk, str) else tuple(pk or ())


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    return list(on.items()) if isinstance(on, dict) else [(c, c) for c in on]


@dataclass(frozen=True)
class Builder:
    root: Leaf | Join
    stages: tuple[tuple[str, Any], ...] = ()
    name: str | None = None
    top: tuple[str, Any] | None = None  # (sql, query), (agg, (by, metrics)), (acc, ...), (reduce, ...)
    order: str | None = None
    by: tuple[str, ...] | None = None

    # ---- composing

    def _open(self, what: str) -> None:
        if self.top is not None:
            raise BuildError(f".{what} can't follow .{self.top[0]}")

    def alias(self, name: str) -> Builder:
        """Name the plan; for a lone source, its columns' scope."""
        if not name or name.startswith(RESERVED):
            raise BuildError(f"not a name for a plan: {name!r}")
        root = replace(self.root, alias=name) if isinstance(self.root, Leaf) else self.root
        return replace(self, root=root, name=name)

    def join(self, other: Builder, on, how: str = "inner") -> Builder:
        """An equi-join; on: a name, names, or {left: right}; a name may be qualified by an alias."""
        self._open("join")
        if how not in HOW:
            raise BuildError(f"no such join: {how!r}; one of {sorted(set(HOW))}")
        if self.stages or other.stages or other.top or other.order:
            raise BuildError("only sources and joins of them can be joined; land other plans as a table first")
        if not _pairs(on):
            raise BuildError("a join needs a column to join on")
        joined = replace(self, root=Join(self.root, other.root, on, how))
        _named(joined.root)
        return joined

    def filter(self, predicate: str) -> Builder:
        self._open("filter")
        return replace(self, stages=(*self.stages, ("filter", predicate)))

    def mutate(self, **columns: str) -> Builder:
        """Add columns, or replace those of the same bare name; each sees the input, not its siblings."""
        self._open("mutate")
        if not columns:
            raise BuildError(".mutate needs a column")
        bad = [c for c in columns if c.startswith(RESERVED)]
        if bad:
            raise BuildError(f"column names may not start with {RESERVED!r}: {bad}")
        return replace(self, stages=(*self.stages, ("mutate", tuple(columns.items()))))

    def select(self, projection: str) -> Builder:
        """Replace the columns: names, a.b, a.*, and expressions AS names."""
        self._open("select")
        if not split_items(projection):
            raise BuildError(".select needs a column")
        return replace(self, stages=(*self.stages, ("select", projection)))

    def sql(self, query) -> Builder:
        """Any query over the plan's result, which is a view of the plan's alias. Computed as a whole, then
        compared, so the output still changes only where it differs. An object with to_sql or compile, as
        expression libraries have, is asked for its text."""
        self._open("sql")
        if not self.name:
            raise BuildError(".sql needs an .alias to name its input")
        if not isinstance(query, str):
            query = str(query.to_sql(dialect="spark") if hasattr(query, "to_sql") else query.compile())
        return replace(self, top=("sql", query))

    def along(self, column: str) -> Builder:
        """The order of scans and reductions."""
        self._open("along")
        return replace(self, order=column)

    def group_by(self, by) -> Builder:
        self._open("group_by")
        return replace(self, by=key_columns(by))

    def aggregate(self, by=None, **metrics) -> Builder:
        self._open("aggregate")
        by = key_columns(by) or self.by or ()
        if not by:
            raise BuildError(".aggregate needs a group key")
        if not metrics:
            raise BuildError(".aggregate needs a metric")
        _check_output([*by, *metrics])
        kinds = {k: Reduce if isinstance(m, Reduce) else Metric if isinstance(m, Metric) else None for k, m in metrics.items()}
        if None in kinds.values():
            raise BuildError(f"not aggregate metrics: {[k for k, v in kinds.items() if v is None]}")
        if Reduce in kinds.values():
            if not self.order:
                raise BuildError("reduce needs .along to say in which order")
            if Metric in kinds.values():
                raise BuildError("reduce can't be mixed with other metrics")
            return replace(self, top=("reduce", (by, tuple(metrics.items()))))
        return replace(self, top=("agg", (by, tuple(metrics.items()))))

    def accumulate(self, by=None, **metrics) -> Builder:
        """Every row with running values along the order, in its group or, without by, in one."""
        self._open("accumulate")
        if not self.order:
            raise BuildError(".accumulate needs .along to say in which order")
        if not metrics:
            raise BuildError(".accumulate needs a metric")
        bad = [k for k, m in metrics.items() if not isinstance(m, Scan)]
        if bad:
            raise BuildError(f"not scan metrics: {bad}")
        _check_output(metrics)
        return replace(self, top=("acc", (key_columns(by) or self.by or (), tuple(metrics.items()))))

    # ---- running

    def merge_into(self, spark: SparkSession, output: str, *, pk=None, ivm: bool = True, key_filter: bool = True, tag: str | None = None) -> RunResult:
        """One maintenance step of an output with a primary key."""
        return materialize(self, spark, output, pk=pk, ivm=ivm, key_filter=key_filter, tag=tag)

    def append_to(self, spark: SparkSession, output: str, *, pk=None, fail_on_conflict: bool = True, log_drops: bool = True, ivm: bool = True, key_filter: bool = True, tag: str | None = None) -> RunResult:
        """One step of an output that only ever gains rows."""
        return materialize_append(self, spark, output, pk=pk, fail_on_conflict=fail_on_conflict, log_drops=log_drops, ivm=ivm, key_filter=key_filter, tag=tag)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The composed input of the plan's top over the sources as they are now."""
        return Compiler(self, live_context(self, spark)).current()

    def schema(self, spark: SparkSession) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.frame(spark).schema.fields}

    def count(self, spark: SparkSession) -> int:
        return self.frame(spark).count()

    def print(self, pk, ivm: bool = True) -> str:
        """A print of the plan: an output made by another plan is recomputed, not patched."""

        def shape(node):
            if isinstance(node, Leaf):
                return (as_source(node.source).ref, node.alias)
            return (shape(node.left), shape(node.right), _pairs(node.on), HOW[node.how])

        top = self.top
        if top and top[0] != "sql":
            by, metrics = top[1]
            top = (top[0], by, [(k, getattr(m, "print", None) or _fold_print(m)) for k, m in metrics])
        text = repr((shape(self.root), self.stages, top, self.order, pk, self.name if top and top[0] == "sql" else None))
        return hashlib.sha256(text.encode()).hexdigest()[:16]


def _fold_print(m) -> tuple:
    fn = getattr(m, "fn", None)
    code = getattr(fn, "__code__", None)
    return (type(m).__name__, m.dtype, repr(m.init), hashlib.sha256(code.co_code + repr(code.co_consts).encode()).hexdigest() if code and "<code" not in repr(code.co_consts) else getattr(fn, "__qualname__", ""))


def _check_output(names) -> None:
    bad = [n for n in names if n.startswith(RESERVED)]
    if bad:
        raise BuildError(f"column names may not start with {RESERVED!r}: {bad}")


def source(ref, *, p: float | None = 0.3, versions: int | None = None) -> Builder:
    """A plan of one source: a table's name, or a change source. p: the share of its rows above which a
    change is recomputed rather than followed; 1.0 never. versions: how many of a table's versions a run
    takes at most; None: all there are."""
    if versions is not None:
        if versions < 1 or not isinstance(ref, str):
            raise BuildError("versions is a whole number of at least 1, of a table's")
        ref = TableSource(ref, versions)
    return Builder(Leaf(ref, p))


def changelog_source(folder: str, name: str, *, p: float | None = 0.3, layout: ChangelogLayout | None = None) -> Builder:
    """A plan of one table that another engine publishes as Parquet change parts."""
    return Builder(Leaf(ChangelogSource(folder, name, layout or ChangelogLayout()), p))


def _named(root) -> list[str]:
    names = [x.alias or f"s{i}" for i, x in enumerate(leaves(root))]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise BuildError(f"aliases come twice: {sorted(twice)}")
    return names


def live_context(plan: Builder, spark: SparkSession) -> RunContext:
    sources = {(s := as_source(x.source)).ref: s for x in leaves(plan.root)}
    return RunContext(spark, sources, {ref: s.pin(spark) for ref, s in sources.items()}, None, look=True)


class Compiler:
    """A plan at a run: frames for its current result, its old one, and its change."""

    def __init__(self, plan: Builder, ctx: RunContext, key_filter: bool = True):
        self.plan, self.ctx, self.key_filter = plan, ctx, key_filter
        self.names = iter(_named(plan.root))
        self.equal: list[set] = []  # columns that join keys make equal
        self.unit = False  # whether no weight of the change asked for is beyond 1
        self.node = self._node(plan.root, False)

    def _used(self, alias: str) -> Callable[[str], bool] | None:
        """Which of a leaf's columns the plan may name; None where it may be any: without a select, or where one
        takes all or the leaf as a whole."""
        text = [x for kind, arg in self.plan.stages for x in (dict(arg).values() if kind == "mutate" else [arg])]
        whole = rf"(?<![\w.`]){re.escape(alias)}(?!\w)(?!\s*\.)|`{re.escape(alias)}`(?!\s*\.)|(^|[(,.])\s*\*"
        if all(kind != "select" for kind, _ in self.plan.stages) or any(re.search(whole, re.sub(r"\bAS\s+\w+", "", x, flags=re.I), re.I) for x in text):
            return None
        named = "\n".join([*text, *[n for j in joins(self.plan.root) for pair in _pairs(j.on) for n in pair]]).replace("``", "`").lower()
        return lambda c: c.lower() in named

    def _node(self, node, settle: bool) -> NodeState:
        if isinstance(node, Leaf):
            return leaf(name := next(self.names), self.ctx, node.source, self._used(name))
        # a change goes through an inner join as it comes; others compare keys, of what did change
        below = HOW[node.how] != "inner"
        left, right = self._node(node.left, below), self._node(node.right, below)
        on = [(self._key(a, left, False), self._key(b, right, True)) for a, b in _pairs(node.on)]
        if HOW[node.how] not in ("left_semi", "left_anti"):
            for a, b in on:
                hit = [s for s in self.equal if a in s or b in s]
                self.equal = [s for s in self.equal if s not in hit] + [set().union({a, b}, *hit)]
        return join(self.ctx, left, right, on, node.how, self.key_filter, settle=settle)

    def _key(self, name: str, node: NodeState, right: bool) -> tuple[str, str]:
        alias, dot, column = name.partition(".")
        if dot:
            if (alias, column) not in node.cols:
                raise BuildError(f"no column {name} to join on")
            return alias, column
        found = [x for x in node.cols if x[1] == name]
        if not found or right and len(found) > 1:
            raise BuildError(f"{'no' if not found else 'more than one'} column {name} to join on")
        return found[0]

    # ---- the pipeline: frames of structs and bare columns, weighted or not

    def _pipeline(self, df: DataFrame) -> DataFrame:
        weight = [WEIGHT] if WEIGHT in df.columns else []
        cols: list[tuple[str | None, str]] = list(self.node.cols)
        for kind, arg in self.plan.stages:
            if kind == "filter":
                df = df.where(F.expr(arg))
            elif kind == "mutate":
                names = [k for k, _ in arg]
                scopes = list(dict.fromkeys(a for a, _ in cols if a))
                bare = [c for a, c in cols if a is None and c not in names]
                df = df.select(*[q(a) for a in scopes], *[q(c) for c in bare], *[F.expr(e).alias(k) for k, e in arg], *weight)
                cols = [x for x in cols if x[1] not in names] + [(None, k) for k in names]
            else:
                df = df.select(*self._items(arg, cols), *weight)
                names = [c for c in df.columns if c != WEIGHT]
                if len(set(names)) < len(names):
                    raise BuildError(f"ambiguous columns in .select: {sorted({n for n in names if names.count(n) > 1})}")
                _check_output(names)
                cols = [(None, c) for c in names]
        if any(a for a, _ in cols):
            df = df.select(*self._star(cols), *weight)
        return df

    def _items(self, projection: str, cols) -> list:
        out = []
        for item in split_items(projection):
            alias = item[:-2].strip("`") if item.endswith(".*") else None
            if item == "*":
                out += self._star(cols)
            elif alias and any(a == alias for a, _ in cols):
                out += [F.col(f"{q(alias)}.{q(c)}").alias(c) for a, c in cols if a == alias]
            else:
                out.append(F.expr(item))
        return out

    def _star(self, cols) -> list:
        """Every column by its bare name; of columns that join keys make equal, the leftmost."""
        out, seen = [], {}
        for a, c in cols:
            if c in seen:
                if not any((a, c) in s and (seen[c], c) in s for s in self.equal):
                    raise BuildError(f"ambiguous column {c}: in {seen[c]} and {a}; use .select")
                continue
            seen[c] = a
            out.append(F.col(f"{q(a)}.{q(c)}").alias(c) if a else F.col(q(c)))
        return out

    def current(self) -> DataFrame:
        return self._pipeline(self.node.current())

    def old(self) -> DataFrame:
        return self._pipeline(self.node.old())

    def delta(self, consolidated: bool = True) -> DataFrame | None:
        """The change of the pipeline's result, consolidated unless that isn't asked for; None if it has to
        be recomputed."""
        if self.node.full:
            return None
        if self.node.delta is None:
            return as_zset(self.current()).limit(0)
        found = self._pipeline(self.node.delta)
        # a source's change is consolidated as it comes; dropping rows and adding columns leave it so
        names = {c for _, c in self.node.cols}
        added = [k for kind, arg in self.plan.stages if kind == "mutate" for k, _ in arg]
        kept = all(kind != "select" for kind, _ in self.plan.stages) and not names & set(added) and len(set(added)) == len(added)
        as_it_came = isinstance(self.plan.root, Leaf) and kept
        self.unit = self.node.unit and (as_it_came or not consolidated)
        return found if as_it_came or not consolidated else consolidate(found, self.node.parts())

    def settled(self) -> Settled | None:
        found = self.delta()
        return None if found is None else Settled(found)

    def unique(self, spark: SparkSession, pk) -> bool:
        """Whether the result has no two rows of a key, where its pairs are so many that this is better told from the
        sources: it keeps columns that tell pairs apart, and no source has two rows of a key."""
        if not self.node.parts() or self.plan.top or [kind for kind, _ in self.plan.stages if kind != "filter"] != ["select"]:
            return False
        given = {}
        for kind, arg in self.plan.stages:
            for item in split_items(arg) if kind == "select" else ():
                if m := _PLAIN.fullmatch(item):
                    given[m[3] or m[2]] = (m[1], m[2])
        if not self.node.unique_on([given[c] for c in pk if c in given]):
            return False
        sources = {as_source(x.source).ref: x.source for x in leaves(self.plan.root)}
        return not any(several(self.ctx.new(s), self.ctx.key(s)) for s in sources.values())

    @property
    def small(self) -> bool:
        return self.node.small or self.node.delta is None


def _plain(compiled, spark: SparkSession, pk):
    """How a plan without a top is computed, as a whole and from the change."""

    def full(ctx: RunContext) -> DataFrame:
        c = compiled(ctx)
        ctx.unique = c.unique(spark, pk)
        return c.current()

    def delta(ctx: RunContext) -> Settled | None:
        c = compiled(ctx)
        ctx.unique = c.unique(spark, pk)
        return c.settled()

    return full, delta


def _limits(plan: Builder) -> dict[str, float | None]:
    return {as_source(x.source).ref: x.p for x in leaves(plan.root)}


def _sql(plan: Builder, ctx: RunContext) -> DataFrame:
    df = Compiler(plan, ctx).current()
    df.createOrReplaceTempView(plan.name)
    try:
        out = ctx.spark.sql(plan.top[1])
        out.schema  # noqa: B018  resolved while the view is there
        return out
    finally:
        ctx.spark.catalog.dropTempView(plan.name)


def materialize(plan: Builder, spark: SparkSession, output: str, *, pk=None, ivm: bool = True, key_filter: bool = True, tag: str | None = None) -> RunResult:
    from ..operators import aggregate, scans

    pk = key_columns(pk)
    kind = plan.top[0] if plan.top else None
    if kind in ("agg", "reduce"):
        pk = pk or plan.top[1][0]
    if not pk:
        raise BuildError(f"{output}: .merge_into needs a pk")
    if plan.order and kind not in ("acc", "reduce"):
        raise BuildError(".along needs .accumulate or a reduce after it")
    compiled = lambda ctx: Compiler(plan, ctx, key_filter)
    if kind == "agg":
        full, delta = aggregate.closures(output, *plan.top[1], compiled)
    elif kind == "acc":
        full, delta = scans.closures(output, *plan.top[1], plan.order, pk, compiled)
    elif kind == "reduce":
        full, delta = scans.reduce_closures(output, *plan.top[1], plan.order, compiled)
    elif kind == "sql":
        full, delta = (lambda ctx: _sql(plan, ctx)), None
    else:
        full, delta = _plain(compiled, spark, pk)
    sources = [x.source for x in leaves(plan.root)]
    return run(spark, output, sources=sources, pk=pk, full=full, delta=delta if ivm else None, p=_limits(plan), tag=tag, plan_print=plan.print(pk))


def materialize_append(plan: Builder, spark: SparkSession, output: str, *, pk=None, fail_on_conflict: bool = True, log_drops: bool = True, ivm: bool = True, key_filter: bool = True, tag: str | None = None) -> RunResult:
    if plan.top and plan.top[0] != "sql":
        raise BuildError(f".append_to can't follow .{plan.top[0]}")
    if plan.order:
        raise BuildError(".along needs .accumulate or a reduce after it")
    compiled = lambda ctx: Compiler(plan, ctx, key_filter)
    if plan.top:
        full, delta = (lambda ctx: _sql(plan, ctx)), None
    else:
        full, delta = (lambda ctx: compiled(ctx).current()), (lambda ctx: compiled(ctx).settled())
    pk = key_columns(pk)
    sources = [x.source for x in leaves(plan.root)]
    return run_append(
        spark, output, sources=sources, pk=pk, full=full, delta=delta if ivm else None, p=_limits(plan), tag=tag,
        fail_on_conflict=fail_on_conflict, log_drops=log_drops, plan_print=plan.print(pk),
    )
