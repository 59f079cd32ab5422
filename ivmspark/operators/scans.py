"""Ordered scans: every row with running values in its group, kept up to date.

Most metrics are window functions with the group's carried values added in, so the work stays in generated
code; those whose step needs the step before (ema, tema, scan, reduce) are then folded row by row over the
same sorted partitions, a batch at a time, so no group is ever held as a whole.

A group's state (its last row's carried values and its high-water mark) is a sidecar of the output,
committed with it. A group that only gained rows past its mark is resumed: the new rows alone are scanned,
from the carried values. Any other changed group is scanned anew and compared with its old output. Which is
which is a column, never a list on the driver.

Order: the order column, nulls last, then the key, then what else can be ordered. A group with a null in
its order column is always scanned anew, as any later row comes before it.

A scan without groups is cut by ranges of the order. What each part adds up to is carried into the parts after
it as a group's state is into the next run, so parts are scanned side by side. Folds can't be: they go row by row.
"""

from __future__ import annotations

import copy
import datetime
import decimal
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, FloatType, LongType, MapType, StringType, StructField, StructType

from ..functions.acc import Scan
from ..sources.store import table
from .zset import RESERVED, WEIGHT, as_zset, expand, q, restrict, union

STATE = "scan"
_HW, _N, _OPEN, _RN, _LAST, _GROUP, _PART = (RESERVED + x for x in ("hw", "n", "nulls", "rn", "last", "g", "part"))


def _c(name: str) -> F.Column:
    return F.col(q(name))


def _carry(name: str) -> str:
    return f"{RESERVED}c_{name}"


def _kind(ddl) -> DataType:
    return ddl if isinstance(ddl, DataType) else DataType.fromDDL(ddl)


def out_type(m, schema: StructType) -> DataType:
    if m.kind in ("ema", "tema", "product", "convolution"):
        return DoubleType()
    if m.kind == "count":
        return LongType()
    if m.kind == "scan":
        return _kind(m.dtype)
    t = schema[m.col].dataType
    if m.kind == "sum":
        if isinstance(t, DecimalType):
            return DecimalType(min(38, t.precision + 10), t.scale)
        return t if isinstance(t, (DoubleType, FloatType)) else LongType()
    return t


def carry_type(m, schema: StructType) -> DataType:
    if m.kind == "lag":
        return ArrayType(schema[m.col].dataType)
    if m.kind == "convolution":
        return ArrayType(DoubleType())
    if m.kind == "tema":
        return StructType([StructField("v", DoubleType()), StructField("t", DoubleType())])
    if m.kind == "scan":
        return StringType()
    return out_type(m, schema)


# ---- JSON of a fold's state --------------------------------------------------------------------------


def _pack(x):
    if isinstance(x, decimal.Decimal):
        return {"__decimal": str(x)}
    if isinstance(x, datetime.datetime):
        return {"__datetime": x.isoformat()}
    if isinstance(x, datetime.date):
        return {"__date": x.isoformat()}
    raise TypeError(f"a fold's state must be representable as JSON; {type(x).__name__} is not")


def _unpack(d: dict):
    if len(d) == 1:
        (k, v), = d.items()
        if k == "__decimal":
            return decimal.Decimal(v)
        if k == "__datetime":
            return datetime.datetime.fromisoformat(v)
        if k == "__date":
            return datetime.date.fromisoformat(v)
    return d


# ---- the scan ----------------------------------------------------------------------------------------


def _orderable(t: DataType) -> bool:
    if isinstance(t, MapType):
        return False
    if isinstance(t, ArrayType):
        return _orderable(t.elementType)
    return all(_orderable(f.dataType) for f in t.fields) if isinstance(t, StructType) else True


def _native(m: Scan, name: str, schema: StructType, w, run, rn, total):
    """(value, carried value) of a window metric."""
    kind, carried = out_type(m, schema), _c(_carry(name))
    if m.kind == "count":
        return total, total
    x = _c(m.col)
    if m.kind == "sum":
        zero = F.lit(0).cast(kind)
        v = (F.coalesce(carried, zero) + F.sum(F.coalesce(x.cast(kind), zero)).over(run)).cast(kind)
        return v, v
    if m.kind in ("min", "max"):
        v = F.least(carried, F.min(x).over(run)) if m.kind == "min" else F.greatest(carried, F.max(x).over(run))
        return v, v
    if m.kind == "first":
        v = F.coalesce(carried, F.first(x, ignorenulls=True).over(run))
        return v, v
    if m.kind == "product":
        p = F.product(x.cast("double")).over(run)
        v = F.when(carried.isNull(), p).when(p.isNull(), carried).otherwise(carried * p)
        return v, v

    def back(k: int, value):
        """The value k rows back, from the carried ones where the new rows don't reach."""
        return F.when(rn > k, F.lag(value, k).over(w)).otherwise(F.get(carried, F.size(carried) - (F.lit(k) - rn + 1)))

    held = m.n
    if m.kind == "lag":
        v, value = back(m.n, x), x
    else:
        value = F.coalesce(x.cast("double"), F.lit(0.0))
        dot = value * m.kernel[-1]
        for i, k in enumerate(m.kernel[:-1]):
            dot = dot + back(m.n - i, value) * k
        v = F.when(total > m.n, dot)
    if not held:
        return v, F.array().cast(carry_type(m, schema))
    recent = F.transform(F.collect_list(F.struct(value.alias("v"))).over(w.rowsBetween(-(held - 1), 0)), lambda s: s["v"])
    joined = F.concat(F.coalesce(carried, F.array().cast(carry_type(m, schema))), recent)
    joined = F.when(rn >= held, recent).otherwise(joined)
    kept = F.slice(joined, F.greatest(F.lit(1), F.size(joined) - (held - 1)), held)
    return v, kept


def _after(rows: DataFrame, by, along: str, pk) -> list[str]:
    """The columns that rows are in order of after the order column."""
    users = [c for c in rows.columns if not c.startswith(RESERVED)]
    rest = [c for c in users if c != along and c not in pk and c not in by and _orderable(rows.schema[c].dataType)]
    return [c for c in pk if c in users and c != along and c not in by] + rest


def _in_parts(ctx, rows: DataFrame, along: str, pk, metrics) -> DataFrame:
    """scanned, of rows of one group (with its carried columns on each), by ranges of the order side by side."""
    schema, after = rows.schema, _after(rows, (), along, pk)
    # parts are by a sample, so they are made once
    dealt = ctx.keep(rows.repartitionByRange(_c(along).asc_nulls_last(), *map(_c, after)).withColumn(_PART, F.spark_partition_id()))
    x = lambda i: f"{RESERVED}x{i}"
    own = [_HW, _N, _OPEN, *[_carry(n) for n, _ in metrics]]
    sums = [F.count("*").alias(RESERVED + "rows"), F.max(_c(along)).alias(RESERVED + "most"), F.bool_or(_c(along).isNull()).alias(RESERVED + "unplaced"), *[F.first(c).alias(c) for c in own]]
    place, value, held = F.struct(_c(along).isNull(), _c(along), *map(_c, after)), {}, {}
    for i, (_, m) in enumerate(metrics):
        kind = out_type(m, schema)
        if m.kind == "sum":
            sums.append(F.sum(F.coalesce(_c(m.col).cast(kind), F.lit(0).cast(kind))).cast(kind).alias(x(i)))
        elif m.kind in ("min", "max"):
            sums.append((F.min if m.kind == "min" else F.max)(_c(m.col)).alias(x(i)))
        elif m.kind == "first":
            sums.append(F.min_by(_c(m.col), F.when(_c(m.col).isNotNull(), place)).alias(x(i)))
        elif m.kind == "product":
            sums.append(F.product(_c(m.col).cast("double")).alias(x(i)))
        elif m.kind in ("lag", "convolution") and m.n:
            value[x(i)], held[x(i)] = _c(m.col) if m.kind == "lag" else F.coalesce(_c(m.col).cast("double"), F.lit(0.0)), m.n
    parts = dealt.groupBy(_PART).agg(*sums)
    if held:
        back = W.partitionBy(_PART).orderBy(_c(along).desc_nulls_first(), *[_c(c).desc_nulls_last() for c in after])
        ends = dealt.select(_PART, *[v.alias(k) for k, v in value.items()], F.row_number().over(back).alias(_RN)).where(F.col(_RN) <= max(held.values()))
        ends = ends.groupBy(_PART).agg(F.array_sort(F.collect_list(F.struct((-F.col(_RN)).alias("at"), *held))).alias(RESERVED + "ends"))
        parts = parts.join(ends, _PART)
    w = W.orderBy(_PART)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.greatest(_c(_HW), F.max(RESERVED + "most").over(before)).alias(_HW)]
    carried.append((F.coalesce(_c(_N), F.lit(0).cast("long")) + F.coalesce(F.sum(RESERVED + "rows").over(before), F.lit(0).cast("long"))).alias(_N))
    carried.append((F.coalesce(_c(_OPEN), F.lit(False)) | F.coalesce(F.bool_or(RESERVED + "unplaced").over(before), F.lit(False))).alias(_OPEN))
    for i, (n, m) in enumerate(metrics):
        kind, was = carry_type(m, schema), _c(_carry(n))
        if m.kind == "sum":
            zero = F.lit(0).cast(kind)
            v = F.coalesce(was, zero) + F.coalesce(F.sum(x(i)).over(before).cast(kind), zero)
        elif m.kind in ("min", "max"):
            v = F.least(was, F.min(x(i)).over(before)) if m.kind == "min" else F.greatest(was, F.max(x(i)).over(before))
        elif m.kind == "first":
            v = F.coalesce(was, F.first(x(i), ignorenulls=True).over(before))
        elif m.kind == "product":
            p = F.product(x(i)).over(before)
            v = F.when(was.isNull(), p).when(p.isNull(), was).otherwise(was * p)
        elif x(i) in held:
            mine = F.flatten(F.collect_list(RESERVED + "ends").over(before))[x(i)]
            every = F.concat(F.coalesce(was, F.array().cast(kind)), mine)
            v = F.slice(every, F.greatest(F.lit(1), F.size(every) - (held[x(i)] - 1)), held[x(i)])
        else:
            v = was
        carried.append(v.cast(kind).alias(_carry(n)))
    carry = ctx.keep(parts.select(_PART, *carried, F.lead(_PART).over(w).isNull().alias(RESERVED + "end")))
    rows = dealt.drop(*own, _GROUP).join(F.broadcast(carry.drop(RESERVED + "end")), _PART)
    done = scanned(rows, (_PART,), along, pk, metrics).join(F.broadcast(carry.select(_PART, RESERVED + "end")), _PART)
    return done.withColumn(_LAST, _c(_LAST) & F.col(RESERVED + "end")).withColumn(_GROUP, F.lit(0)).drop(_PART, RESERVED + "end")


def _done(ctx, rows: DataFrame, by, along: str, pk, metrics) -> DataFrame:
    side_by_side = by == (_GROUP,) and not any(m.folded for _, m in metrics)
    return ctx.keep(_in_parts(ctx, rows, along, pk, metrics) if side_by_side else scanned(rows, by, along, pk, metrics))


def scanned(rows: DataFrame, by, along: str, pk, metrics) -> DataFrame:
    """rows, with carried columns of each group on them (null: none), to rows with the metrics' values; on
    each group's last row the carried columns are what the next run resumes from, and _LAST is set."""
    metrics = list(metrics)
    users = [c for c in rows.columns if not c.startswith(RESERVED)]
    schema = rows.schema
    w = W.partitionBy(*map(_c, by)).orderBy(_c(along).asc_nulls_last(), *map(_c, _after(rows, by, along, pk)))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rn = F.row_number().over(w)
    total = F.coalesce(_c(_N), F.lit(0).cast("long")) + rn
    out = [*map(_c, users), *[_c(b) for b in by if b not in users], rn.alias(_RN), F.lead(F.lit(1)).over(w).isNull().alias(_LAST)]
    out += [total.alias(_N), F.greatest(_c(_HW), F.max(_c(along)).over(run)).alias(_HW)]
    out.append((F.coalesce(_c(_OPEN), F.lit(False)) | F.coalesce(F.bool_or(_c(along).isNull()).over(run), F.lit(False))).alias(_OPEN))
    for name, m in metrics:
        if m.folded:
            out.append(_c(_carry(name)))
        else:
            value, carried = _native(m, name, schema, w, run, rn, total)
            out += [value.cast(out_type(m, schema)).alias(name), carried.cast(carry_type(m, schema)).alias(_carry(name))]
    df = rows.select(*out)
    folds = [(n, m) for n, m in metrics if m.folded]
    if folds:
        df = _folded(df, along, users, folds, rows.schema)
    names = [n for n, _ in metrics]
    return df.select(*map(_c, users), *[_c(b) for b in by if b not in users], *map(_c, names), *[_c(_carry(n)) for n in names], _c(_HW), _c(_N), _c(_OPEN), _c(_LAST))


def _folded(df: DataFrame, along: str, users, folds, source: StructType) -> DataFrame:
    """Adds the values of step-by-step metrics. Rows come sorted within their groups, a group in one
    partition, as the window left them."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(n, m, out_type(m, source)) for n, m in folds]
    schema = StructType([*df.schema.fields, *[StructField(n, t) for n, _, t in kinds]])
    own = [(n, m, to_arrow_type(t)) for n, m, t in kinds]

    def smoothed(m, batch, fresh, last, held, state):
        """(values, what each group's last row carries, state) of an ema or tema over a batch's numbers."""
        import pyarrow as pa

        out, f = [], m.factor
        xs = batch.column(m.col).cast(pa.float64()).to_pylist()
        if m.kind == "ema":
            for new, x, h in zip(fresh, xs, held):
                if new:
                    state = h
                if x is not None:
                    state = x if state is None else f * x + (1 - f) * state
                out.append(state)
            return out, out, state
        ts, ends = batch.column(along).cast(pa.float64()).to_pylist(), []
        for new, end, x, t, h in zip(fresh, last, xs, ts, held):
            if new:
                state = h and (h["v"], h["t"])
            if x is not None:
                a = 1.0 if state is None else 1 - math.exp(-f * (t - state[1]))
                state = (x if state is None else a * x + (1 - a) * state[0], t)
            out.append(state and state[0])
            ends.append({"v": state[0], "t": state[1]} if end and state else None)
        return out, ends, state

    def run(batches):
        import pyarrow as pa

        states: dict = {}
        for batch in batches:
            fresh = [rn == 1 for rn in batch.column(_RN).to_pylist()]
            last = batch.column(_LAST).to_pylist()
            values, carried, rows = {}, {}, None
            for n, m, _ in own:
                held = batch.column(_carry(n)).to_pylist()
                if m.kind != "scan":
                    values[n], carried[n], states[n] = smoothed(m, batch, fresh, last, held, states.get(n))
                    continue
                rows = rows if rows is not None else batch.select(users).to_pylist()
                values[n], carried[n] = [], []
                for new, end, h, row in zip(fresh, last, held, rows):
                    if new:
                        states[n] = copy.deepcopy(m.init) if h is None else json.loads(h, object_hook=_unpack)
                    states[n], value = m.fn(states[n], dict(row))
                    values[n].append(value)
                    carried[n].append(json.dumps(states[n], default=_pack) if end else None)
            columns = [pa.array(carried[f[len(RESERVED) + 2 :]], batch.schema.field(f).type) if f.startswith(RESERVED + "c_") and f[len(RESERVED) + 2 :] in carried else batch.column(f) for f in batch.schema.names]
            columns += [pa.array(values[n], t) for n, _, t in own]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[n for n, _, _ in own]])

    return df.mapInArrow(run, schema)


def _without_carry(rows: DataFrame, along: str, metrics) -> DataFrame:
    schema = rows.schema
    nothing = [F.lit(None).cast(schema[along].dataType).alias(_HW), F.lit(None).cast("long").alias(_N), F.lit(None).cast("boolean").alias(_OPEN)]
    return rows.select("*", *nothing, *[F.lit(None).cast(carry_type(m, schema)).alias(_carry(n)) for n, m in metrics])


def _state(done: DataFrame, by, metrics) -> DataFrame:
    return done.where(_c(_LAST)).select(*map(_c, by), _c(_HW), _c(_N), _c(_OPEN), *[_c(_carry(n)) for n, _ in metrics])


def _check(columns, by, along, pk, metrics, output: str) -> None:
    need = list(dict.fromkeys([*by, along, *pk, *(m.col for _, m in metrics if m.col)]))
    missing = [c for c in need if c not in columns]
    if missing:
        raise ValueError(f"{output}: the scan needs column(s) {missing}, the plan has {list(columns)}")
    twice = [n for n, _ in metrics if n in columns]
    if twice:
        raise ValueError(f"{output}: metrics named as columns of the plan: {twice}")


def _advance(ctx, output: str, by, along, pk, metrics, compiled):
    """(scanned rows, keys of groups with how they were done, change) for an incremental run, or None."""
    t = table(ctx.spark, output)
    plan = compiled(ctx)
    change = plan.delta()
    if change is None or not t.schema(STATE):
        return None
    grouped = lambda df: df if by != (_GROUP,) else df.withColumn(_GROUP, F.lit(0))
    change = ctx.keep(grouped(change))
    _check([c for c in change.columns if c not in (WEIGHT, _GROUP)], [b for b in by if b != _GROUP], along, pk, metrics, output)
    state = t.snapshot(stream=STATE)
    keys = [f"{RESERVED}g{i}" for i in range(len(by))]
    touched = change.groupBy(*[_c(b).alias(k) for b, k in zip(by, keys)]).agg(
        F.min(_c(along)).alias(RESERVED + "from"), F.bool_or(F.col(WEIGHT) < 0).alias(RESERVED + "lost"), F.bool_or(_c(along).isNull()).alias(RESERVED + "unplaced")
    )
    on = F.expr(" AND ".join(f"{k} <=> {q(b)}" for b, k in zip(by, keys)))
    touched = touched.join(state, on, "left").drop(*by)
    tail = ~F.col(RESERVED + "lost") & ~F.col(RESERVED + "unplaced") & ~F.coalesce(_c(_OPEN), F.lit(False)) & (_c(_HW).isNull() | (F.col(RESERVED + "from") > _c(_HW)))
    touched = ctx.keep(touched.withColumn(RESERVED + "tail", F.coalesce(tail, F.lit(False))))
    resume = touched.where(RESERVED + "tail").drop(RESERVED + "from", RESERVED + "lost", RESERVED + "unplaced", RESERVED + "tail")
    again = touched.where(f"NOT {RESERVED}tail").select(*keys)
    on = F.expr(" AND ".join(f"{q(b)} <=> {k}" for b, k in zip(by, keys)))
    one = by == (_GROUP,)  # then its state is a row, and all rows are of one key
    new = expand(change).where(F.col(WEIGHT) > 0).drop(WEIGHT).join(F.broadcast(resume) if one else resume, on).drop(*keys)
    past = _without_carry(restrict(grouped(plan.current()), again, by, small=one or plan.small), along, metrics)
    done = _done(ctx, new.unionByName(past), by, along, pk, metrics)
    before = restrict(state, touched.select(*keys), by)
    ctx.sidecars[STATE] = (union(as_zset(_state(done, by, metrics)), as_zset(before, -1)), by, False)
    return done, touched.select(*keys), again


def closures(output: str, by, metrics, along: str, pk, compiled):
    metrics = list(metrics)
    keys = by or (_GROUP,)

    def full(ctx) -> DataFrame:
        rows = compiled(ctx).current()
        _check(rows.columns, by, along, pk, metrics, output)
        rows = rows if by else rows.withColumn(_GROUP, F.lit(0))
        done = _done(ctx, _without_carry(rows, along, metrics), keys, along, pk, metrics)
        ctx.sidecars[STATE] = (_state(done, keys, metrics), keys, True)
        return done.select(*[_c(c) for c in done.columns if not c.startswith(RESERVED)])

    def delta(ctx) -> DataFrame | None:
        found = _advance(ctx, output, keys, along, pk, metrics, compiled)
        if found is None:
            return None
        done, _, again = found
        now = done.select(*[_c(c) for c in done.columns if not c.startswith(RESERVED)])
        was = table(ctx.spark, output).snapshot()
        was = restrict(was, again, by) if by else was.join(again.limit(1).select(F.lit(1).alias(RESERVED + "x")), F.lit(True), "left_semi")
        return union(as_zset(now), as_zset(was.select(*now.columns), -1))

    return full, delta


def reduce_closures(output: str, by, metrics, along: str, compiled):
    """A reduce is a scan of which each group's last value is kept."""
    metrics = [(n, Scan("scan", fn=r.fn, init=r.init, dtype=r.dtype)) for n, r in metrics]
    names = [n for n, _ in metrics]

    def last(done: DataFrame) -> DataFrame:
        return done.where(_c(_LAST)).select(*map(_c, by), *map(_c, names))

    def full(ctx) -> DataFrame:
        rows = compiled(ctx).current()
        _check(rows.columns, by, along, (), metrics, output)
        done = ctx.keep(scanned(_without_carry(rows, along, metrics), by, along, (), metrics))
        ctx.sidecars[STATE] = (_state(done, by, metrics), by, True)
        return last(done)

    def delta(ctx) -> DataFrame | None:
        found = _advance(ctx, output, by, along, (), metrics, compiled)
        if found is None:
            return None
        done, touched, _ = found
        was = restrict(table(ctx.spark, output).snapshot(), touched, by)
        return union(as_zset(last(done)), as_zset(was.select(*by, *names), -1))

    return full, delta
