"""Aggregate metrics and how each is kept up to date.

A *family* is the accumulator that one or more metrics share: an aggregate over any bag of rows, a merge of
the state with what a change inserted and deleted, and for families that can't take a row back, a rescan
of the group. Its state is one struct column named for its content, so a changed metric never meets
another's state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.zset import RESERVED


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _how(how: str) -> str:
    kind = {"sample": "sample", "samp": "sample", "pop": "pop", "population": "pop"}.get(str(how).lower())
    if kind is None:
        raise ValueError(f"how is 'sample' or 'pop', not {how!r}")
    return kind


# ---- families ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Family:
    """state: aggregate over the rows where a condition holds. merge: the state after a change, from
    structs a (before; null for a new group), i (inserted rows) and d (deleted rows). Families with rescan
    set have no use for d: a group that lost rows is aggregated anew."""

    columns: tuple[str, ...]
    rescan = False
    #: The struct's fields in their order, and those of them that don't grow with the rows.
    fields = ()
    means = ()

    @property
    def name(self) -> str:
        return RESERVED + "_".join([type(self).__name__.lower(), *getattr(self, "extra", ()), *self.columns])

    def state(self, where: Column) -> Column:
        raise NotImplementedError

    def merge(self, a: Column, i: Column, d: Column) -> Column:
        raise NotImplementedError

    def times(self, s: Column, k: Column) -> Column:
        """The state of rows that are there k times, from that of the rows."""
        return s if self.rescan else F.struct(*[s[x].alias(x) if x in self.means else (s[x] * k).alias(x) for x in self.fields])


def _n(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("long"))


def _z(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


@dataclass(frozen=True)
class Rows(Family):
    columns: tuple[str, ...] = ()
    fields = ("n",)

    def state(self, where):
        return F.struct(F.count(F.when(where, F.lit(1))).alias("n"))

    def merge(self, a, i, d):
        return F.struct((_n(a["n"]) + _n(i["n"]) - _n(d["n"])).alias("n"))


@dataclass(frozen=True)
class Total(Family):
    fields = ("n", "s")

    def state(self, where):
        x = F.when(where, _col(self.columns[0]))
        return F.struct(F.count(x).alias("n"), F.sum(x).alias("s"))

    def merge(self, a, i, d):
        n = _n(a["n"]) + _n(i["n"]) - _n(d["n"])
        zero = F.lit(0)
        s = F.coalesce(a["s"], zero) + F.coalesce(i["s"], zero) - F.coalesce(d["s"], zero)
        return F.struct(n.alias("n"), F.when(n > 0, s).alias("s"))


@dataclass(frozen=True)
class Moments(Family):
    """Count, mean and centred sum of squares, merged in and out by the pairwise update."""

    fields, means = ("n", "mean", "m2"), ("mean",)

    def state(self, where):
        x = F.when(where, _col(self.columns[0]).cast("double"))
        n = F.count(x)
        return F.struct(n.alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("m2"))

    def merge(self, a, i, d):
        na, ni, nd = _n(a["n"]), _n(i["n"]), _n(d["n"])
        n1 = na + ni
        gap = _z(i["mean"]) - _z(a["mean"])
        mean1 = F.when(n1 > 0, (_z(a["mean"]) * na + _z(i["mean"]) * ni) / n1)
        m1 = _z(a["m2"]) + _z(i["m2"]) + F.when((na > 0) & (ni > 0), gap * gap * na * ni / n1).otherwise(0.0)
        n2 = n1 - nd
        mean2 = F.when(n2 > 0, F.when(nd > 0, (mean1 * n1 - _z(d["mean"]) * nd) / n2).otherwise(mean1))
        back = _z(d["mean"]) - mean2
        m2 = F.when(n2 > 1, F.greatest(F.lit(0.0), m1 - F.when(nd > 0, _z(d["m2"]) + back * back * nd * n2 / n1).otherwise(0.0)))
        return F.struct(n2.alias("n"), mean2.alias("mean"), F.when(n2 > 0, F.coalesce(m2, F.lit(0.0))).alias("m2"))


@dataclass(frozen=True)
class Extremes(Family):
    rescan = True

    def state(self, where):
        x = F.when(where, _col(self.columns[0]))
        return F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))

    def merge(self, a, i, d):
        return F.struct(F.least(a["lo"], i["lo"]).alias("lo"), F.greatest(a["hi"], i["hi"]).alias("hi"))


@dataclass(frozen=True)
class Product(Family):
    """Counts of values, zeros and negatives, and the sum of logarithms: a product that factors can leave."""

    fields = ("n", "zeros", "minus", "ln")

    def state(self, where):
        x = F.when(where, _col(self.columns[0]).cast("double"))
        return F.struct(
            F.count(x).alias("n"), F.count(F.when(x == 0, F.lit(1))).alias("zeros"),
            F.count(F.when(x < 0, F.lit(1))).alias("minus"), F.sum(F.when(x != 0, F.log(F.abs(x)))).alias("ln"),
        )

    def merge(self, a, i, d):
        parts = [(_n(a[f]) + _n(i[f]) - _n(d[f])).alias(f) for f in ("n", "zeros", "minus")]
        live = (_n(a["n"]) + _n(i["n"]) - _n(d["n"])) - (_n(a["zeros"]) + _n(i["zeros"]) - _n(d["zeros"]))
        ln = _z(a["ln"]) + _z(i["ln"]) - _z(d["ln"])
        return F.struct(*parts, F.when(live > 0, ln).otherwise(0.0).alias("ln"))


@dataclass(frozen=True)
class Weighted(Family):
    """columns: (x, w), or (w,) for the weight alone."""

    fields = ("n", "num", "den")

    def state(self, where):
        w = _col(self.columns[-1]).cast("double")
        x = _col(self.columns[0]).cast("double") if len(self.columns) > 1 else F.lit(1.0)
        both = where & x.isNotNull() & w.isNotNull()
        return F.struct(F.count(F.when(both, F.lit(1))).alias("n"), F.sum(F.when(both, x * w)).alias("num"), F.sum(F.when(both, w)).alias("den"))

    def merge(self, a, i, d):
        n = _n(a["n"]) + _n(i["n"]) - _n(d["n"])
        sums = [F.when(n > 0, _z(a[f]) + _z(i[f]) - _z(d[f])).alias(f) for f in ("num", "den")]
        return F.struct(n.alias("n"), *sums)


@dataclass(frozen=True)
class Comoments(Family):
    """Counts, means and centred sums of pairs where both are there."""

    fields, means = ("n", "mx", "my", "xx", "yy", "xy"), ("mx", "my")

    def state(self, where):
        x, y = (_col(c).cast("double") for c in self.columns)
        both = where & x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        n = F.count(x)
        return F.struct(
            n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
            (F.var_pop(x) * n).alias("xx"), (F.var_pop(y) * n).alias("yy"), (F.covar_pop(x, y) * n).alias("xy"),
        )

    def merge(self, a, i, d):
        na, ni, nd = _n(a["n"]), _n(i["n"]), _n(d["n"])
        n1 = na + ni
        n2 = n1 - nd
        up, mid, low = {}, {}, {}
        for m in ("mx", "my"):
            up[m] = _z(i[m]) - _z(a[m])
            mid[m] = F.when(n1 > 0, (_z(a[m]) * na + _z(i[m]) * ni) / n1)
            low[m] = F.when(n2 > 0, F.when(nd > 0, (mid[m] * n1 - _z(d[m]) * nd) / n2).otherwise(mid[m]))
        out = [n2.alias("n"), low["mx"].alias("mx"), low["my"].alias("my")]
        for f, p, r in (("xx", "mx", "mx"), ("yy", "my", "my"), ("xy", "mx", "my")):
            grown = _z(a[f]) + _z(i[f]) + F.when((na > 0) & (ni > 0), up[p] * up[r] * na * ni / n1).otherwise(0.0)
            shrunk = grown - F.when(nd > 0, _z(d[f]) + (_z(d[p]) - low[p]) * (_z(d[r]) - low[r]) * nd * n2 / n1).otherwise(0.0)
            left = shrunk if f == "xy" else F.greatest(F.lit(0.0), shrunk)
            out.append(F.when(n2 > 1, left).when(n2 > 0, 0.0).alias(f))
        return F.struct(*out)


@dataclass(frozen=True)
class Arg(Family):
    """columns: (payload, key). Of equal keys the smallest payload (for max the largest) is taken."""

    most: bool = False
    rescan = True

    @property
    def extra(self):
        return ("max",) if self.most else ("min",)

    def state(self, where):
        arg, key = (_col(c) for c in self.columns)
        pair = F.when(where & key.isNotNull(), F.struct(key.alias("key"), arg.alias("arg")))
        return F.max(pair) if self.most else F.min(pair)

    def merge(self, a, i, d):
        return F.greatest(a, i) if self.most else F.least(a, i)


@dataclass(frozen=True)
class Fold(Family):
    """bool_and, bool_or, bit_and, bit_or."""

    op: str = "bool_and"
    rescan = True

    @property
    def extra(self):
        return (self.op,)

    def state(self, where):
        x = F.when(where, _col(self.columns[0]))
        return F.struct({"bool_and": F.bool_and, "bool_or": F.bool_or, "bit_and": F.bit_and, "bit_or": F.bit_or}[self.op](x).alias("v"))

    def merge(self, a, i, d):
        x, y = a["v"], i["v"]
        joined = {"bool_and": x & y, "bool_or": x | y, "bit_and": x.bitwiseAND(y), "bit_or": x.bitwiseOR(y)}[self.op]
        return F.struct(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(joined).alias("v"))


# ---- metrics ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Metric:
    """A named value of a group: its family and how it is read off the family's struct."""

    name: str
    family: Family
    derive: Callable[[Column], Column]
    print: tuple = ()


@dataclass(frozen=True)
class Reduce:
    """An ordered fold: fn(state, row) -> (state, value) along the plan's order, init first; the last value
    is the group's."""

    fn: Callable[[Any, dict], tuple[Any, Any]]
    init: Any
    dtype: str = "double"


def _metric(name, family, derive, *more) -> Metric:
    return Metric(name, family, derive, (name, family.name, *more))


def count() -> Metric:
    return _metric("count", Rows(), lambda s: s["n"])


def sum(col: str) -> Metric:  # noqa: A001
    return _metric("sum", Total((col,)), lambda s: s["s"])


def mean(col: str) -> Metric:
    return _metric("mean", Total((col,)), lambda s: F.when(s["n"] > 0, s["s"].cast("double") / s["n"]))


def _spread(s: Column, how: str, f: str = "m2") -> Column:
    return F.when(s["n"] > 1, s[f] / (s["n"] - 1)) if how == "sample" else F.when(s["n"] > 0, s[f] / s["n"])


def var(col: str, how: str = "sample") -> Metric:
    kind = _how(how)
    return _metric("var", Moments((col,)), lambda s: _spread(s, kind), kind)


def stddev(col: str, how: str = "sample") -> Metric:
    kind = _how(how)
    return _metric("stddev", Moments((col,)), lambda s: F.sqrt(_spread(s, kind)), kind)


def min(col: str) -> Metric:  # noqa: A001
    return _metric("min", Extremes((col,)), lambda s: s["lo"])


def max(col: str) -> Metric:  # noqa: A001
    return _metric("max", Extremes((col,)), lambda s: s["hi"])


def product(col: str) -> Metric:
    sign = lambda s: F.when(s["minus"] % 2 == 1, -1.0).otherwise(1.0)
    return _metric("product", Product((col,)), lambda s: F.when(s["n"] == 0, None).when(s["zeros"] > 0, 0.0).otherwise(sign(s) * F.exp(s["ln"])))


def weight_total(w: str) -> Metric:
    return _metric("weight_total", Weighted((w,)), lambda s: s["den"])


def weighted_sum(x: str, w: str) -> Metric:
    return _metric("weighted_sum", Weighted((x, w)), lambda s: s["num"])


def weighted_average(x: str, w: str) -> Metric:
    return _metric("weighted_average", Weighted((x, w)), lambda s: F.when(s["den"] != 0, s["num"] / s["den"]))


def covariance(x: str, y: str, how: str = "sample") -> Metric:
    kind = _how(how)
    return _metric("covariance", Comoments((x, y)), lambda s: _spread(s, kind, "xy"), kind)


def pearson_correlation(x: str, y: str) -> Metric:
    ok = lambda s: (s["n"] > 1) & (s["xx"] > 0) & (s["yy"] > 0)
    return _metric("pearson_correlation", Comoments((x, y)), lambda s: F.when(ok(s), s["xy"] / F.sqrt(s["xx"] * s["yy"])))


def ols_slope(x: str, y: str) -> Metric:
    return _metric("ols_slope", Comoments((x, y)), lambda s: F.when(s["xx"] > 0, s["xy"] / s["xx"]))


def ols_intercept(x: str, y: str) -> Metric:
    return _metric("ols_intercept", Comoments((x, y)), lambda s: F.when(s["xx"] > 0, s["my"] - s["xy"] / s["xx"] * s["mx"]))


def argmin(arg: str, by: str) -> Metric:
    return _metric("argmin", Arg((arg, by)), lambda s: s["arg"])


def argmax(arg: str, by: str) -> Metric:
    return _metric("argmax", Arg((arg, by), True), lambda s: s["arg"])


def bool_and(col: str) -> Metric:
    return _metric("bool_and", Fold((col,), "bool_and"), lambda s: s["v"])


def bool_or(col: str) -> Metric:
    return _metric("bool_or", Fold((col,), "bool_or"), lambda s: s["v"])


def bit_and(col: str) -> Metric:
    return _metric("bit_and", Fold((col,), "bit_and"), lambda s: s["v"])


def bit_or(col: str) -> Metric:
    return _metric("bit_or", Fold((col,), "bit_or"), lambda s: s["v"])


def reduce(fn: Callable[[Any, dict], tuple[Any, Any]], init: Any, *, dtype: str = "double") -> Reduce:
    return Reduce(fn, init, dtype)
