"""Every metric after every kind of change, beside what Spark's own aggregates say of the rows as they are."""

import math
import random
from decimal import Decimal

import pytest

from ivmspark import WEIGHT, agg, current, source, table
from ivmspark.operators import aggregate
from ivmspark.sources.store import VersionedTable

EVENTS = "/root/testdata/sf0.001/events.parquet"

#: metric -> (the plan's metric, SQL over the rows that gives the same)
METRICS = {
    "n": (agg.count(), "count(*)"),
    "total": (agg.sum("x"), "sum(x)"),
    "whole": (agg.sum("k"), "sum(k)"),
    "money": (agg.sum("d"), "sum(d)"),
    "avg": (agg.mean("x"), "avg(x)"),
    "vs": (agg.var("x"), "var_samp(x)"),
    "vp": (agg.var("x", "pop"), "var_pop(x)"),
    "ss": (agg.stddev("x"), "stddev_samp(x)"),
    "sp": (agg.stddev("x", "population"), "stddev_pop(x)"),
    "lo": (agg.min("x"), "min(x)"),
    "hi": (agg.max("kind"), "max(kind)"),
    "prod": (agg.product("f"), "IF(count(f) = 0, NULL, aggregate(collect_list(f), CAST(1 AS DOUBLE), (a, x) -> a * x))"),
    "w": (agg.weight_total("w"), "sum(CASE WHEN w IS NOT NULL THEN w END)"),
    "ws": (agg.weighted_sum("x", "w"), "sum(x * w)"),
    "wa": (agg.weighted_average("x", "w"), "sum(x * w) / nullif(sum(CASE WHEN x IS NOT NULL THEN w END), 0)"),
    "cs": (agg.covariance("x", "w"), "covar_samp(x, w)"),
    "cp": (agg.covariance("x", "w", "pop"), "covar_pop(x, w)"),
    "r": (agg.pearson_correlation("x", "w"), "corr(x, w)"),
    "slope": (agg.ols_slope("x", "w"), "regr_slope(w, x)"),
    "icept": (agg.ols_intercept("x", "w"), "regr_intercept(w, x)"),
    "first": (agg.argmin("kind", "id"), "min_by(kind, id)"),
    "last": (agg.argmax("x", "id"), "max_by(x, id)"),
    "every": (agg.bool_and("big"), "bool_and(big)"),
    "some": (agg.bool_or("big"), "bool_or(big)"),
    "common": (agg.bit_and("id"), "bit_and(id)"),
    "union": (agg.bit_or("id"), "bit_or(id)"),
}


def rows_of(spark, n=400):
    """Events with columns for every metric: nulls in all of them, a null group, groups of one row."""
    df = spark.read.parquet(EVENTS).where(f"event_id <= {n}")
    return df.selectExpr(
        "CAST(event_id AS int) AS id", "IF(user_id % 11 = 3, NULL, IF(event_id < 6, -event_id, user_id % 7)) AS g", "IF(event_id % 13 = 0, NULL, value) AS x", "CAST(event_id % 17 AS short) AS k",
        "CAST(value AS decimal(12,2)) AS d", "IF(event_id % 19 = 0, NULL, CAST(event_id % 5 AS double)) AS w", "IF(event_id % 7 = 0, NULL, 1 + value / 1e4) AS f",
        "IF(event_id % 23 = 0, NULL, event_type) AS kind", "IF(event_id % 5 = 0, NULL, value > 50) AS big",
    )


def plain(spark, name, metrics, by="g"):
    exprs = ", ".join(f"{METRICS[m][1]} AS {m}" for m in metrics)
    spark.conf.set("spark.sql.ansi.enabled", "false")  # a slope of no spread is null then, not an error
    try:
        return {r[0]: tuple(r)[1:] for r in spark.sql(f"SELECT {by}, {exprs} FROM {name} GROUP BY {by}").collect()}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7) or math.isnan(a) and math.isnan(b)
    return a == b


def check(spark, name, out, metrics):
    got = {r["g"]: tuple(r[m] for m in metrics) for r in current(spark, out).collect()}
    want = plain(spark, name, metrics)
    assert got.keys() == want.keys()
    bad = [(g, m, x, y) for g in want for m, x, y in zip(metrics, got[g], want[g]) if not same(x, y) and not (m in ("r", "slope", "icept") and x is None and (y is None or math.isnan(y)))]
    assert not bad, bad


@pytest.mark.parametrize("metrics", [list(METRICS), [m for m in METRICS if m not in ("lo", "hi", "first", "last", "every", "some", "common", "union")]], ids=["all", "additive"])
def test_all_metrics_through_a_history(spark, db, metrics):
    t, rng = table(spark, db("e")), random.Random(len(metrics))
    every = rows_of(spark, 600)
    t.create(every.where("id <= 400"), pk="id")
    plan = source(t.name, p=1.0).aggregate(by="g", **{m: METRICS[m][0] for m in metrics})
    plan.merge_into(spark, db("out"))
    check(spark, t.name, db("out"), metrics)
    changes = [
        lambda: t.insert(every.where("id BETWEEN 401 AND 500")),
        lambda: t.update("id % 9 = 4", x="x * 1.5", d="d + 1.25", kind="'zzz'", big="NOT big", f="-f"),
        lambda: (t.delete("g = 3"), t.delete("x > 80"), t.update("id % 10 = 1", g="g + 20")),
        lambda: (t.insert(every.where("id > 500")), t.update("true", k="CAST(k + 1 AS short)", x="coalesce(x, 0.0)", w="w + 1", f=f"IF(id % 31 = 0, 0.0, f + {rng.random()})")),
        lambda: t.delete("true"),
        lambda: t.insert(every.where("id < 50")),
    ]
    for change in changes if len(metrics) == len(METRICS) else changes[1:4]:
        change()
        assert plan.merge_into(spark, db("out")).status == "incremental"
        check(spark, t.name, db("out"), metrics)


def test_a_feed_has_the_groups_that_changed(spark, db):
    t = table(spark, db("e"))
    t.create(rows_of(spark), pk="id")
    plan = source(t.name, p=1.0).aggregate(by="g", top=agg.max("x"), n=agg.count())
    plan.merge_into(spark, db("out"))
    best = {r[0]: r[1] for r in spark.sql(f"SELECT g, max_by(id, x) FROM {t.name} WHERE x IS NOT NULL GROUP BY g").collect()}
    t.update(f"id = {best[2]}", x="-1.0")
    t.update(f"g = 4 AND id <> {best[4]}", x="x")  # nothing that any metric sees
    plan.merge_into(spark, db("out"))
    assert db.feed("out", "g") == [2]
    t.delete("g = -1")
    plan.merge_into(spark, db("out"))
    assert db.feed("out", "g") == [-1] and -1 not in {r[0] for r in db.rows("out")}


def test_rows_of_any_weight(spark, db):
    """A keyless source whose rows are there millions of times: aggregates count them without making them."""
    ddl = "g string, x double, d decimal(10,2), w double, ok boolean"
    t = db.make("bag", [("a", 2.0, Decimal("1.10"), 1.0, True), ("a", 5.0, Decimal("0.25"), 2.0, False), ("b", 7.0, None, None, None)], ddl)
    plan = source(t.name, p=1.0).aggregate(
        by="g", n=agg.count(), s=agg.sum("x"), d=agg.sum("d"), m=agg.mean("x"), v=agg.var("x", "pop"), c=agg.covariance("x", "w", "pop"), ws=agg.weighted_sum("x", "w"),
        lo=agg.min("x"), hi=agg.max("x"), last=agg.argmax("w", "x"), every=agg.bool_and("ok"),
    )
    plan.merge_into(spark, db("out"))
    many = 3_000_000_000
    signed = lambda *rows: spark.createDataFrame(rows, f"{ddl}, {WEIGHT} long")
    t.merge(signed(("a", 2.0, Decimal("1.10"), 1.0, True, many), ("b", 8.0, Decimal("2.00"), 1.0, True, 5)))
    assert plan.merge_into(spark, db("out")).status == "incremental"
    got = {r["g"]: r for r in current(spark, db("out")).collect()}
    n, p = many + 2, 1 / (many + 2)
    a = got["a"]
    assert (a["n"], a["s"], a["d"]) == (n, 2.0 * (many + 1) + 5, Decimal("1.10") * (many + 1) + Decimal("0.25")) and a["m"] == pytest.approx(a["s"] / n)
    assert a["v"] == pytest.approx(9 * p * (1 - p), rel=1e-6) and a["c"] == pytest.approx(3 * p * (1 - p), rel=1e-6) and a["ws"] == 2.0 * (many + 1) + 10
    assert (a["lo"], a["hi"], a["last"], a["every"]) == (2.0, 5.0, 2.0, False)
    assert (got["b"]["n"], got["b"]["s"], got["b"]["d"], got["b"]["hi"], got["b"]["every"]) == (6, 47.0, Decimal("10.00"), 8.0, True)
    t.merge(signed(("a", 2.0, Decimal("1.10"), 1.0, True, -many)))
    assert plan.merge_into(spark, db("out")).status == "incremental"
    a = {r["g"]: r for r in current(spark, db("out")).collect()}["a"]
    assert (a["n"], a["s"], a["d"], a["lo"], a["hi"]) == (2, 7.0, Decimal("1.35"), 2.0, 5.0)


def test_folds_of_weights_are_those_of_the_rows(spark):
    """By digits of the weights, and by the rows made one by one: the same accumulators."""
    from ivmspark.operators.zset import expand

    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.random() * 10, rng.random(), rng.choice([-7, -1, 1, 2, 3, 12])) for _ in range(40)]
    z = spark.createDataFrame(rows, f"g string, x double, y double, {WEIGHT} long")
    fams = aggregate.families([(None, m) for m in (agg.sum("x"), agg.var("x"), agg.covariance("x", "y"), agg.product("x"), agg.weighted_sum("x", "y"), agg.min("x"), agg.argmax("y", "x"))])
    flat = lambda v: [y for x in v for y in flat(x)] if isinstance(v, (tuple, list)) else [v]
    one, two = ({r["g"]: flat(tuple(r)[1:]) for r in aggregate.fold(df, ["g"], fams, unit).collect()} for df, unit in ((z, False), (expand(z), True)))
    assert one.keys() == two.keys() and all(same(x, y) or x == pytest.approx(y, rel=1e-9) for g in one for x, y in zip(one[g], two[g]))


def test_over_a_join(spark, db):
    events = table(spark, db("e"))
    events.create(rows_of(spark), pk="id")
    kinds = db.make("kinds", [("click", 2.0), ("view", 0.5), ("error", 1.0)], "kind string, price double", pk="kind")
    plan = source(events.name, p=1.0).alias("e").join(source(kinds.name, p=1.0).alias("c"), on="kind", how="left").mutate(cost="e.k * c.price").group_by("g").aggregate(total=agg.sum("cost"), n=agg.count())
    plan.merge_into(spark, db("out"))
    for change in (lambda: kinds.update("kind = 'click'", price="3.0"), lambda: (kinds.delete("kind = 'view'"), events.update("id % 3 = 0", kind="'error'")), lambda: events.delete("id % 2 = 0")):
        change()
        assert plan.merge_into(spark, db("out")).status == "incremental"
        want = spark.sql(f"SELECT g, sum(k * price), count(*) FROM {events.name} LEFT JOIN {kinds.name} USING (kind) GROUP BY g").collect()
        got = {r[0]: tuple(r)[1:] for r in current(spark, db("out")).collect()}
        assert got.keys() == {r[0] for r in want} and all(same(x, y) for r in want for x, y in zip(got[r[0]], tuple(r)[1:]))


def test_the_state_is_the_plans_and_commits_with_it(spark, db, monkeypatch):
    t = table(spark, db("e"))
    t.create(rows_of(spark), pk="id")
    one, two = (source(t.name, p=1.0).aggregate(by="g", v=m) for m in (agg.sum("x"), agg.sum("w")))
    one.merge_into(spark, db("out"))
    assert two.merge_into(spark, db("out")).status == "comprehensive"  # another metric's state is of no use
    t.delete("id % 2 = 0")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            two.merge_into(spark, db("out"))
    assert two.merge_into(spark, db("out")).status == "incremental"
    want = {r[0]: r[1] for r in spark.sql(f"SELECT g, sum(w) FROM {t.name} GROUP BY g").collect()}
    assert {r[0]: r[1] for r in current(spark, db("out")).collect()} == want
    with pytest.raises(ValueError, match="nothing"):
        source(t.name).aggregate(by="g", v=agg.sum("nothing")).merge_into(spark, db("bad"))
    assert aggregate.required_columns(("g",), [("a", agg.argmax("x", "id")), ("b", agg.sum("x"))]) == ["g", "x", "id"]
