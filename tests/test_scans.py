import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ivmspark import acc, agg, current, source, table

EVENTS = [(1, "g1", 1, 10.0), (2, "g1", 2, 20.0), (3, "g2", 1, 5.0)]


def events(db, rows=EVENTS):
    return db.make("e", rows, "event_id int, grp string, t int, x double", pk="event_id")


def fresh(spark, db, plan, pk):
    """Step, then compare with an output made anew. The status."""
    r = plan.merge_into(spark, db("out"), pk=pk)
    name = f"fresh{table(spark, db('out')).latest().version}"
    plan.merge_into(spark, db(name), pk=pk)
    assert db.rows("out") == db.rows(name)
    return r.status


def every():
    return {
        "s": acc.sum("x"), "n": acc.count(), "lo": acc.min("x"), "hi": acc.max("x"), "f": acc.first("x"), "p": acc.product("x"), "e": acc.ema("x", 0.5),
        "te": acc.tema("x", 0.1), "b": acc.prev("x"), "l3": acc.lag("x", 3), "c": acc.convolution("x", [1, 2, 3]), "z": acc.convolution("x", [2]),
        "own": acc.scan(lambda s, r: ([*s, r["event_id"]], float(len(s))), []),
    }


def test_tail_resume_past_edit_and_delete(spark, db):
    t = events(db)
    plan = source(db("e"), p=1.0).along("t").accumulate(by="grp", **every())
    fresh(spark, db, plan, "event_id")
    db.insert("e", [(4, "g1", 3, 1.0), (5, "g2", 9, None), (6, "g3", 1, 2.0), (7, "g1", 4, 7.0), (8, None, 1, 1.0)])
    assert fresh(spark, db, plan, "event_id") == "incremental"
    assert db.feed("out", "event_id") == [4, 5, 6, 7, 8]
    t.update("event_id = 2", x="21.0")
    assert fresh(spark, db, plan, "event_id") == "incremental"
    assert db.feed("out", "event_id") == [2, 4, 7]
    t.delete("event_id = 1")
    assert fresh(spark, db, plan, "event_id") == "incremental"
    db.insert("e", [(9, None, 2, 3.0), (10, "g2", 10, 4.0)])
    assert fresh(spark, db, plan, "event_id") == "incremental" and db.feed("out", "event_id") == [9, 10]
    t.delete("grp = 'g2'")
    assert fresh(spark, db, plan, "event_id") == "incremental"
    db.insert("e", [(11, "g2", 1, 8.0)])
    assert fresh(spark, db, plan, "event_id") == "incremental"


def test_values(spark, db):
    events(db, [(1, "s", 1, None), (2, "s", 2, 10.0), (3, "s", 4, 20.0), (4, "s", 5, None)])
    plan = source(db("e")).along("t").accumulate(by="grp", **every())
    plan.merge_into(spark, db("out"), pk="event_id")
    rows = current(spark, db("out")).orderBy("t").collect()
    assert [r["s"] for r in rows] == [0.0, 10.0, 30.0, 30.0] and [r["f"] for r in rows] == [None, 10.0, 10.0, 10.0]
    assert [r["p"] for r in rows] == [None, 10.0, 200.0, 200.0] and [r["e"] for r in rows] == [None, 10.0, 15.0, 15.0]
    a = 1 - 2.718281828459045 ** (-0.1 * 2)
    assert [r["te"] for r in rows] == [None, 10.0, pytest.approx(a * 20 + (1 - a) * 10), pytest.approx(a * 20 + (1 - a) * 10)]
    assert [r["l3"] for r in rows] == [None, None, None, None] and [r["b"] for r in rows] == [None, None, 10.0, 20.0]
    assert [r["c"] for r in rows] == [None, None, 0 * 1 + 10 * 2 + 20 * 3, 10 + 40 + 0] and [r["z"] for r in rows] == [0.0, 20.0, 40.0, 0.0]
    assert [r["own"] for r in rows] == [0.0, 1.0, 2.0, 3.0]


def test_carried_places_of_lags_across_many_runs(spark, db):
    events(db, [(1, "a", 1, 1.0)])
    plan = source(db("e"), p=1.0).along("t").accumulate(by="grp", l=acc.lag("x", 4), c=acc.convolution("x", [1, 10, 100, 1000]), s=acc.sum("event_id"))
    plan.merge_into(spark, db("out"), pk="event_id")
    for k in range(2, 9):
        db.insert("e", [(k, "a", k, float(k) if k != 5 else None)])
        assert plan.merge_into(spark, db("out"), pk="event_id").status == "incremental" and db.feed("out", "event_id") == [k]
    plan.merge_into(spark, db("again"), pk="event_id")
    assert db.rows("out") == db.rows("again")


def test_each_group_has_an_init_of_its_own(spark, db):
    events(db, [(i, f"g{i % 4}", i, 1.0) for i in range(20)])

    def step(state, row):
        state.append(row["x"])
        return state, float(len(state))

    source(db("e")).along("t").accumulate(by="grp", n=acc.scan(step, [])).merge_into(spark, db("out"), pk="event_id")
    assert max(r[-1] for r in db.rows("out")) == 5.0


def test_ungrouped(spark, db):
    t = events(db)
    plan = source(db("e"), p=1.0).along("event_id").accumulate(s=acc.sum("x"), n=acc.count())
    fresh(spark, db, plan, "event_id")
    db.insert("e", [(4, "g9", 1, 1.0)])
    assert fresh(spark, db, plan, "event_id") == "incremental" and db.feed("out", "event_id") == [4]
    t.delete("event_id = 2")
    assert fresh(spark, db, plan, "event_id") == "incremental" and db.feed("out", "event_id") == [2, 3, 4]


def test_null_in_the_order_column(spark, db):
    events(db, [(1, "a", 1, 1.0), (2, "a", None, 2.0)])
    plan = source(db("e"), p=1.0).along("t").accumulate(by="grp", s=acc.sum("x"), n=acc.count())
    fresh(spark, db, plan, "event_id")
    db.insert("e", [(3, "a", 5, 4.0)])
    assert fresh(spark, db, plan, "event_id") == "incremental"
    assert db.rows("out", "event_id", "n") == [(1, 1), (2, 3), (3, 2)]


def test_values_of_other_types(spark, db):
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, day, Decimal("1.50"), [1], "x"), (2, day + datetime.timedelta(1), Decimal("2.25"), [2, 3], None)]
    db.make("t", rows, "id int, at timestamp_ntz, d decimal(8,2), a array<int>, s string", pk="id")
    own = acc.scan(lambda s, r: ([r["at"], r["d"]], float(r["d"])), [])
    plan = source(db("t"), p=1.0).along("at").accumulate(total=acc.sum("d"), b=acc.prev("a"), hi=acc.max("at"), f=acc.first("s"), lo=acc.min("d"), own=own)
    fresh(spark, db, plan, "id")
    db.insert("t", [(3, day + datetime.timedelta(2), Decimal("4.00"), None, "z")])
    assert fresh(spark, db, plan, "id") == "incremental"
    row = db.rows("out", "id", "total", "b", "hi", "f", "lo")[-1]
    assert row == (3, Decimal("7.75"), [2, 3], day + datetime.timedelta(2), "x", Decimal("1.50"))


def test_reduce_tail_past_emptied_and_skipped(spark, db):
    t = events(db)
    plan = source(db("e"), p=1.0).along("t").aggregate(by="grp", trail=agg.reduce(lambda s, r: (s + str(r["event_id"]), s + str(r["event_id"])), "", dtype="string"))
    plan.merge_into(spark, db("out"))
    assert db.rows("out") == [("g1", "12"), ("g2", "3")]
    db.insert("e", [(4, "g1", 3, 1.0)])
    assert plan.merge_into(spark, db("out")).status == "incremental" and db.rows("out") == [("g1", "124"), ("g2", "3")] and db.feed("out", "grp") == ["g1"]
    t.delete("event_id = 1 OR grp = 'g2'")
    assert plan.merge_into(spark, db("out")).status == "incremental" and db.rows("out") == [("g1", "24")]
    assert plan.merge_into(spark, db("out")).status == "skipped"


def test_names_and_columns(spark, db):
    events(db)
    with pytest.raises(ValueError, match="nothing"):
        source(db("e")).along("nothing").accumulate(n=acc.count()).merge_into(spark, db("out"), pk="event_id")
    with pytest.raises(ValueError, match="named"):
        source(db("e")).along("t").accumulate(x=acc.count()).merge_into(spark, db("out"), pk="event_id")


def test_ungrouped_in_parts(spark, db):
    """Every metric that needs no fold, over parts scanned side by side: as in one group, run after run, whose rows
    no task holds all of."""
    kinds = {"n": acc.count(), "s": acc.sum("x"), "lo": acc.min("x"), "hi": acc.max("x"), "f": acc.first("x"), "p": acc.product("x"), "l": acc.lag("x", 3), "c": acc.convolution("x", [1, 10, 100])}
    row = lambda i: (i, "g", None if i % 50 == 7 else (i * 37) % 90, None if i < 3 or i % 11 == 0 else 1 + i % 5 / 1000)
    t = events(db, [row(i) for i in range(1, 400)])
    one, parts = (source(db("e"), p=1.0).along("t").accumulate(by=by, **kinds) for by in ("grp", None))

    def same():
        done = [plan.merge_into(spark, db(out), pk="event_id").status for plan, out in ((one, "one"), (parts, "parts"))]
        a, b = ([[round(v, 9) if isinstance(v, float) else v for v in r] for r in db.rows(out)] for out in ("one", "parts"))
        assert a == b and len(b) > 100
        return done

    same()
    db.insert("e", [row(i) for i in range(400, 500)])
    assert same() == ["incremental"] * 2
    t.delete("event_id % 9 = 4 OR t IS NULL")
    assert same() == ["incremental"] * 2
    db.insert("e", [(i, "g", i, i / 1000 % 1) for i in range(500, 700)])
    assert same() == ["incremental"] * 2

    from ivmspark.operators import scans
    from ivmspark.plans.builder import Compiler, live_context

    full, _ = scans.closures(db("other"), (), tuple(kinds.items()), "t", ("event_id",), lambda ctx: Compiler(parts, ctx))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[1] for r in full(live_context(parts, spark)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < sum(sizes)
