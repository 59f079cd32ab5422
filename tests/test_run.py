"""Runs against a dictionary that goes through the same history, and the ladder of ways a step can be taken."""

import random

import pytest
from pyspark.sql import functions as F

from ivmspark import (
    WEIGHT, AppendConflict, CommitConflict, agg, apply_changes, apply_zset, as_zset, changes_at_tag, consolidate, current, delta_of, drop_log, heartbeat, pin_table, read_as_of, read_tag,
    read_watermarks, run, run_append, run_meta, source, table, table_changes, tagged_versions,
)
from ivmspark.sources.store import VersionedTable

DDL = "sku int, shelf string, stock int"


class Shop:
    """A table of stock and a dictionary that says what is in it."""

    def __init__(self, spark, db, name="stock", rows=24, seed=0):
        self.spark, self.name, self.rng = spark, db(name), random.Random(seed)
        self.rows = {i: (self.rng.choice("PQR"), self.rng.randrange(9)) for i in range(rows)}
        self.table = table(spark, self.name)
        self.table.create(self.frame(self.rows), pk="sku")

    def frame(self, rows):
        return self.spark.createDataFrame([(k, *v) for k, v in rows.items()], DDL)

    def add(self, *skus):
        new = {k: (self.rng.choice("PQR"), self.rng.randrange(9)) for k in skus}
        self.rows |= new
        self.table.insert(self.frame(new))

    def sell(self, modulus, rest):
        self.rows = {k: (s, n - 1) if k % modulus == rest else (s, n) for k, (s, n) in self.rows.items()}
        self.table.update(f"sku % {modulus} = {rest}", stock="stock - 1")

    def clear(self, sku):
        self.rows.pop(sku, None)
        self.table.delete(f"sku = {sku}")

    def low(self):
        """The rows that the plan of these tests asks for."""
        return {k: v for k, v in self.rows.items() if v[1] < 6}


def low(name, p=1.0):
    return source(name, p=p).alias("s").filter("s.stock < 6")


def held(spark, name):
    return {r[0]: tuple(r[1:]) for r in current(spark, name).select("sku", "shelf", "stock").collect()}


def net(spark, name, lo, hi):
    """(key, image) -> weight of an output's window."""
    return {(r[0], tuple(r)[1:3]): r[WEIGHT] for r in table(spark, name).changes(lo, hi).zset.select("sku", "shelf", "stock", WEIGHT).collect()}


def between(old, new):
    gone = {(k, v): -1 for k, v in old.items() if new.get(k) != v}
    return gone | {(k, v): 1 for k, v in new.items() if old.get(k) != v}


@pytest.mark.parametrize("seed", [3, 4])
def test_an_output_and_its_feed_follow_any_history(spark, db, seed):
    shop, out = Shop(spark, db, seed=seed), db("out")
    rng = random.Random(seed)
    assert low(shop.name).merge_into(spark, out, pk="sku").status == "bootstrap"
    fresh = 100
    for _ in range(4):
        before, version = shop.low(), table(spark, out).latest().version
        for _ in range(rng.randrange(0, 4)):
            what = rng.randrange(4)
            if what == 0:
                shop.add(fresh, fresh + 1)
                fresh += 2
            elif what == 1:
                shop.sell(rng.randrange(2, 6), 1)
            elif what == 2:
                shop.clear(rng.randrange(24))
            else:  # there and gone again before anyone looks
                shop.add(fresh)
                shop.clear(fresh)
                fresh += 1
        moved = shop.table.pin() != read_watermarks(spark, out)[shop.name]
        done = low(shop.name).merge_into(spark, out, pk="sku")
        assert done.status == ("incremental" if moved else "skipped") and held(spark, out) == shop.low()
        assert done.changed == (before != shop.low()) and done.pins[shop.name] == shop.table.pin()
        if moved:
            assert net(spark, out, version, version + 1) == between(before, shop.low())
        assert low(shop.name).merge_into(spark, out, pk="sku").status == "skipped"


SITUATIONS = {
    # what happens after the first run, the plan's share of changed rows, whether it may be followed, what the step is
    "nothing": (lambda s, o: None, 1.0, True, "skipped"),
    "some rows change": (lambda s, o: s.sell(5, 0), 1.0, True, "incremental"),
    "rows change that the output hasn't": (lambda s, o: (s.add(900), s.clear(900)), 1.0, True, "incremental"),
    "more rows change than the plan follows": (lambda s, o: s.sell(1, 0), 0.5, True, "comprehensive"),
    "as many change as it follows": (lambda s, o: s.sell(5, 0), 0.5, True, "incremental"),
    "it isn't to be followed": (lambda s, o: s.sell(5, 0), 1.0, False, "comprehensive"),
    "the window has expired": (lambda s, o: (s.sell(5, 0), s.sell(5, 1), s.table.vacuum(2)), 1.0, True, "comprehensive"),
    "the source is another table of that name": (lambda s, o: (s.table.drop(), s.rows.update({1: ("Z", 0)}), s.table.create(s.frame(s.rows), pk="sku")), 1.0, True, "comprehensive"),
    "others wrote rows to the output": (lambda s, o: (o.insert(s.frame({777: ("X", 1)})), s.sell(5, 0)), 1.0, True, "comprehensive"),
    "others left a note on the output": (lambda s, o: (o.commit(None, kind="note"), s.sell(5, 0)), 1.0, True, "incremental"),
    "others left a note and nothing is new": (lambda s, o: o.commit(None, kind="note"), 1.0, True, "skipped"),
}


@pytest.mark.parametrize("what", SITUATIONS)
def test_the_ladder(spark, db, what):
    happen, p, ivm, status = SITUATIONS[what]
    shop, out = Shop(spark, db), db("out")
    low(shop.name, p).merge_into(spark, out, pk="sku", ivm=ivm)
    before, o = held(spark, out), table(spark, out)
    happen(shop, o)
    done = low(shop.name, p).merge_into(spark, out, pk="sku", ivm=ivm)
    assert done.status == status and held(spark, out) == shop.low()
    if status != "skipped" and o.latest().version == 1:  # a recomputation shows what differs and no more
        assert net(spark, out, 0, 1) == between(before, shop.low())


def test_outputs_made_by_others_and_by_other_plans(spark, db):
    shop = Shop(spark, db)
    table(spark, db("theirs")).create(shop.frame({5: ("?", 0), 6000: ("?", 0)}), pk="sku")
    assert low(shop.name).merge_into(spark, db("theirs"), pk="sku").status == "comprehensive" and held(spark, db("theirs")) == shop.low()
    other = source(shop.name, p=1.0).alias("s").filter("s.stock > 2")
    assert other.merge_into(spark, db("theirs"), pk="sku").status == "comprehensive"
    assert held(spark, db("theirs")) == {k: v for k, v in shop.rows.items() if v[1] > 2}


def test_each_source_has_a_watermark_of_its_own(spark, db):
    one, two = Shop(spark, db, "one"), Shop(spark, db, "two", seed=9)
    plan = source(one.name, p=1.0).alias("a").join(source(two.name, p=1.0).alias("b"), on="sku").select("a.sku, a.stock, b.stock AS other")
    plan.merge_into(spark, db("out"), pk="sku")
    two.sell(2, 0)
    two.sell(3, 0)
    plan.merge_into(spark, db("out"), pk="sku")
    assert read_watermarks(spark, db("out")) == {one.name: one.table.pin(), two.name: two.table.pin()} and two.table.pin().version == 2
    assert read_watermarks(spark, db("nothing")) is None and read_watermarks(spark, one.name) is None


# ---- overlapping runs


def meanwhile(monkeypatch, what):
    """what happens once, between a writer's reading of its inputs and its publication."""
    put, todo = VersionedTable.write_stream, [what]

    def late(self, df, **how):
        out = put(self, df, **how)
        if todo:
            todo.pop()()
        return out

    monkeypatch.setattr(VersionedTable, "write_stream", late)


@pytest.mark.parametrize("kind", ["aggregate", "rows", "keyless", "first"])
def test_two_runs_at_once_come_out_as_if_in_turn(spark, db, monkeypatch, kind):
    shop = Shop(spark, db)
    if kind == "aggregate":
        plan = source(shop.name, p=1.0).aggregate(by="shelf", n=agg.count(), total=agg.sum("stock"), most=agg.max("stock"))
        step = lambda: plan.merge_into(spark, db("out"))
    elif kind == "keyless":
        plan = source(shop.name, p=1.0).alias("s").select("s.shelf, s.stock")
        step = lambda: plan.append_to(spark, db("out"))
    else:
        plan = low(shop.name)
        step = lambda: plan.merge_into(spark, db("out"), pk="sku")
    if kind != "first":
        step()
        shop.add(200, 201, 202)
    meanwhile(monkeypatch, step)
    assert step().status == "skipped"  # the other one had done it
    monkeypatch.undo()
    assert len([c for c in table(spark, db("out")).history() if c.kind in ("run", "append", "bootstrap")]) == 1 + (kind != "first")
    shop.add(203)
    assert step().status == "incremental"
    got = sorted(map(tuple, current(spark, db("out")).collect()))
    assert got == sorted(map(tuple, (plan.frame(spark) if kind != "aggregate" else spark.sql(f"SELECT shelf, count(*), sum(stock), max(stock) FROM {shop.name} GROUP BY shelf")).collect()))


def test_a_run_takes_in_what_came_while_it_was_at_work(spark, db, monkeypatch):
    shop = Shop(spark, db)
    step = lambda: low(shop.name).merge_into(spark, db("out"), pk="sku")
    step()
    shop.sell(2, 0)
    meanwhile(monkeypatch, lambda: (step(), shop.sell(2, 1)))
    assert step().status == "incremental" and held(spark, db("out")) == shop.low()


def test_a_change_that_keeps_losing_is_a_conflict(spark, db, monkeypatch):
    shop = Shop(spark, db)
    step = lambda: low(shop.name).merge_into(spark, db("out"), pk="sku")
    step()
    shop.sell(2, 0)
    put = VersionedTable.write_stream
    note = lambda: table(spark, db("out")).commit(None, kind="note")
    monkeypatch.setattr(VersionedTable, "write_stream", lambda self, df, **how: (put(self, df, **how), self.name == db("out") and note())[0])
    with pytest.raises(CommitConflict):
        step()
    monkeypatch.undo()
    assert step().status == "incremental" and held(spark, db("out")) == shop.low()


def test_low_level_writes_say_what_they_were_made_from(spark, db):
    shop = Shop(spark, db)
    low(shop.name).merge_into(spark, db("out"), pk="sku")
    head = table(spark, db("out")).head()
    pins = {shop.name: shop.table.pin()}
    heartbeat(spark, db("out"), run_meta("note", pins), expected=head)
    for late in (lambda: heartbeat(spark, db("out"), run_meta("note", pins), expected=head), lambda: apply_zset(spark, db("out"), as_zset(shop.frame({9: ("P", 1)})), run_meta("x", pins), expected=head)):
        with pytest.raises(CommitConflict):
            late()
    assert not table(spark, db("out")).latest().streams and held(spark, db("out")) == shop.low()


def test_a_run_needs_sources_and_reads_only_those(spark, db):
    with pytest.raises(ValueError):
        run(spark, db("out"), sources=[], pk="sku", full=None)
    shop = Shop(spark, db)
    with pytest.raises(ValueError, match="not a source"):
        run(spark, db("out"), sources=[shop.name], pk="sku", full=lambda ctx: ctx.new(db("other")))
    with pytest.raises(ValueError, match="earlier run"):
        run(spark, db("out"), sources=[shop.name], pk="sku", full=lambda ctx: ctx.old(shop.name))


# ---- append-only outputs


def images(spark, name):
    return sorted(map(tuple, current(spark, name).select("sku", "shelf", "stock").collect()))


def test_a_log_gains_and_never_loses(spark, db):
    shop, log = Shop(spark, db), db("log")
    step = lambda **how: low(shop.name).append_to(spark, log, pk="sku", **how)
    assert step().status == "bootstrap" and step().status == "skipped"
    shop.add(300, 301, 302, 303, 304, 305)
    assert step().changed and images(spark, log) == sorted((k, *v) for k, v in shop.low().items())
    first = {k: v for k, v in shop.low().items()}
    logged = sorted((k, *v) for k, v in first.items())
    version = table(spark, log).latest().version
    shop.sell(4, 0)  # images of keys that are there, and rows that the plan now takes in
    gone = next(k for k in first if k % 4)
    shop.clear(gone)
    with pytest.raises(AppendConflict):
        step()
    assert table(spark, log).latest().version == version and drop_log(spark, log) is None
    step(fail_on_conflict=False)
    new = {k: v for k, v in shop.low().items() if k not in first}
    assert images(spark, log) == sorted([*logged, *((k, *v) for k, v in new.items())])
    refused = {(r["sku"], r["shelf"], r["stock"]): r[WEIGHT] for r in drop_log(spark, log).collect()}
    assert refused == {(k, *v): w for (k, v), w in between(first, {k: v for k, v in shop.low().items() if k in first}).items()}
    shop.sell(4, 1)
    step(fail_on_conflict=False, log_drops=False)
    assert drop_log(spark, log).count() == len(refused)


def test_a_log_recomputed_takes_only_what_is_new(spark, db):
    shop, log = Shop(spark, db), db("log")
    low(shop.name).append_to(spark, log, pk="sku")
    before = shop.low()
    shop.add(400, 401, 402)
    assert low(shop.name).append_to(spark, log, pk="sku", ivm=False).status == "comprehensive"
    assert net(spark, log, 0, 1) == between(before, shop.low())


def test_logs_and_keys(spark, db):
    db.make("twice", [(1, "x"), (1, "y"), (2, "z")])
    with pytest.raises(AppendConflict):  # whatever may be dropped: which image is the key's can't be told
        source(db("twice")).append_to(spark, db("log"), pk="id", fail_on_conflict=False)
    plan = source(db("twice"), p=1.0)
    plan.append_to(spark, db("bag"))
    db.insert("twice", [(1, "x"), (3, "w")])
    plan.append_to(spark, db("bag"))
    assert db.rows("bag") == [(1, "x"), (1, "x"), (1, "y"), (2, "z"), (3, "w")]
    db.insert("twice", [(4, "v")])
    with pytest.raises(ValueError, match="pk"):
        plan.append_to(spark, db("bag"), ivm=False)
    full = lambda ctx: ctx.new(db("twice")).where("id > 1")
    assert run_append(spark, db("own"), sources=[db("twice")], pk="id", full=full).status == "bootstrap" and len(db.rows("own")) == 3


# ---- windows and bridges


def test_windows_by_hand_add_up(spark, db):
    shop = Shop(spark, db)
    pins, states = [pin_table(spark, shop.name)], [dict(shop.rows)]
    for change in (lambda: shop.sell(3, 0), lambda: shop.add(500), lambda: shop.clear(4)):
        change()
        pins.append(pin_table(spark, shop.name))
        states.append(dict(shop.rows))
    for i, old in enumerate(states):
        assert {r[0]: tuple(r)[1:] for r in read_as_of(spark, shop.name, pins[i].version).collect()} == old
        for j in range(i, len(states)):
            found = delta_of(spark, shop.name, pins[j], pins[i])
            assert {(r[0], tuple(r)[1:3]): r[WEIGHT] for r in found.zset.collect()} == between(old, states[j])
    assert delta_of(spark, shop.name, pins[-1], None).is_full and delta_of(spark, shop.name, pins[1], pins[0], p=0.1).is_full
    change, pin = table_changes(spark, shop.name, pins[1])
    assert pin == pins[-1] and not change.is_full and table_changes(spark, shop.name, pin)[0].is_empty()
    assert {r[0] for r in change.upserts.collect()} == {500} and {r[0] for r in change.deletes.collect()} == {4}


def test_windows_by_tag(spark, db):
    shop, out = Shop(spark, db), db("out")
    states = [shop.low()]
    low(shop.name).merge_into(spark, out, pk="sku", tag="monday")
    for tag, change in (("tuesday", lambda: shop.sell(2, 0)), ("monday", lambda: shop.sell(2, 1))):
        change()
        low(shop.name).merge_into(spark, out, pk="sku", tag=tag)
        states.append(shop.low())
    got = {(r[0], tuple(r)[1:3]): r[WEIGHT] for r in changes_at_tag(spark, out, "tuesday").zset.collect()}
    assert got == between(states[0], states[1]) and read_tag(spark, out) == "monday" and tagged_versions(spark, out, "monday") == [0, 2]
    assert changes_at_tag(spark, out, "sunday").is_empty() and tagged_versions(spark, db("nothing"), "monday") == []


def test_foreign_changes_land_as_differences(spark, db):
    shop, name = Shop(spark, db), db("landed")
    rows = dict(shop.rows)
    assert apply_changes(spark, name, shop.frame(rows), "sku", tag="a") and held(spark, name) == rows
    # signed rows; one retraction's image is off, and the key's row goes all the same
    signed = shop.frame({2: ("?", -5)}).withColumn(WEIGHT, F.lit(-1).cast("long")).unionByName(as_zset(shop.frame({2: ("N", 3), 600: ("N", 1)})))
    assert apply_changes(spark, name, signed, "sku", tag="b") and not apply_changes(spark, name, signed, "sku", tag="b")
    old, rows = rows, rows | {2: ("N", 3), 600: ("N", 1)}
    assert held(spark, name) == rows and net(spark, name, 0, 1) == between(old, rows)
    assert apply_changes(spark, name, shop.frame(shop.rows), "sku", tag="c", full=True) and net(spark, name, 1, 2) == between(rows, shop.rows)
    assert not apply_changes(spark, name, shop.frame(shop.rows), "sku", tag="d", full=True)
    assert tagged_versions(spark, name, "b") == [1] and read_tag(spark, name) == "d"
    with pytest.raises(ValueError, match="key"):
        apply_changes(spark, db("bad"), shop.frame({1: ("A", 1)}).union(shop.frame({1: ("B", 1)})), "sku")
    assert consolidate(as_zset(current(spark, name))).count() == len(shop.rows)


def test_pairs_of_a_common_key_are_dealt_out(spark, db, monkeypatch):
    """A join of a key that both sides have many rows of: its pairs are in several tasks, none is left out or
    met twice, and the change is followed; a source that has two rows of its key is still found."""
    from ivmspark.operators import joins
    from ivmspark.plans.builder import Compiler
    from ivmspark.plans.run import as_source, begin
    from ivmspark.sources import store

    for module in (joins, store):
        monkeypatch.setattr(module, "PART_ROWS", 400)
    t = db.make("s", [(i, None if i % 40 == 3 else i % 40 // 30, f"v{i}") for i in range(120)], "id int, k int, v string", pk="id")
    plan = source(db("s"), p=1.0).alias("a").join(source(db("s"), p=1.0).alias("b"), on="k").filter("a.id < b.id").select("a.id AS a, b.id AS b, a.k AS k, b.v")
    monkeypatch.setattr(store, "SMALL", 0)

    def same():
        status = plan.merge_into(spark, db("out"), pk=("a", "b")).status
        rows = sorted((r for r in table(spark, db("s")).snapshot().collect()))
        assert db.rows("out", "a", "b", "k", "v") == sorted(((x["id"], y["id"], x["k"], y["v"]) for x in rows for y in rows if x["k"] is not None and x["k"] == y["k"] and x["id"] < y["id"]), key=str)
        return status

    assert same() == "bootstrap"
    c = Compiler(plan, begin(spark, db("new"), [as_source(db("s"))], 1.0, None, None).ctx)
    sizes = [r[1] for r in c.current().groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2 and c.unique(spark, ("a", "b"))
    t.update("id % 7 = 1", k="1 - k")
    t.delete("id % 11 = 5")
    db.insert("s", [(i, 1, "new") for i in range(200, 220)])
    assert same() == "incremental"
    db.insert("s", [(200, 1, "again")])
    with pytest.raises(ValueError, match="several rows"):
        plan.merge_into(spark, db("other"), pk=("a", "b"))
