import pytest
from pyspark.sql import functions as F

from ivmspark import WEIGHT, CommitConflict, Pin, as_zset, consolidate, diff, rewind, table
from ivmspark.operators.zset import by_bits, check_names, expand, present
from ivmspark.sources import log, store
from ivmspark.sources.store import VersionedTable


def test_zset_algebra(spark):
    z = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 1), (2, "b", -1), (None, None, -2)], f"id int, v string, {WEIGHT} long")
    assert sorted(map(tuple, consolidate(z).collect()), key=str) == [(1, "a", 2), (None, None, -2)]
    assert [tuple(r) for r in present(z).collect()] == [(1, "a"), (1, "a")]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([("x", 1), ("z", 2)], "v string, id int")
    assert sorted(map(tuple, diff(a, b).collect())) == [(2, "y", 1), (2, "z", -1)]
    assert sorted(map(tuple, rewind(a, diff(a, b)).collect())) == [(1, "x"), (2, "z")]
    with pytest.raises(ValueError):
        diff(a, b.drop("v"))
    with pytest.raises(ValueError):
        check_names(["__ivm_x"], "here")


def test_weights_of_any_size(spark):
    z = spark.createDataFrame([(1, 1), (2, -1), (3, 5000), (4, -9001), (5, 3)], f"id int, {WEIGHT} long")
    got = {(r["id"], r[WEIGHT]): r["count"] for r in expand(z).groupBy("id", WEIGHT).count().collect()}
    assert got == {(1, 1): 1, (2, -1): 1, (3, 1): 5000, (4, -1): 9001, (5, 1): 3}
    big = spark.createDataFrame([(1, 2**62 + 5), (2, -3_000_000_000), (3, -1)], f"id int, {WEIGHT} long")
    bits = by_bits(big, "p").collect()
    assert len(bits) == 3 + (3_000_000_000).bit_count() + 1
    assert {i: sum(r["p"] * r[WEIGHT] for r in bits if r["id"] == i) for i in (1, 2, 3)} == {1: 2**62 + 5, 2: -3_000_000_000, 3: -1}


def test_zset_types(spark):
    df = spark.sql("SELECT map('a', 1) AS m, array(1.5D, double('nan')) AS a, named_struct('x', 0.0D) AS s UNION ALL SELECT map('a', 1), array(1.5D, double('nan')), named_struct('x', -0.0D)")
    assert [r[WEIGHT] for r in consolidate(as_zset(df)).collect()] == [2]
    with pytest.raises(ValueError, match="variant"):
        consolidate(as_zset(spark.sql("SELECT parse_json('1') AS v")))


def test_versions_changes_and_time_travel(spark, db):
    t = db.make("a", [(1, "a"), (2, "b"), (3, "c")], pk="id")
    t.insert(spark.createDataFrame([(4, "d")], "id int, v string"))
    t.update("id = 2", v="'B'")
    t.delete("id = 3")
    assert db.rows("a") == [(1, "a"), (2, "B"), (4, "d")]
    assert sorted(map(tuple, t.snapshot(0).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, t.snapshot(2).collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    change = t.changes(0, 3)
    assert sorted(map(tuple, change.zset.collect())) == [(2, "B", 1), (2, "b", -1), (3, "c", -1), (4, "d", 1)]
    assert t.rows() == 3 and t.rows(0) == 3 and t.changes(3, 3).rows == 0
    assert isinstance(t.pin(), Pin)


def test_rows_of_weight_two_without_a_key(spark, db):
    t = db.make("a", [(1, "a"), (1, "a")])
    t.insert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    t.merge(spark.createDataFrame([(1, "a", -2)], f"id int, v string, {WEIGHT} long"))
    assert db.rows("a") == [(1, "a"), (2, "b")]


def test_a_key_of_two_rows_is_refused(spark, db):
    t = db.make("a", [(1, "a")], pk="id")
    with pytest.raises(ValueError, match="key"):
        t.insert(spark.createDataFrame([(2, "x"), (2, "y")], "id int, v string"))
    with pytest.raises(ValueError, match="key"):
        db.make("b", [(1, "a"), (1, "b")], pk="id")
    assert t.latest().version == 0


def test_null_keys(spark, db):
    t = db.make("a", [(None, "n"), (1, "a")], pk="id")
    t.update("id IS NULL", v="'m'")
    t.insert(spark.createDataFrame([(2, "z")], "id int, v string"))
    assert db.rows("a") == [(1, "a"), (2, "z"), (None, "m")]


def folders(t):
    return set(log.names(t.spark, f"{t.path}/data"))


def test_upkeep_makes_no_version_and_no_change(spark, db):
    n = 3000
    t = table(spark, db("a"))
    t.create(spark.range(n).selectExpr("id", "'x' AS v"), pk="id")
    for i in range(20):
        t.update(f"id = {i}", v="'y'")
    marks = [x for x in log.names(spark, f"{t.path}/_log") if x.startswith(("run-", "base-"))]
    assert any(x.startswith("run-") for x in marks) and not any(x.startswith("base-") for x in marks)  # merged, the base left alone
    assert t.latest().version == 20 and len(t.latest().tip[""]["segments"]) < 12
    assert t.snapshot().where("v = 'y'").count() == 20 and t.rows() == n
    assert t.snapshot(7).where("v = 'y'").count() == 7 and t.changes(10, 14).zset.count() == 8
    for k in range(3):
        t.update(f"id % 3 = {k}", v="'z'")
    assert any(x.startswith("base-") for x in log.names(spark, f"{t.path}/_log"))
    assert t.snapshot().groupBy("v").count().collect()[0][1] == n and t.changes(20, 23).zset.count() == 2 * n


def test_vacuum_gives_up_the_past_and_its_files(spark, db):
    t = db.make("a", [(i, "x") for i in range(20)], pk="id")
    for i in range(14):
        t.update(f"id = {i}", v="'y'")
    before, want = folders(t), db.rows("a")
    orphan = f"{t.path}/data/seg-lost"
    spark.range(1).write.parquet(orphan)
    t.vacuum(12)
    assert "seg-lost" in folders(t) and len(folders(t)) < len(before)  # it may be of a writer that is still at work
    assert t.changes(10, 14) is None and t.changes(12, 14).zset.count() == 4 and db.rows("a") == want
    with pytest.raises(ValueError, match="retained"):
        t.snapshot(3)
    t.vacuum(t.head(), orphans_after=0)
    live = t._live(t.head(), "")
    assert folders(t) == {x.rsplit("/", 1)[1] for x in (live["base"], *(s["path"] for s in live["segments"]))}
    t.insert(spark.createDataFrame([(99, "n")], "id int, v string"))
    assert db.rows("a") == sorted([*want, (99, "n")], key=str) and len(t.history()) == 2


def test_one_commit_tells_a_new_reader_everything(spark, db, monkeypatch):
    t = db.make("a", [(i, "x") for i in range(20)], pk="id")
    for i in range(11):
        t.update(f"id = {i}", v="'y'")
    store._COMMITS.clear()
    read, load = [], VersionedTable._load
    monkeypatch.setattr(VersionedTable, "_load", lambda self, v: (read.append(v), load(self, v))[1])
    assert table(spark, db("a")).snapshot().where("v = 'y'").count() == 11 and read == [11]


def test_a_change_computed_from_an_older_version_is_refused(spark, db):
    t = db.make("a", [(1, "a"), (2, "b")], pk="id")
    head, now = t.head(), t.snapshot()
    change = diff(now.withColumn("v", F.lit("mine")), now)
    table(spark, db("a")).update("id = 1", v="'theirs'")
    before = folders(t)
    with pytest.raises(CommitConflict):
        t.commit(change, expected=head)
    assert db.rows("a") == [(1, "theirs"), (2, "b")] and folders(t) == before  # nothing is left behind


def test_updates_start_over_and_inserts_follow(spark, db, monkeypatch):
    """Another writer comes between a change's reading and its publication."""
    t = db.make("a", [(1, 0), (2, 0)], "id int, n int", pk="id")
    put = VersionedTable.write_stream

    def late(self, df, **how):
        out = put(self, df, **how)
        if others:
            others.pop()(table(spark, db("a")))
        return out

    monkeypatch.setattr(VersionedTable, "write_stream", late)
    others = [lambda o: o.update("id = 1", n="n + 10")]
    t.update("id = 1", n="n + 1")
    others = [lambda o: o.delete("id = 2")]
    t.insert(spark.createDataFrame([(3, 3)], "id int, n int"))
    assert db.rows("a") == [(1, 11), (3, 3)] and t.rows() == 2


def test_creating_twice(spark, db):
    db.make("a", [(1, "a")])
    with pytest.raises(CommitConflict):
        db.make("a", [(2, "b")])


def test_outputs_are_tables_of_sql(spark, db):
    t = db.make("a", [(1, "a"), (2, "b"), (None, "n")], pk="id")
    name = db("a")
    assert spark.table(name).count() == 3 and spark.sql(f"SELECT v FROM {name} WHERE id = 2").first()[0] == "b"
    t.update("id IS NULL", v="'m'")
    t.delete("id = 1")
    t.insert(spark.createDataFrame([(7, "g")], "id int, v string"))
    assert sorted(map(tuple, spark.table(name).collect()), key=str) == db.rows("a") == [(2, "b"), (7, "g"), (None, "m")]
    t.compact()
    t.vacuum(t.head(), orphans_after=0)
    assert sorted(map(tuple, spark.table(name).collect()), key=str) == db.rows("a")
    bag = db.make("bag", [(1, "a"), (1, "a")])
    bag.insert(spark.createDataFrame([(1, "a")], "id int, v string"))
    bag.merge(spark.createDataFrame([(1, "a", -1)], f"id int, v string, {WEIGHT} long"))
    assert sorted(map(tuple, spark.table(db("bag")).collect())) == [(1, "a"), (1, "a")]
    assert "a" in [x.name for x in spark.catalog.listTables(db.name)]
    t.drop()
    assert "a" not in [x.name for x in spark.catalog.listTables(db.name)]


def test_a_name_that_is_taken_in_sql(spark, db):
    """A commit stands, and the table of that name too."""
    spark.sql(f"CREATE DATABASE {db.name}")
    spark.range(3).write.saveAsTable(db("a"))
    with pytest.warns(UserWarning, match="not shown"):
        t = db.make("a", [(1, "a")], pk="id")
    assert db.rows("a") == [(1, "a")] and spark.table(db("a")).count() == 3
    with pytest.warns(UserWarning, match="stays"):
        t.drop()
    assert spark.table(db("a")).count() == 3 and not t.exists()


def test_a_crash_before_publishing_leaves_nothing(spark, db, monkeypatch):
    t = db.make("a", [(1, "a")], pk="id")
    monkeypatch.setattr(t, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.insert(spark.createDataFrame([(2, "b")], "id int, v string"))
    assert db.rows("a") == [(1, "a")]


def test_adopted_files_stay_where_they_are(spark, db, tmp_path):
    spark.range(5).withColumn("v", F.lit("x")).write.parquet(str(tmp_path / "p"))
    t = table(spark, db("a"))
    t.adopt(str(tmp_path / "p"), pk="id")
    t.delete("id = 4")
    assert len(db.rows("a")) == 4 and spark.read.parquet(str(tmp_path / "p")).count() == 5


def test_schema_is_fixed(spark, db):
    t = db.make("a", [(1, "a")], pk="id")
    with pytest.raises(ValueError, match="columns"):
        t.merge(as_zset(spark.createDataFrame([(2,)], "id int")))


def test_read_as_of_version_loads_all_orders(spark, monkeypatch):
    from ivmspark import queries

    loaded, kind = [], type(table(spark, "x.y"))
    for name in ("create", "insert"):
        put = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, df, *a, put=put, **b: (loaded.append(df.count()), put(self, df, *a, **b))[1])
    folder = "/root/testdata/sf0.001"
    got = queries.read_as_of_version(spark, folder)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert sum(loaded) == orders.count() and got.count() == orders.where("o_orderkey % 7 < 5").count()
