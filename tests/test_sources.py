import json
import random

import pytest
from pyspark.sql import functions as F

from ivmspark import WEIGHT, ChangelogLayout, ChangelogSource, acc, agg, changelog_source, changes_at_tag, current, source, table
from ivmspark.sources import log
from ivmspark.sources.change import spark_uri
from ivmspark.streaming.driver import follow
from ivmspark.streaming.feed import ChangeFeed

LAY = ChangelogLayout()


class Producer:
    """A foreign engine's folder."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.entries = spark, str(folder), {}

    def part(self, path, rows, ddl, **more):
        df = self.spark.createDataFrame(rows, ddl)
        for k, v in more.items():
            df = df.withColumn({"f": LAY.epoch}.get(k, k), F.lit(v))
        df.coalesce(1).write.mode("append").parquet(f"{self.folder}/{path}")

    def say(self, name, **entry):
        self.entries[name] = self.entries.get(name, {}) | entry
        path = f"{self.folder}/{LAY.sidecar}"
        log.remove(self.spark, path)
        log.publish(self.spark, path, json.dumps(self.entries))


def test_changelog_round_trip(spark, db, tmp_path):
    maker = Producer(spark, tmp_path)
    signed = f"order_id int, product_id string, qty int, {LAY.weight} int"
    maker.part("orders__base", [(1, "A", 2), (2, "B", 1)], "order_id int, product_id string, qty int")
    maker.part("orders__changelog", [(3, "A", 4, 1)], signed, f="f1")
    maker.say("orders", mode="merge", pk="order_id", floor="f0", f="f1", f_base="f0")
    maker.part("catalog.parquet", [("A", 10.0), ("B", 3.0)], "product_id string, price double")
    maker.say("catalog", mode="overwrite", pk="product_id", floor=None, f="f1")
    plan = changelog_source(str(tmp_path), "orders", p=1.0).alias("o").join(changelog_source(str(tmp_path), "catalog", p=1.0).alias("c"), on="product_id").mutate(amount="o.qty * c.price")
    plan.merge_into(spark, db("out"), pk="order_id", tag="f1")
    assert db.rows("out", "order_id", "amount") == [(1, 20.0), (2, 3.0), (3, 40.0)]
    assert plan.merge_into(spark, db("out"), pk="order_id", tag="f1").status == "skipped"
    maker.part("orders__changelog", [(1, "A", 2, -1), (1, "A", 5, 1), (2, "B", 1, -1)], signed, f="f2")
    maker.say("orders", f="f2")
    assert plan.merge_into(spark, db("out"), pk="order_id", tag="f2").status == "incremental"
    assert db.rows("out", "order_id", "amount") == [(1, 50.0), (3, 40.0)]
    assert sorted(r["order_id"] for r in changes_at_tag(spark, db("out"), "f2").zset.collect()) == [1, 1, 2]
    maker.say("orders", f="f3", floor="f3")  # refreshed: the window is gone
    assert plan.merge_into(spark, db("out"), pk="order_id").status == "comprehensive"


def test_changelog_append_mode_and_fraction(spark, db, tmp_path):
    maker = Producer(spark, tmp_path)
    maker.part("items", [(i, "a") for i in range(10)], "item_id int, v string", f="f1")
    maker.say("items", mode="append", pk="item_id", floor="f1", f="f1")
    plan = changelog_source(str(tmp_path), "items")
    plan.merge_into(spark, db("out"), pk="item_id")
    maker.part("items", [(50, "b")], "item_id int, v string", f="f2")
    maker.say("items", f="f2")
    assert plan.merge_into(spark, db("out"), pk="item_id").status == "incremental" and db.feed("out", "item_id") == [50]
    maker.part("items", [(100 + i, "c") for i in range(20)], "item_id int, v string", f="f3")
    maker.say("items", f="f3")
    assert plan.merge_into(spark, db("out"), pk="item_id").status == "comprehensive"


def test_changelog_names(spark, tmp_path):
    assert spark_uri("s3://b/x/?v=1") == "s3a://b/x" and spark_uri("/a/b/") == "/a/b" and spark_uri("file:///a/b/") == "file:///a/b"
    assert ChangelogSource("s3://b/x/", "t").ref == "changelog:s3a://b/x::t"
    with pytest.raises(ValueError, match="nothing"):
        ChangelogSource(str(tmp_path), "t").pin(spark)


def test_stream_batches_land_once_and_step_plans(spark, db, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, g string, x double").coalesce(1).write.parquet(src)
    plan = source(db("t"), p=1.0).aggregate(by="g", n=agg.count(), s=agg.sum("x"))
    steps = [lambda s: plan.merge_into(s, db("out"))]

    def go():
        frame = spark.readStream.schema("id int, g string, x double").parquet(src)
        follow(frame, db("t"), stream="s", checkpoint=str(tmp_path / "c"), pk="id", steps=steps).awaitTermination()

    go()
    assert db.rows("out") == [("a", 1, 1.0), ("b", 1, 2.0)]
    spark.createDataFrame([(2, "a", 5.0), (3, "c", 3.0)], "id int, g string, x double").coalesce(1).write.mode("append").parquet(src)
    go()
    assert db.rows("out") == [("a", 2, 6.0), ("c", 1, 3.0)]
    versions = table(spark, db("t")).latest().version
    go()
    assert table(spark, db("t")).latest().version == versions


def test_change_feed_as_a_data_source(spark, db, tmp_path):
    spark.dataSource.register(ChangeFeed)
    t = db.make("a", [(1, "a"), (2, "b")], pk="id")
    t.update("id = 1", v="'A'")
    df = spark.read.format("ivm_changes").option("path", t.path).load()
    assert sorted(map(tuple, df.select("id", "v", WEIGHT, "_version").collect())) == [(1, "A", 1, 1), (1, "a", -1, 1), (1, "a", 1, 0), (2, "b", 1, 0)]
    assert spark.read.format("ivm_changes").option("path", t.path).option("after", 0).load().count() == 2

    seen = []

    def go():
        frame = spark.readStream.format("ivm_changes").option("path", t.path).load()
        q = frame.writeStream.foreachBatch(lambda b, i: seen.extend(map(tuple, b.select("id", WEIGHT).collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    t.delete("id = 2")
    go()
    assert sorted(seen) == [(1, -1), (1, 1), (1, 1), (2, -1), (2, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_match_a_recomputation(spark, db, seed):
    """Any history of changes to two sources, every join, aggregates and scans: incremental is fresh."""
    rng = random.Random(seed)
    ddl = {"l": "id int, k int, x int", "r": "rid int, k int, y int"}
    row = lambda i: (i, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, *range(6)]))
    tables = {n: db.make(n, [row(i) for i in range(8)], ddl[n], pk=ddl[n].split()[0]) for n in "lr"}
    left, right = source(db("l"), p=1.0).alias("l"), source(db("r"), p=1.0).alias("r")
    plans = {}
    for how in ("inner", "left", "right", "full"):
        plans[how] = left.join(right, on="k", how=how).select("l.id, r.rid, l.k AS lk, r.k AS rk, l.x, r.y"), {"pk": ("id", "rid")}
    for how in ("semi", "anti"):
        plans[how] = left.join(right, on="k", how=how), {"pk": "id"}
    plans["agg"] = left.join(right, on="k", how="left").aggregate(by="k", n=agg.count(), s=agg.sum("y"), lo=agg.min("x"), a=agg.argmax("id", "y"), b=agg.bit_or("x")), {}
    plans["scan"] = left.along("x").accumulate(by="k", s=acc.sum("x"), l=acc.lag("id", 2), e=acc.ema("x", 0.5)), {"pk": "id"}
    for name, (plan, how) in plans.items():
        plan.merge_into(spark, db(name), **how)
    for step in range(2):
        for n, t in tables.items():
            key = ddl[n].split()[0]
            t.delete(f"{key} % 5 = {rng.randrange(5)}")
            t.update(f"{key} % 3 = {rng.randrange(3)}", k=str(rng.choice(["NULL", 1, 2])), **{ddl[n].split()[4]: str(rng.randrange(6))})
            t.insert(spark.createDataFrame([row(100 + 10 * step + i) for i in range(3)], ddl[n]))
        for name, (plan, how) in plans.items():
            assert plan.merge_into(spark, db(name), **how).status == "incremental"
            plan.merge_into(spark, db(f"{name}{step}"), **how)
            assert sorted(map(str, current(spark, db(name)).collect())) == sorted(map(str, current(spark, db(f"{name}{step}")).collect())), (name, step)
