"""The physical plans are the ones meant: what reaches the scans, what is broadcast, what stays in the JVM."""

import contextlib
import io

import pytest

from ivmspark import acc, agg, source, table
from ivmspark.operators import aggregate, scans
from ivmspark.plans.builder import Compiler, as_source, leaves
from ivmspark.plans.run import begin

SF = "/root/testdata/sf0.01"


def text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def shop(spark, db):
    table(spark, db("orders")).adopt(f"{SF}/orders.parquet", pk="o_orderkey")
    table(spark, db("customer")).adopt(f"{SF}/customer.parquet", pk="c_custkey")
    return db


def plan_of(db, how="inner"):
    joined = source(db("orders"), p=1.0).alias("o").join(source(db("customer"), p=1.0).alias("c"), on={"o_custkey": "c_custkey"}, how=how)
    return joined.filter("o.o_totalprice > 1000").select("o.o_orderkey, c.c_mktsegment")


def step(spark, db, plan):
    sources = [x.source for x in leaves(plan.root)]
    return Compiler(plan, begin(spark, db("out"), [as_source(s) for s in sources], 1.0, None, None).ctx)


def test_filters_and_columns_reach_the_scans(spark, shop):
    plan = text(step(spark, shop, plan_of(shop)).current())
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderpriority" not in plan and "c_name" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("how,join", [("inner", "BroadcastHashJoin Inner"), ("left", "BroadcastHashJoin LeftSemi BuildRight")])
def test_a_small_change_is_broadcast_and_never_crossed(spark, shop, how, join):
    plan_of(shop, how).merge_into(spark, shop("out"), pk="o_orderkey")
    table(spark, shop("customer")).update("c_custkey = 7", c_mktsegment="'X'")
    plan = text(step(spark, shop, plan_of(shop, how)).delta())
    assert join in plan
    assert (plan.count("Scan parquet") <= 4) == (how == "inner")  # a linear join reads the other side once
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "partial_sum(__ivm_weight" in plan  # summed before the shuffle


def test_a_large_change_is_not_broadcast_by_us(spark, shop, monkeypatch):
    from ivmspark.sources import change, store

    for module in (change, store):
        monkeypatch.setattr(module, "SMALL", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_of(shop).merge_into(spark, shop("out"), pk="o_orderkey")
        table(spark, shop("customer")).update("c_custkey = 7", c_mktsegment="'X'")
        assert "Broadcast" not in text(step(spark, shop, plan_of(shop)).delta())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_window_metrics_stay_in_the_jvm(spark, db):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    native = [("s", acc.sum("value")), ("n", acc.count()), ("b", acc.lag("value", 2)), ("c", acc.convolution("value", [1, 2])), ("p", acc.product("value"))]
    plan = text(scans.scanned(scans._without_carry(rows, "event_id", native), ("user_id",), "event_id", ("event_id",), native))
    assert "Arrow" not in plan and "Python" not in plan and plan.count("hashpartitioning(user_id") >= 1
    folded = [("e", acc.ema("value", 0.5)), *native]
    plan = text(scans.scanned(scans._without_carry(rows, "event_id", folded), ("user_id",), "event_id", ("event_id",), folded))
    tree = plan[: plan.index("(1)")] if "(1)" in plan else plan
    assert plan.count("MapInArrow") >= 1 and tree.count("Exchange") == 1  # the fold rides on the window's shuffle


def test_aggregates_are_partial_first_and_states_are_small(spark, db):
    table(spark, db("lineitem")).adopt(f"{SF}/lineitem.parquet")
    plan = source(db("lineitem"), p=1.0).aggregate(by="l_suppkey", n=agg.count(), v=agg.var("l_quantity"), lo=agg.min("l_tax"))
    plan.merge_into(spark, db("out"))
    state = table(spark, db("out")).snapshot(stream="aggregate")
    assert state.count() == 100
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = text(aggregate.rebuild(rows, ("l_suppkey",), aggregate.families(plan.top[1][1])))
    assert "partial_min" in got and "l_comment" not in got and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_tax:double>" in got


def test_a_change_through_several_joins_has_only_the_columns_asked_for(spark, shop):
    table(spark, shop("nation")).adopt(f"{SF}/nation.parquet", pk="n_nationkey")
    leaf = lambda name: source(shop(name), p=1.0)
    plan = leaf("orders").alias("o").join(leaf("customer").alias("c"), on={"o_custkey": "c_custkey"}).join(leaf("nation").alias("n"), on={"c.c_nationkey": "n.n_nationkey"})
    plan = plan.select("o.o_orderkey, c.c_mktsegment, n.n_name")
    plan.merge_into(spark, shop("out"), pk="o_orderkey")
    table(spark, shop("orders")).update("o_orderkey % 10 = 1", o_totalprice="o_totalprice + 1")
    change = step(spark, shop, plan).node.delta
    assert {a: change.schema[a].dataType.names for a in "ocn"} == {"o": ["o_orderkey", "o_custkey"], "c": ["c_custkey", "c_nationkey", "c_mktsegment"], "n": ["n_nationkey", "n_name"]}
    assert change.count() == 0  # of what is asked for nothing changed
    table(spark, shop("customer")).update("c_custkey = 7", c_mktsegment="'X'")
    assert plan.merge_into(spark, shop("out"), pk="o_orderkey").status == "incremental"
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(table(spark, shop("out")).snapshot()) == key(plan.frame(spark))
