"""Benchmark of the engine: one JSON line.

For each headline plan: bootstrap over an earlier state of the tables, a commit that brings them to the
given state, then the incremental run, which is what ``queries`` has, in seconds; ``recompute`` has the
seconds of the same plan computed as a whole and compared, ``changed`` the share of rows the change has. Each
is the median of several rounds over fresh outputs, after one that doesn't count; ``spread`` has the least and
the most of the incremental ones. ``history`` is thirty commits of a thousandth of the rows with a run after each: its first and last ten runs.

    BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
    BENCH_CPUS     threads (default 8)
    BENCH_ROUNDS   rounds that count (default 2)
    BENCH_MATRIX   if set: every plan at five shares of changed rows instead, as a table in Markdown
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ivmspark import acc, agg, source, table
from ivmspark.plans.builder import leaves

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "2"))
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
#: Changed rows in a hundred thousand.
SHARES = (10, 100, 1_000, 10_000, 30_000)


def plans(db: str) -> dict:
    """name -> (plan, pk, table that changes, its key, column altered or None for new rows at the end, changed
    rows in a hundred thousand)."""
    s = lambda t, a: source(f"{db}.{t}", p=1.0).alias(a)
    orders, customer, line = s("orders", "o"), s("customer", "c"), s("lineitem", "l")
    bushy = line.join(orders, on={"l_orderkey": "o_orderkey"}).join(s("supplier", "s").join(s("nation", "n"), on={"s_nationkey": "n_nationkey"}), on={"l.l_suppkey": "s.s_suppkey"})
    e = source(f"{db}.events", p=1.0)
    return {
        "join_dim": (orders.join(customer, on={"o_custkey": "c_custkey"}).select("o.o_orderkey, o.o_totalprice, c.c_mktsegment"), "o_orderkey", "customer", "c_custkey", "c_acctbal", 100),
        "join_bushy": (bushy.select("l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_shipdate, o.o_custkey, s.s_name, n.n_name"), LINE, "orders", "o_orderkey", "o_totalprice", 100),
        "agg_additive": (line.aggregate(by="l_suppkey", n=agg.count(), q=agg.sum("l_quantity"), p=agg.mean("l_extendedprice"), v=agg.var("l_discount")), None, "lineitem", "l_orderkey", "l_quantity", 100),
        "agg_extremes": (line.aggregate(by="l_suppkey", lo=agg.min("l_extendedprice"), hi=agg.max("l_extendedprice")), None, "lineitem", "l_orderkey", "l_extendedprice", 100),
        "agg_comoments": (line.aggregate(by="l_suppkey", r=agg.pearson_correlation("l_quantity", "l_extendedprice"), k=agg.ols_slope("l_quantity", "l_extendedprice")), None, "lineitem", "l_orderkey", "l_quantity", 100),
        "agg_over_join": (orders.join(customer, on={"o_custkey": "c_custkey"}).aggregate(by="c_mktsegment", t=agg.sum("o_totalprice")), None, "orders", "o_orderkey", "o_totalprice", 1_000),
        "scan_tail": (e.along("event_id").accumulate(by="user_id", s=acc.sum("value"), n=acc.count(), b=acc.prev("value")), "event_id", "events", "event_id", None, 1_000),
        "scan_past": (e.along("event_id").accumulate(by="user_id", s=acc.sum("value"), m=acc.ema("value", 0.3)), "event_id", "events", "event_id", "value", 100),
        "append_log": (e.alias("e").filter("e.value > 5").select("e.event_id, e.user_id, e.value"), "event_id", "events", "event_id", None, 1_000),
    }


def run(spark, name: str, plan, out: str, pk, **how):
    if name == "append_log":
        return plan.append_to(spark, out, pk=pk, **how)
    return plan.merge_into(spark, out, **({"pk": pk} if pk else {}), **how)


def jobs_of(spark, step) -> tuple[float, int]:
    """Seconds and Spark jobs of a step."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    began = time.time()
    step()
    took = time.time() - began
    return took, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def once(spark, name: str, share: int | None = None, idle: bool = False) -> dict:
    """One bootstrap, change and run, beside a recomputation; idle: also runs with nothing to do."""
    db = f"b{uuid.uuid4().hex[:10]}"
    plan, pk, moving, key, column, usual = plans(db)[name]
    share = share or usual
    used = {x.source.split(".")[1] for x in leaves(plan.root)}
    for t in used:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == moving and column is None:  # new rows at the end
            cut = df.agg(F.expr(f"percentile_approx({key}, {1 - share / 100_000}, 1000000)")).first()[0]
            table(spark, f"{db}.{t}").create(df.where(F.col(key) <= cut))
        else:
            table(spark, f"{db}.{t}").adopt(f"{SF}/{t}.parquet")
    t = table(spark, f"{db}.{moving}")
    began = time.time()
    run(spark, name, plan, f"{db}.inc", pk)
    bootstrap = time.time() - began
    run(spark, name, plan, f"{db}.all", pk)
    if column is None:
        t.insert(spark.read.parquet(f"{SF}/{moving}.parquet").where(F.col(key) > cut))
    else:
        t.update(f"pmod(xxhash64({key}), 100000) < {share}", **{column: f"{column} + 1"})
    done = []
    inc, jobs = jobs_of(spark, lambda: done.append(run(spark, name, plan, f"{db}.inc", pk)))
    if done[0].status != "incremental":
        raise RuntimeError(name)
    whole, _ = jobs_of(spark, lambda: run(spark, name, plan, f"{db}.all", pk, ivm=False))
    skip = beat = 0.0
    if idle:
        skip, _ = jobs_of(spark, lambda: run(spark, name, plan, f"{db}.inc", pk))
        t.update("false", **{key: key})
        beat, _ = jobs_of(spark, lambda: run(spark, name, plan, f"{db}.inc", pk))
    streams = [c.streams for c in table(spark, f"{db}.inc").history() if c.streams][0]
    feed = streams.get("", {"n_ins": 0, "n_del": 0})
    change = t.commit_at(1).streams.get("", {"n_ins": 0})
    out = {
        "bootstrap": bootstrap, "inc": inc, "all": whole, "jobs": jobs, "skip": skip, "beat": beat, "feed": feed["n_ins"] + feed["n_del"],
        "bytes": sum(s["bytes"] for s in streams.values()), "share": change["n_ins"] / max(1, t.rows()),
    }
    for x in (*used, "inc", "all"):
        table(spark, f"{db}.{x}").drop()
    return out


def history(spark, commits: int = 30) -> dict:
    """An aggregate run after each of many small commits: the first ten runs and the last ten, and the files."""
    db = f"b{uuid.uuid4().hex[:10]}"
    t = table(spark, f"{db}.orders")
    t.create(spark.read.parquet(f"{SF}/orders.parquet"), pk="o_orderkey")
    plan = source(t.name, p=1.0).aggregate(by="o_custkey", n=agg.count(), s=agg.sum("o_totalprice"))
    plan.merge_into(spark, f"{db}.out")
    base, took = t.latest().streams[""]["bytes"], []
    for k in range(commits):
        t.update(f"pmod(xxhash64(o_orderkey), 1000) = {k}", o_totalprice="o_totalprice + 1")
        began = time.time()
        plan.merge_into(spark, f"{db}.out")
        took.append(time.time() - began)
    written = sum(c.streams[""]["bytes"] for c in t.history() if c.version and "" in c.streams)
    out = {"first_ten": round(statistics.median(took[:10]), 3), "last_ten": round(statistics.median(took[-10:]), 3), "segments": len(t._live(t.head(), "")["segments"]), "written_of_base": round(written / base, 3)}
    for x in ("orders", "out"):
        table(spark, f"{db}.{x}").drop()
    return out


def session(base: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.ivmspark.root", f"{base}/tables").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def matrix(spark) -> None:
    print("| plan | change % | bootstrap s | incremental s | recompute s | ratio | jobs | rows in feed | MB written | skip s | heartbeat s |\n|---|---|---|---|---|---|---|---|---|---|---|")
    for name in plans("x"):
        once(spark, name)
        for share in SHARES:
            r = once(spark, name, share, idle=True)
            print(f"| {name} | {100 * r['share']:.3g} | {r['bootstrap']:.2f} | {r['inc']:.2f} | {r['all']:.2f} | {r['inc'] / r['all']:.2f} | {r['jobs']} | {r['feed']} | {r['bytes'] / 1e6:.2f} | {r['skip']:.2f} | {r['beat']:.2f} |", flush=True)


def main() -> None:
    base = tempfile.mkdtemp(prefix="bench-")
    spark = session(base)
    try:
        if os.environ.get("BENCH_MATRIX"):
            return matrix(spark)
        med = lambda runs, k: round(statistics.median(r[k] for r in runs), 3)
        inc, rec, share, spread = {}, {}, {}, {}
        for name in plans("x"):
            runs = [once(spark, name) for _ in range(ROUNDS + 1)][1:]
            inc[name], rec[name], share[name] = med(runs, "inc"), med(runs, "all"), round(runs[0]["share"], 5)
            spread[name] = [round(f(r["inc"] for r in runs), 3) for f in (min, max)]
        long = history(spark)
    finally:
        spark.stop()
        shutil.rmtree(base, ignore_errors=True)
    total = round(sum(inc.values()), 3)
    print(json.dumps({"metric": "incremental run, total of medians", "value": total, "unit": "sec", "queries": inc, "recompute": rec, "spread": spread, "changed": share, "history": long, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
