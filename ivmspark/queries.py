"""Registered queries of the engine and the SQL that gives the same rows.

Where a plan can be followed, the answer is earned incrementally: its sources are landed in an earlier state (rows missing, rows
altered, rows that will go), the plan is run once, the sources are brought to the given tables by a commit,
and the plan is run again. That run has to be incremental, and what it leaves is the result. The SQL works
on the given tables alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import acc, agg
from .operators.zset import WEIGHT, as_zset, consolidate, diff, rewind, union
from .plans.builder import changelog_source, source
from .plans.run import apply_changes, apply_zset, begin, current, drop_log, heartbeat, run
from .sources import log
from .sources.change import ChangelogLayout, changes_at_tag, spark_uri, table_changes
from .sources.log import CommitConflict
from .sources.store import read_tag, root, run_meta, table, tagged_versions
from .streaming.driver import follow
from .streaming.feed import ChangeFeed

#: Keys, and for each table a column to alter and an offset that makes keys of rows that never were.
KEYS = {
    "orders": ("o_orderkey",), "customer": ("c_custkey",), "part": ("p_partkey",), "supplier": ("s_suppkey",), "nation": ("n_nationkey",),
    "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"), "embeddings": ("vec_id",),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"),
}
ALTER = {
    "orders": ("o_totalprice", "o_totalprice + 1"), "customer": ("c_mktsegment", "'GONE'"), "part": ("p_brand", "'GONE'"), "supplier": ("s_nationkey", "(s_nationkey + 1) % 25"),
    "nation": ("n_name", "'GONE'"), "events": ("value", "value * 2"), "documents": ("source", "'gone'"), "labels": ("quality", "1 - quality"),
    "conversations": ("role", "'gone'"), "embeddings": ("label", "label + 1"), "lineitem": ("l_quantity", "l_quantity + 1"),
}
GHOST = 50_000_000


class Staged:
    """A scratch database whose tables are first in an earlier state, then as given."""

    def __init__(self, spark: SparkSession, sf_dir: str, **tables: dict[str, str] | None):
        """tables: name -> columns that are replaced by SQL expressions over the row, or None."""
        self.spark, self.db = spark, f"q{uuid.uuid4().hex[:12]}"
        self.given = {}
        for name, other in tables.items():
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            self.given[name] = df.selectExpr(*[f"{other[c]} AS {c}" if c in (other or {}) else c for c in df.columns])
            table(spark, self.ref(name)).create(self.earlier(name), pk=KEYS[name])

    def ref(self, name: str) -> str:
        return f"{self.db}.{name}"

    def earlier(self, name: str) -> DataFrame:
        """A tenth of the rows missing, a twentieth altered, some rows of keys that will go."""
        df, key = self.given[name], KEYS[name]
        h = F.pmod(F.xxhash64(*key), F.lit(40))
        column, value = ALTER[name]
        altered = F.when(h.isin(1, 2), F.expr(value).cast(df.schema[column].dataType)).otherwise(F.col(column)).alias(column)
        there = df.where(~h.isin(3, 4, 5, 6)).select(*[altered if c == column else F.col(c) for c in df.columns])
        ghosts = df.where(h == 7).withColumn(key[0], (F.col(key[0]) + GHOST).cast(df.schema[key[0]].dataType))
        return there.unionByName(ghosts)

    def arrive(self) -> None:
        """Bring the tables to what is given, a commit each."""
        for name, df in self.given.items():
            table(self.spark, self.ref(name)).overwrite(df)

    def leaf(self, name: str):
        return source(self.ref(name), p=1.0)

    def maintain(self, plan, **how) -> DataFrame:
        out = self.ref("out")
        plan.merge_into(self.spark, out, **how)
        self.arrive()
        done = plan.merge_into(self.spark, out, **how)
        if done.status != "incremental":
            raise RuntimeError(f"the run was {done.status}")
        return current(self.spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: sums taken in another order differ in their last bits."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


# ---- joins ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    s = Staged(spark, sf_dir, orders=None, customer=None)
    plan = s.leaf("orders").alias("o").join(s.leaf("customer").alias("c"), on={"o_custkey": "c_custkey"})
    return s.maintain(plan.select("o.o_orderkey, o.o_custkey, c.c_mktsegment, o.o_totalprice"), pk="o_orderkey")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(spark, sf_dir):
    s = Staged(spark, sf_dir, documents=None, labels=None)
    plan = s.leaf("documents").alias("d").join(s.leaf("labels").alias("l"), on="doc_id", how="left")
    return s.maintain(plan.select("d.doc_id, d.source, l.quality"), pk="doc_id")


@query("SELECT d.doc_id, d.source, l.quality FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
def join_right(spark, sf_dir):
    s = Staged(spark, sf_dir, documents=None, labels=None)
    plan = s.leaf("labels").alias("l").join(s.leaf("documents").alias("d"), on="doc_id", how="right")
    return s.maintain(plan.select("d.doc_id, d.source, l.quality"), pk="doc_id")


@query("""SELECT coalesce(d.doc_id, l.twice) AS k, d.source, l.quality FROM documents d FULL JOIN (SELECT 2 * doc_id + 1 AS twice, quality FROM labels) l ON d.doc_id = l.twice""")
def join_full(spark, sf_dir):
    """All documents and all labels, these under other ids, so that either side has rows of its own."""
    s = Staged(spark, sf_dir, documents=None, labels={"doc_id": "2 * doc_id + 1"})
    plan = s.leaf("documents").alias("d").join(s.leaf("labels").alias("l"), on="doc_id", how="full")
    return s.maintain(plan.select("coalesce(d.doc_id, l.doc_id) AS k, d.source, l.quality"), pk="k")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_unfiltered(spark, sf_dir):
    """Affected keys without the filter on both sides."""
    s = Staged(spark, sf_dir, documents=None, labels=None)
    plan = s.leaf("documents").alias("d").join(s.leaf("labels").alias("l"), on="doc_id", how="left")
    return s.maintain(plan.select("d.doc_id, d.source, l.quality, l.toxic"), pk="doc_id", key_filter=False)


@query("SELECT doc_id, lang, source FROM documents SEMI JOIN labels USING (doc_id)")
def join_semi(spark, sf_dir):
    s = Staged(spark, sf_dir, documents=None, labels=None)
    plan = s.leaf("documents").alias("d").join(s.leaf("labels").alias("l"), on="doc_id", how="semi")
    return s.maintain(plan.select("d.doc_id, d.lang, d.source"), pk="doc_id")


@query("SELECT doc_id, lang, source FROM documents ANTI JOIN labels USING (doc_id)")
def join_anti(spark, sf_dir):
    s = Staged(spark, sf_dir, documents=None, labels=None)
    plan = s.leaf("documents").alias("d").join(s.leaf("labels").alias("l"), on="doc_id", how="anti")
    return s.maintain(plan.select("d.doc_id, d.lang, d.source"), pk="doc_id")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, o_custkey, s_name, n_name FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def join_bushy(spark, sf_dir):
    s = Staged(spark, sf_dir, lineitem=None, orders=None, supplier=None, nation=None)
    left = s.leaf("lineitem").alias("l").join(s.leaf("orders").alias("o"), on={"l_orderkey": "o_orderkey"})
    right = s.leaf("supplier").alias("s").join(s.leaf("nation").alias("n"), on={"s_nationkey": "n_nationkey"})
    plan = left.join(right, on={"l.l_suppkey": "s.s_suppkey"})
    return s.maintain(plan.select("l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_shipdate, o.o_custkey, s.s_name, n.n_name"), pk=KEYS["lineitem"])


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS nation FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey""")
def join_self(spark, sf_dir):
    s = Staged(spark, sf_dir, supplier=None)
    plan = s.leaf("supplier").alias("a").join(s.leaf("supplier").alias("b"), on="s_nationkey").filter("a.s_suppkey < b.s_suppkey")
    return s.maintain(plan.select("a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS nation"), pk=("a", "b"))


# ---- pipeline stages ----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_name, round(o_totalprice * 1.1, 6) AS gross, upper(o_orderpriority) AS priority FROM orders
          JOIN customer ON o_custkey = c_custkey WHERE o_totalprice * 1.1 > 1000 AND c_acctbal > 0""")
def stages(spark, sf_dir):
    s = Staged(spark, sf_dir, orders=None, customer=None)
    plan = s.leaf("orders").alias("o").join(s.leaf("customer").alias("c"), on={"o_custkey": "c_custkey"}).filter("c.c_acctbal > 0")
    plan = plan.mutate(gross="o.o_totalprice * 1.1D", priority="upper(o.o_orderpriority)").filter("gross > 1000")
    return rounded(s.maintain(plan.select("o.o_orderkey, c.c_name, gross, priority"), pk="o_orderkey"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def star(spark, sf_dir):
    s = Staged(spark, sf_dir, customer=None, nation=None)
    return s.maintain(s.leaf("customer").alias("c").join(s.leaf("nation").alias("n"), on={"c_nationkey": "n_nationkey"}), pk="c_custkey")


@query("SELECT source, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source HAVING count(*) > 3")
def sql_escape(spark, sf_dir):
    s = Staged(spark, sf_dir, documents=None)
    plan = s.leaf("documents").alias("d").sql("SELECT source, count(DISTINCT lang) AS langs, sum(n_chars) AS chars FROM d GROUP BY source HAVING count(*) > 3")
    out = s.ref("out")
    plan.merge_into(spark, out, pk="source")
    s.arrive()
    if plan.merge_into(spark, out, pk="source").status != "comprehensive":
        raise RuntimeError("a query is computed as a whole")
    return current(spark, out)


class _Expression:
    """What a plan sees of another library's expression: an object that gives its text."""

    def to_sql(self, dialect: str) -> str:
        return "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS most FROM c GROUP BY c_mktsegment"


@query("SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY c_mktsegment")
def sql_expression(spark, sf_dir):
    s = Staged(spark, sf_dir, customer=None)
    plan, out = s.leaf("customer").alias("c").sql(_Expression()), s.ref("out")
    plan.merge_into(spark, out, pk="c_mktsegment")
    s.arrive()
    plan.merge_into(spark, out, pk="c_mktsegment")
    return current(spark, out)


@query("SELECT o_orderkey, CAST(o_custkey % 100 AS INT) AS bucket, o_orderpriority FROM orders WHERE o_custkey % 100 > 20")
def registered_udf(spark, sf_dir):
    """A function of the user's, registered with Spark, in a plan's text."""
    spark.udf.register("ivm_bucket", lambda n: None if n is None else n % 100, "int")
    s = Staged(spark, sf_dir, orders=None)
    plan = s.leaf("orders").alias("o").filter("ivm_bucket(o.o_custkey) > 20").mutate(bucket="ivm_bucket(o.o_custkey)")
    return s.maintain(plan.select("o.o_orderkey, bucket, o.o_orderpriority"), pk="o_orderkey")


# ---- aggregates -----------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY 1, 2")
def time_windows(spark, sf_dir):
    """Windows of time as a computed column; late, moved and withdrawn rows find theirs."""
    s = Staged(spark, sf_dir, events=None)
    plan = s.leaf("events").alias("e").mutate(hour="date_trunc('HOUR', e.ts)")
    return s.maintain(plan.aggregate(by=("hour", "event_type"), n=agg.count(), hi=agg.max("value")))


@query("""SELECT s_nationkey, count(*) * 3000000001 AS n, CAST(sum(s_suppkey) * 3000000001 AS BIGINT) AS keys, round(avg(s_acctbal), 6) AS mean, round(var_pop(s_acctbal), 4) AS spread,
          max(s_acctbal) AS hi FROM supplier GROUP BY s_nationkey""")
def agg_heavy_weights(spark, sf_dir):
    """Every row of a keyless source three thousand million times more, as one row of that weight."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")
    t = table(spark, f"{db}.supplier")
    t.create(df)
    plan = source(f"{db}.supplier", p=1.0).aggregate(
        by="s_nationkey", n=agg.count(), keys=agg.sum("s_suppkey"), mean=agg.mean("s_acctbal"), spread=agg.var("s_acctbal", "pop"), hi=agg.max("s_acctbal")
    )
    plan.merge_into(spark, f"{db}.out")
    t.merge(as_zset(df, 3_000_000_000))
    if plan.merge_into(spark, f"{db}.out").status != "incremental":
        raise RuntimeError("not incremental")
    return rounded(current(spark, f"{db}.out")).withColumn("spread", F.round("spread", 4))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 4) AS price, round(avg(l_quantity), 6) AS qty
          FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_sum_count_mean(spark, sf_dir):
    s = Staged(spark, sf_dir, lineitem=None)
    plan = s.leaf("lineitem").aggregate(by=("l_returnflag", "l_linestatus"), n=agg.count(), price=agg.sum("l_extendedprice"), qty=agg.mean("l_quantity"))
    out = s.maintain(plan)
    return rounded(out.withColumn("price", F.round("price", 4)))


@query("""SELECT l_suppkey, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp, round(stddev_samp(l_discount), 6) AS ss,
          round(stddev_pop(l_discount), 6) AS sp FROM lineitem GROUP BY l_suppkey""")
def agg_var_std(spark, sf_dir):
    s = Staged(spark, sf_dir, lineitem=None)
    plan = s.leaf("lineitem").aggregate(
        by="l_suppkey", vs=agg.var("l_quantity"), vp=agg.var("l_quantity", "pop"), ss=agg.stddev("l_discount"), sp=agg.stddev("l_discount", "population")
    )
    return rounded(s.maintain(plan))


@query("SELECT user_id, min(value) AS lo, max(value) AS hi, min(ts) AS first_ts, max(event_type) AS last_type FROM events GROUP BY user_id")
def agg_minmax(spark, sf_dir):
    s = Staged(spark, sf_dir, events=None)
    return s.maintain(s.leaf("events").aggregate(by="user_id", lo=agg.min("value"), hi=agg.max("value"), first_ts=agg.min("ts"), last_type=agg.max("event_type")))


@query("SELECT l_orderkey, round(product(1 + l_discount / 7), 9) AS p FROM lineitem GROUP BY l_orderkey")
def agg_product(spark, sf_dir):
    s = Staged(spark, sf_dir, lineitem=None)
    plan = s.leaf("lineitem").alias("l").mutate(factor="1 + l.l_discount / 7").aggregate(by="l_orderkey", p=agg.product("factor"))
    return rounded(s.maintain(plan), 9)


@query("""SELECT l_suppkey, round(sum(l_quantity), 6) AS w, round(sum(l_discount * l_quantity), 6) AS ws, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS wa
          FROM lineitem GROUP BY l_suppkey""")
def agg_weighted(spark, sf_dir):
    s = Staged(spark, sf_dir, lineitem=None)
    plan = s.leaf("lineitem").aggregate(
        by="l_suppkey", w=agg.weight_total("l_quantity"), ws=agg.weighted_sum("l_discount", "l_quantity"), wa=agg.weighted_average("l_discount", "l_quantity")
    )
    return rounded(s.maintain(plan))


@query("""SELECT l_suppkey, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(corr(l_quantity, l_tax), 6) AS r,
          round(regr_slope(l_tax, l_quantity), 6) AS slope, round(regr_intercept(l_tax, l_quantity), 6) AS icept FROM lineitem GROUP BY l_suppkey""")
def agg_comoments(spark, sf_dir):
    s = Staged(spark, sf_dir, lineitem=None)
    plan = s.leaf("lineitem").aggregate(
        by="l_suppkey", cs=agg.covariance("l_quantity", "l_tax"), cp=agg.covariance("l_quantity", "l_tax", "pop"), r=agg.pearson_correlation("l_quantity", "l_tax"),
        slope=agg.ols_slope("l_quantity", "l_tax"), icept=agg.ols_intercept("l_quantity", "l_tax"),
    )
    return rounded(s.maintain(plan))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id")
def agg_arg(spark, sf_dir):
    s = Staged(spark, sf_dir, events=None)
    return s.maintain(s.leaf("events").aggregate(by="user_id", first_type=agg.argmin("event_type", "event_id"), last_value=agg.argmax("value", "event_id")))


@query("SELECT user_id, bool_and(value > 5) AS every, bool_or(event_type = 'error') AS some FROM events GROUP BY user_id")
def agg_bool(spark, sf_dir):
    s = Staged(spark, sf_dir, events=None)
    plan = s.leaf("events").alias("e").mutate(big="e.value > 5", bad="e.event_type = 'error'")
    return s.maintain(plan.aggregate(by="user_id", every=agg.bool_and("big"), some=agg.bool_or("bad")))


@query("SELECT user_id, bit_and(event_id) AS common, bit_or(event_id) AS any FROM events GROUP BY user_id")
def agg_bit(spark, sf_dir):
    s = Staged(spark, sf_dir, events=None)
    return s.maintain(s.leaf("events").aggregate(by="user_id", common=agg.bit_and("event_id"), any=agg.bit_or("event_id")))


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 4) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def agg_over_join(spark, sf_dir):
    s = Staged(spark, sf_dir, orders=None, customer=None)
    plan = s.leaf("orders").alias("o").join(s.leaf("customer").alias("c"), on={"o_custkey": "c_custkey"})
    return rounded(s.maintain(plan.aggregate(by="c_mktsegment", n=agg.count(), revenue=agg.sum("o_totalprice"))), 4)


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS trail FROM events GROUP BY user_id")
def agg_reduce(spark, sf_dir):
    s = Staged(spark, sf_dir, events=None)

    def trail(state, row):
        state = f"{state}>{row['event_type']}" if state else row["event_type"]
        return state, state

    return s.maintain(s.leaf("events").along("event_id").aggregate(by="user_id", trail=agg.reduce(trail, "", dtype="string")))


# ---- ordered scans ----------------------------------------------------------------------------------------

_EVENTS = "event_id, user_id"
_OVER = "(PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


def _scan(spark, sf_dir, by="user_id", along="event_id", **metrics) -> DataFrame:
    s = Staged(spark, sf_dir, events=None)
    plan = s.leaf("events").along(along).accumulate(by=by, **metrics)
    return rounded(s.maintain(plan, pk="event_id").select("event_id", "user_id", *metrics))


@query(f"""SELECT {_EVENTS}, round(sum(value) OVER {_OVER}, 6) AS total, CAST(sum(user_id) OVER {_OVER} AS BIGINT) AS ids, count(*) OVER {_OVER} AS n FROM events""")
def scan_sum_count(spark, sf_dir):
    return _scan(spark, sf_dir, total=acc.sum("value"), ids=acc.sum("user_id"), n=acc.count())


@query(f"""SELECT {_EVENTS}, min(value) OVER {_OVER} AS lo, max(value) OVER {_OVER} AS hi, first_value(event_type) OVER {_OVER} AS first_type FROM events""")
def scan_min_max_first(spark, sf_dir):
    return _scan(spark, sf_dir, lo=acc.min("value"), hi=acc.max("value"), first_type=acc.first("event_type"))


@query("""SELECT event_id, user_id, lag(value) OVER w AS before, lag(event_type, 3) OVER w AS third, lag(ts, 2) OVER w AS since FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def scan_lag(spark, sf_dir):
    return _scan(spark, sf_dir, before=acc.prev("value"), third=acc.lag("event_type", 3), since=acc.lag("ts", 2))


@query("""SELECT event_id, user_id, CASE WHEN row_number() OVER w >= 3 THEN round(0.25 * lag(value, 2) OVER w + 0.5 * lag(value, 1) OVER w + 0.25 * value, 6) END AS smooth
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def scan_convolution(spark, sf_dir):
    return _scan(spark, sf_dir, smooth=acc.convolution("value", [0.25, 0.5, 0.25]))


@query("""SELECT event_id, user_id, round(product(1 + value / 1e6) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS grown FROM events""")
def scan_product(spark, sf_dir):
    s = Staged(spark, sf_dir, events=None)
    plan = s.leaf("events").alias("e").mutate(step="1 + e.value / 1e6D").along("event_id").accumulate(by="user_id", grown=acc.product("step"))
    return rounded(s.maintain(plan, pk="event_id").select("event_id", "user_id", "grown"))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
          e AS (SELECT event_id, user_id, k, value AS v FROM o WHERE k = 1
                UNION ALL SELECT o.event_id, o.user_id, o.k, 0.3 * o.value + 0.7 * e.v FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
          SELECT event_id, user_id, round(v, 6) AS smooth FROM e""")
def scan_ema(spark, sf_dir):
    return _scan(spark, sf_dir, smooth=acc.ema("value", 0.3))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
          e AS (SELECT event_id, user_id, k, value AS v FROM o WHERE k = 1
                UNION ALL SELECT o.event_id, o.user_id, o.k, (1 - exp(-0.01 * (o.event_id - e.event_id))) * o.value + exp(-0.01 * (o.event_id - e.event_id)) * e.v
                FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
          SELECT event_id, user_id, round(v, 6) AS decayed FROM e""")
def scan_tema(spark, sf_dir):
    return _scan(spark, sf_dir, decayed=acc.tema("value", 0.01))


@query("""SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors
          FROM events""")
def scan_custom(spark, sf_dir):
    def step(state, row):
        state["errors"] += row["event_type"] == "error"
        return state, state["errors"]

    return _scan(spark, sf_dir, errors=acc.scan(step, {"errors": 0}, "long"))


@query("SELECT event_id, user_id, round(sum(value) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS total, row_number() OVER (ORDER BY ts) AS n FROM events")
def scan_ungrouped(spark, sf_dir):
    return _scan(spark, sf_dir, by=None, along="ts", total=acc.sum("value"), n=acc.count()).withColumn("total", F.round("total", 4))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n, lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS back, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS total FROM events")
def scan_tail(spark, sf_dir):
    """Only new rows at every group's end: each is resumed from its carried state."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = df.agg(F.expr("percentile_approx(event_id, 0.9)")).first()[0]
    t = table(spark, f"{db}.events")
    t.create(df.where(F.col("event_id") <= cut), pk="event_id")
    plan = source(f"{db}.events", p=1.0).along("event_id").accumulate(by="user_id", n=acc.count(), back=acc.lag("value", 2), total=acc.sum("value"))
    plan.merge_into(spark, f"{db}.out", pk="event_id")
    t.insert(df.where(F.col("event_id") > cut))
    if plan.merge_into(spark, f"{db}.out", pk="event_id").status != "incremental":
        raise RuntimeError("not incremental")
    return rounded(current(spark, f"{db}.out").select("event_id", "user_id", "n", "back", "total"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events WHERE user_id % 3 <> 1")
def scan_vanished(spark, sf_dir):
    """Groups that go altogether, and come back later with other rows."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = table(spark, f"{db}.events")
    t.create(df, pk="event_id")
    plan = source(f"{db}.events", p=1.0).along("event_id").accumulate(by="user_id", n=acc.count())
    for change in (lambda: None, lambda: t.delete("user_id % 3 > 0"), lambda: t.insert(df.where("user_id % 3 = 2"))):
        change()
        plan.merge_into(spark, f"{db}.out", pk="event_id")
    return current(spark, f"{db}.out").select("event_id", "user_id", "n")


# ---- append-only outputs, Z-sets, bridges -------------------------------------------------------------


@query("""SELECT event_id, user_id, value, CAST(-1 AS BIGINT) AS w FROM events WHERE value > 5 AND event_id % 10 = 0 UNION ALL
          SELECT event_id, user_id, value + 1, CAST(1 AS BIGINT) FROM events WHERE value > 5 AND event_id % 10 = 0 UNION ALL
          SELECT event_id, user_id, value, CAST(-1 AS BIGINT) FROM events WHERE value > 5 AND event_id % 10 = 1""")
def drop_log_rows(spark, sf_dir):
    """What an append-only output has refused: retractions, and second images of a key."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    t = table(spark, f"{db}.events")
    t.create(df, pk="event_id")
    plan = source(f"{db}.events", p=1.0).alias("e").filter("e.value > 5")
    plan.append_to(spark, f"{db}.log", pk="event_id")
    t.update("event_id % 10 = 0 AND value > 5", value="value + 1")
    t.delete("event_id % 10 = 1")
    plan.append_to(spark, f"{db}.log", pk="event_id", fail_on_conflict=False)
    return drop_log(spark, f"{db}.log").withColumnRenamed(WEIGHT, "w")


@query("SELECT event_id, user_id, value FROM events WHERE value > 5")
def append_log(spark, sf_dir):
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = table(spark, f"{db}.events")
    t.create(df.where("event_id % 3 = 0"), pk="event_id")
    plan = source(f"{db}.events", p=1.0).alias("e").filter("e.value > 5").select("e.event_id, e.user_id, e.value")
    for rest in (None, 1, 2):
        if rest:
            t.insert(df.where(f"event_id % 3 = {rest}"))
        plan.append_to(spark, f"{db}.log", pk="event_id")
    return current(spark, f"{db}.log")


@query("""SELECT o_orderkey, o_totalprice, CAST(1 AS BIGINT) AS w FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
          SELECT o_orderkey, o_totalprice + 1, CAST(-1 AS BIGINT) FROM orders WHERE o_orderkey % 5 = 0""")
def zset_diff(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    old = df.withColumn("o_totalprice", F.expr("IF(o_orderkey % 5 = 0, o_totalprice + 1, o_totalprice)"))
    return diff(df, old).withColumnRenamed(WEIGHT, "w")


@query("SELECT event_type, user_id % 7 AS k, count(*) - 1 AS w FROM events GROUP BY ALL HAVING count(*) <> 1")
def zset_consolidate(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "user_id % 7 AS k")
    return consolidate(union(as_zset(rows), as_zset(rows.distinct(), -1))).withColumnRenamed(WEIGHT, "w")


@query("SELECT event_id, user_id FROM events WHERE event_id % 4 <> 0")
def zset_rewind(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return rewind(rows, as_zset(rows.where("event_id % 4 = 0")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 3")
def tagged_window(spark, sf_dir):
    """What the run of one tag changed, of three runs."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    t = table(spark, f"{db}.orders")
    t.create(df.where("o_orderkey % 7 NOT IN (3, 4)"), pk="o_orderkey")
    plan = source(f"{db}.orders", p=1.0)
    plan.merge_into(spark, f"{db}.out", pk="o_orderkey", tag="first")
    for rest in (3, 4):
        t.insert(df.where(f"o_orderkey % 7 = {rest}"))
        plan.merge_into(spark, f"{db}.out", pk="o_orderkey", tag=f"rest {rest}")
    return changes_at_tag(spark, f"{db}.out", "rest 3").upserts


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 >= 3")
def window_since_pin(spark, sf_dir):
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    t = table(spark, f"{db}.orders")
    t.create(df.where("o_orderkey % 7 < 3"), pk="o_orderkey")
    _, pin = table_changes(spark, f"{db}.orders", None)
    t.insert(df.where("o_orderkey % 7 IN (3, 4)"))
    t.insert(df.where("o_orderkey % 7 >= 5"))
    return table_changes(spark, f"{db}.orders", pin)[0].upserts


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 < 5")
def read_as_of_version(spark, sf_dir):
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    t = table(spark, f"{db}.orders")
    t.create(df.where("o_orderkey % 7 < 3"), pk="o_orderkey")
    t.insert(df.where("o_orderkey % 7 IN (3, 4)"))
    pin = t.pin()
    t.insert(df.where("o_orderkey % 7 >= 5"))
    t.delete("o_orderkey % 2 = 0")
    return t.snapshot(pin.version)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def foreign_zset(spark, sf_dir):
    """Signed rows, then whole rows, landed from elsewhere."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    old = df.where("c_custkey % 9 <> 0").withColumn("c_mktsegment", F.expr("IF(c_custkey % 5 = 0, 'GONE', c_mktsegment)"))
    apply_changes(spark, f"{db}.customer", old, "c_custkey", tag="1")
    apply_changes(spark, f"{db}.customer", diff(df.where("c_custkey % 4 <> 0"), old), "c_custkey", tag="2")
    apply_changes(spark, f"{db}.customer", df, "c_custkey", tag="3", full=True)
    return current(spark, f"{db}.customer")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 500")
def low_level_run(spark, sf_dir):
    """A run with hand-written full and delta functions."""
    s = Staged(spark, sf_dir, orders=None)
    src = s.ref("orders")
    shape = lambda df: df.where("o_totalprice > 500").select("o_orderkey", "o_totalprice", *[c for c in df.columns if c == WEIGHT])
    full = lambda ctx: shape(ctx.new(src))
    delta = lambda ctx: None if ctx.delta(src).is_full else shape(ctx.delta(src).zset)
    step = lambda: run(spark, s.ref("out"), sources=[src], pk="o_orderkey", full=full, delta=delta)
    step()
    s.arrive()
    if step().status != "incremental":
        raise RuntimeError("not incremental")
    return current(spark, s.ref("out"))


def _foreign(spark, folder: str, entries: dict, layout: ChangelogLayout) -> None:
    """The sidecar of a foreign producer's folder, published anew."""
    path = f"{folder}/{layout.sidecar}"
    if log.exists(spark, path):
        log.remove(spark, path)
    log.publish(spark, path, json.dumps(entries))


def _foreign_folder(spark) -> str:
    return f"{root(spark)}/foreign-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def foreign_merge(spark, sf_dir):
    lay, folder, out = ChangelogLayout(), _foreign_folder(spark), f"q{uuid.uuid4().hex[:12]}.out"
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    old = df.where("c_custkey % 9 <> 0").withColumn("c_mktsegment", F.expr("IF(c_custkey % 5 = 0, 'GONE', c_mktsegment)"))
    part = lambda z, f: z.withColumnRenamed(WEIGHT, lay.weight).withColumn(lay.epoch, F.lit(f)).write.mode("append").parquet(f"{folder}/customer{lay.warm}")
    old.write.parquet(f"{folder}/customer{lay.cold}")
    part(diff(old, old), "f1")
    entry = {"mode": "merge", "pk": "c_custkey", "floor": "f1", "f": "f1", "f_base": "f1"}
    _foreign(spark, folder, {"customer": entry}, lay)
    plan = changelog_source(folder, "customer", p=1.0)
    plan.merge_into(spark, out, pk="c_custkey")
    part(diff(df, old), "f2")
    _foreign(spark, folder, {"customer": entry | {"f": "f2"}}, lay)
    if plan.merge_into(spark, out, pk="c_custkey").status != "incremental":
        raise RuntimeError("not incremental")
    return current(spark, out)


@query("SELECT event_id, user_id, value FROM events")
def foreign_append(spark, sf_dir):
    lay, folder, out = ChangelogLayout(), _foreign_folder(spark), f"q{uuid.uuid4().hex[:12]}.out"
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    plan = changelog_source(folder, "events", p=1.0)
    for k, f in enumerate(("f1", "f2", "f3")):
        df.where(f"event_id % 3 = {k}").withColumn(lay.epoch, F.lit(f)).write.mode("append").parquet(f"{folder}/events")
        _foreign(spark, folder, {"events": {"mode": "append", "pk": "event_id", "floor": "f1", "f": f, "f_base": None}}, lay)
        plan.merge_into(spark, out, pk="event_id")
    return current(spark, out)


@query("SELECT p_partkey, p_brand, p_size FROM part")
def foreign_overwrite(spark, sf_dir):
    lay, folder, out = ChangelogLayout(), _foreign_folder(spark), f"q{uuid.uuid4().hex[:12]}.out"
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    plan = changelog_source(folder, "part", p=1.0)
    for f, rows in (("f1", df.where("p_partkey % 3 <> 0")), ("f2", df)):
        rows.write.mode("overwrite").parquet(f"{folder}/part.parquet")
        _foreign(spark, folder, {"part": {"mode": "overwrite", "pk": "p_partkey", "floor": None, "f": f, "f_base": None}}, lay)
        plan.merge_into(spark, out, pk="p_partkey")
    return current(spark, out)


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def stream_steps(spark, sf_dir):
    """Micro-batches of a stream landed on a table, an aggregate stepped after each."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{root(spark)}/stream-{uuid.uuid4().hex}"
    df.repartition(3, "event_id").write.parquet(f"{folder}/in")
    plan = source(f"{db}.events", p=1.0).aggregate(by="user_id", n=agg.count(), total=agg.sum("value"))
    frame = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    steps = [lambda s: plan.merge_into(s, f"{db}.out")]
    follow(frame, f"{db}.events", stream="events", checkpoint=f"{folder}/checkpoint", pk="event_id", steps=steps).awaitTermination()
    return rounded(current(spark, f"{db}.out"))


@query("SELECT vec_id, embedding, label FROM embeddings")
def arrays(spark, sf_dir):
    """Array columns through a Z-set."""
    s = Staged(spark, sf_dir, embeddings=None)
    return s.maintain(s.leaf("embeddings"), pk="vec_id")


@query("SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def scan_conversations(spark, sf_dir):
    s = Staged(spark, sf_dir, conversations=None)
    plan = s.leaf("conversations").along("turn").accumulate(by="conv_id", n=acc.count(), before=acc.prev("role"))
    return s.maintain(plan, pk=("conv_id", "turn")).select("conv_id", "turn", "role", "n", "before")


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, max(value) AS hi FROM events GROUP BY user_id")
def overlapping_runs(spark, sf_dir):
    """Two runs of one output at once: one publishes while the other is at work, and that one starts over."""
    s = Staged(spark, sf_dir, events=None)
    out = s.ref("out")
    plan = s.leaf("events").aggregate(by="user_id", n=agg.count(), total=agg.sum("value"), hi=agg.max("value"))
    plan.merge_into(spark, out)
    s.arrive()
    begun = begin(spark, out, [s.ref("events")], 1.0, None, plan.print(("user_id",)))
    if plan.merge_into(spark, out).status != "incremental":
        raise RuntimeError("not incremental")
    try:
        late = current(spark, out).withColumn("n", F.col("n") + 1)
        apply_zset(spark, out, diff(late, current(spark, out)), run_meta("late", begun.ctx.pins), expected=begun.head)
    except CommitConflict:
        return rounded(current(spark, out))
    raise RuntimeError("a change from before another one was taken")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sql_outputs(spark, sf_dir):
    """An output read by its name in SQL."""
    s = Staged(spark, sf_dir, customer=None)
    s.maintain(s.leaf("customer").alias("c").select("c.c_custkey, c.c_name, c.c_mktsegment"), pk="c_custkey")
    return spark.sql(f"SELECT c_custkey, c_name, c_mktsegment FROM {s.ref('out')}")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def upkeep(spark, sf_dir):
    """A dozen commits, with a merge of segments, a base made anew and vacuums between."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    t = table(spark, f"{db}.orders")
    t.create(df.withColumn("o_totalprice", F.lit(0.0)), pk="o_orderkey")
    for k in range(9):
        t.update(f"o_orderkey % 40 = {k}", o_totalprice="1.0")
    t.vacuum(t.head() - 2, orphans_after=0)
    t.overwrite(df)
    t.vacuum(t.head(), orphans_after=0)
    return t.snapshot()


@query("SELECT o_orderkey, o_totalprice, CAST(1 AS BIGINT) AS w, CAST(o_orderkey % 3 AS BIGINT) AS version FROM orders")
def change_feed(spark, sf_dir):
    """A table's change feed as a Spark data source."""
    spark.dataSource.register(ChangeFeed)
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    t = table(spark, f"{db}.orders")
    t.create(df.where("o_orderkey % 3 = 0"), pk="o_orderkey")
    for k in (1, 2):
        t.insert(df.where(f"o_orderkey % 3 = {k}"))
    feed = spark.read.format("ivm_changes").option("path", t.path).load()
    return feed.withColumnsRenamed({WEIGHT: "w", "_version": "version"})


@query("SELECT o_orderkey, o_totalprice FROM orders")
def paced_runs(spark, sf_dir):
    """At most two of a source's versions a run, until there is nothing new."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    t = table(spark, f"{db}.orders")
    t.create(df.where("o_orderkey % 6 = 0"), pk="o_orderkey")
    plan = source(f"{db}.orders", p=1.0, versions=2)
    plan.merge_into(spark, f"{db}.out", pk="o_orderkey")
    for k in range(1, 6):
        t.insert(df.where(f"o_orderkey % 6 = {k}"))
    steps = [plan.merge_into(spark, f"{db}.out", pk="o_orderkey") for _ in range(4)]
    if [(x.status, x.pins[f"{db}.orders"].version) for x in steps] != [("incremental", 2), ("incremental", 4), ("incremental", 5), ("skipped", 5)]:
        raise RuntimeError("not paced")
    return current(spark, f"{db}.out")


@query("""SELECT * FROM (VALUES ('empty change', 'incremental', false), ('nothing new', 'skipped', false), ('heartbeat', 'skipped', false), ('after it', 'incremental', true),
          ('tag', 'second', true), ('context', 'nightly', true), ('uri', 's3a://b/x', true)) t(step, said, changed)""")
def steps_said(spark, sf_dir):
    """What runs, heartbeats, tags and commit metadata say."""
    db = f"q{uuid.uuid4().hex[:12]}"
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    t, out = table(spark, f"{db}.nation"), f"{db}.out"
    t.create(df, pk="n_nationkey")
    plan = source(f"{db}.nation", p=1.0).alias("n").filter("n.n_nationkey < 10")
    said = []
    step = lambda name, **how: said.append((name, (r := plan.merge_into(spark, out, pk="n_nationkey", **how)).status, r.changed))
    plan.merge_into(spark, out, pk="n_nationkey", tag="first")
    t.update("n_nationkey = 20", n_name="lower(n_name)")
    step("empty change")
    step("nothing new")
    t.update("n_nationkey = 21", n_name="lower(n_name)")
    heartbeat(spark, out, run_meta("heartbeat", {f"{db}.nation": t.pin()}, plan=plan.print(("n_nationkey",))))
    step("heartbeat")
    t.insert(df.limit(0), job="nightly")
    t.update("n_nationkey = 1", n_name="lower(n_name)")
    step("after it", tag="second")
    said.append(("tag", read_tag(spark, out), tagged_versions(spark, out, "second") == [table(spark, out).head()]))
    said.append(("context", next(c.meta["job"] for c in t.history() if "job" in c.meta), True))
    said.append(("uri", spark_uri("s3://b/x/?v=1"), True))
    return spark.createDataFrame(said, "step string, said string, changed boolean")


@query("""SELECT * FROM (VALUES ('schema', 'o_orderkey bigint, c_name string'), ('key missing', 'BuildError'), ('stage after aggregate', 'BuildError'), ('name of the engine', 'BuildError'),
          ('metric column missing', 'ValueError'), ('reserved in a table', 'ValueError'), ('key of two rows', 'ValueError'), ('no tables left', 'true')) t(what, said)""")
def refusals(spark, sf_dir):
    """What plans say of themselves, and what they and tables refuse."""
    db = f"q{uuid.uuid4().hex[:12]}"
    for name in ("orders", "customer"):
        table(spark, f"{db}.{name}").adopt(f"{sf_dir}/{name}.parquet", pk=KEYS[name])
    orders, customer = source(f"{db}.orders").alias("o"), source(f"{db}.customer").alias("c")
    said = [("schema", ", ".join(f"{k} {v}" for k, v in orders.join(customer, on={"o_custkey": "c_custkey"}).select("o.o_orderkey, c.c_name").schema(spark).items()))]
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tries = {
        "key missing": lambda: orders.select("o.o_custkey").merge_into(spark, f"{db}.out", pk="o_orderkey"),
        "stage after aggregate": lambda: orders.aggregate(by="o_custkey", n=agg.count()).filter("n > 1"),
        "name of the engine": lambda: orders.mutate(__ivm_x="1"),
        "metric column missing": lambda: orders.aggregate(by="o_custkey", n=agg.sum("none")).merge_into(spark, f"{db}.out"),
        "reserved in a table": lambda: table(spark, f"{db}.bad").create(nations.withColumn("__ivm_x", F.lit(1))),
        "key of two rows": lambda: table(spark, f"{db}.bad").create(nations, pk="n_regionkey"),
    }
    for what, attempt in tries.items():
        try:
            attempt()
            said.append((what, "taken"))
        except ValueError as e:
            said.append((what, type(e).__name__))
    said.append(("no tables left", str(not table(spark, f"{db}.out").exists() and not table(spark, f"{db}.bad").exists()).lower()))
    return spark.createDataFrame(said, "what string, said string")


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000")
def plan_count(spark, sf_dir):
    """A plan's rows counted without a run."""
    db = f"q{uuid.uuid4().hex[:12]}"
    for name in ("orders", "customer"):
        table(spark, f"{db}.{name}").adopt(f"{sf_dir}/{name}.parquet", pk=KEYS[name])
    plan = source(f"{db}.orders").alias("o").join(source(f"{db}.customer").alias("c"), on={"o_custkey": "c_custkey"}).filter("o.o_totalprice > 1000")
    return spark.createDataFrame([(plan.count(spark),)], "n long")


__all__ = ["ORACLE_SQL", "QUERIES", "Staged", "query", "rounded"]
