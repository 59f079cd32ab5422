"""Mixing sources to target weights: systematic sampling, in DataFrame operations only.

A source's rate is its target over its size. In a source's order, a document's place times the rate is the
prefix sum of expected copies; with one random offset added, each integer boundary that a document's step
crosses is one copy. A document so gets the rate rounded down or up, and any run of documents gets its
expected copies to within one. The order is by size class, then bucket, size and id, so each class is
sampled in its due share and a source's words come out near its target, however heavy the tail.

The prefix sum is in three parts, so that no task holds a source: counts by (source, size class, bucket) are
summed before the shuffle; size classes are prefix-summed within a source (some hundred rows), buckets
within a size class, and the place inside a bucket is a row number there. Buckets are by a digest of the id,
and as many as the input asks for, so a source, or a run of equal documents, is spread however large it is and
whatever pattern its ids have.

Edge cases: a null text has size 0; a text of any length is counted as a whole; a null source is a source of
its own, the last; documents of size 0 are sampled like others; repeated rows are places of their own, and
rows without an id are spread by their size; a source with no words has target 0; an empty table gives no
rows. Other columns are carried along and may have any name. Sources are one row each where targets are
worked out, in one task: some millions of them at most.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SCRATCH, WORD, col, cols, hot_safe_key, materialize, table

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # 150 %
CAP = 2
SEED = 20240607
#: Buckets of a size class of a source: this many for each ROWS rows begun.
BUCKETS, ROWS = 61, 20_000_000


def offset(seed: int) -> float:
    """The one random offset, in [0, 1)."""
    return random.Random(seed).random()


def sizes(docs: DataFrame, text_column: str = "text") -> "F.Column":
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(col(text_column).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(by_source: DataFrame) -> DataFrame:
    """From (source, source_size): adds target and rate. Weights repeat along the sources by code point,
    null last. Targets share the total by weight and stop at CAP times the size; the excess is reshared.

    With the sources ordered by how soon they are full (CAP * size / weight), those that stop are a
    prefix: the shortest after which what is left, by weight, fills no other. That prefix is a running sum
    over one row a source; sums are exact integers up to the division."""
    every = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    a, b = SHARE
    w = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(every) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    full = W.orderBy(F.expr("source_size / w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = full.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("gone"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open"),
    )
    # (a*total/b - CAP*gone) / open: what a weight of 1 gets if all before this one have stopped
    share = f"(({a} * total - {CAP * b} * gone) / DOUBLE(open)) / {b}.0D"
    stops = f"w * ({share}) >= {CAP}.0D * source_size"
    w = w.withColumn("stops", F.min(F.expr(f"int({stops})")).over(full))  # only a prefix
    left = F.first(F.when(F.col("stops") == 0, F.expr(share)), ignorenulls=True).over(full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    w = w.withColumn("each", left)
    target = F.when(F.col("stops") == 1, F.lit(float(CAP)) * F.col("source_size")).otherwise(F.col("w") * F.col("each"))
    return w.withColumn("target", target).select("source", "source_size", "target", F.expr("IF(source_size = 0, 0.0D, target / source_size)").alias("rate"))


def _bucket(buckets: int) -> "F.Column":
    """By 32 bits of a digest of the id, or of the size where there is no id."""
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("n"), F.col("size").cast("string")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def plan_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies), one row a document; copies is how often the mix
    has it."""
    sized = docs.select(col(id_column).cast("long").alias("id"), col(source_column).cast("string").alias("source"), sizes(docs, text_column).alias("size"))
    sized = materialize(sized, "sizes")
    buckets = BUCKETS * (1 + sized.count() // ROWS)
    # two leading digits and the number of digits: about 90 classes a decade, in order of size
    digits = F.col("size").cast("string")
    band = F.length(digits) * 100 + F.substring(F.rpad(digits, 2, "0"), 1, 2).cast("int")
    sized = sized.select("*", hot_safe_key("source").alias("key"), band.alias("band"), _bucket(buckets).alias("bucket"))
    counts = materialize(sized.groupBy("key", "source", "band", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "counts")
    rates = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumn("key", hot_safe_key("source")).drop("source")
    ahead = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bands = counts.groupBy("key", "band").agg(F.sum("n").alias("n"))
    bands = bands.select("key", "band", ahead(W.partitionBy("key").orderBy("band"), "n").alias("lower")).join(rates, "key")
    before = counts.select("key", "band", "bucket", ahead(W.partitionBy("key", "band").orderBy("bucket"), "n").alias("within")).join(bands, ["key", "band"])
    before = before.withColumn("before", F.col("lower") + F.col("within")).drop("lower", "within")
    inside = W.partitionBy("key", "band", "bucket").orderBy("size", "id")
    placed = sized.select("*", F.row_number().over(inside).alias("place")).join(before, ["key", "band", "bucket"])
    u, at = offset(seed), F.col("before") + F.col("place")
    copies = F.floor(at * F.col("rate") + F.lit(u)) - F.floor((at - 1) * F.col("rate") + F.lit(u))
    return placed.select("id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as often as the mix has it, columns as they came. Rows that share
    an id are paired with its places in turn, so repeated rows are mixed like others."""
    key, n, place = f"{SCRATCH}id", f"{SCRATCH}copies", f"{SCRATCH}place"
    plan = plan_copies(docs, id_column, text_column, source_column, seed)
    same = W.partitionBy("id").orderBy("size", "source", "copies")
    plan = materialize(plan.select(F.col("id").alias(key), F.col("copies").alias(n), F.row_number().over(same).alias(place)), "copies")
    mine = docs.withColumn(f"{SCRATCH}i", col(id_column).cast("long"))
    on = [F.col(f"{SCRATCH}i").eqNullSafe(F.col(key))]
    if plan.where(f"`{place}` > 1").limit(1).count():
        again = W.partitionBy(f"{SCRATCH}i").orderBy(sizes(docs, text_column), col(source_column), col(text_column))
        mine = mine.withColumn(f"{SCRATCH}p", F.row_number().over(again))
        on.append(F.col(f"{SCRATCH}p") == F.col(place))
    # hashed at every size: the plan is a few bytes a document, texts are dealt out once, unsorted
    joined = mine.join(plan.where(f"`{n}` > 0").hint("shuffle_hash"), on)
    return joined.select(*cols(docs), F.explode(F.expr(f"sequence(1L, `{n}`)")).alias(f"{SCRATCH}k")).drop(f"{SCRATCH}k")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 3, 1, 2 and 150 % of all words."""
    plan = plan_copies(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP2_SQL = f"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS w FROM t),
r AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(source_size) OVER f, 0)::BIGINT AS gone,
    (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::BIGINT AS "open"
  FROM w WINDOW f AS (ORDER BY source_size::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (({SHARE[0]} * total - {CAP * SHARE[1]} * gone)::DOUBLE / "open"::DOUBLE) / {SHARE[1]}::DOUBLE AS share FROM r),
p AS (
  SELECT *, min((w * share >= {CAP}::DOUBLE * source_size)::INT) OVER (ORDER BY source_size::DOUBLE / w, source IS NULL, source) AS stops FROM q),
e AS (
  SELECT *, first(CASE WHEN stops = 0 THEN share END IGNORE NULLS)
    OVER (ORDER BY source_size::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS each FROM p),
g AS (
  SELECT source, source_size, CASE WHEN stops = 1 THEN {CAP}::DOUBLE * source_size ELSE w * each END AS target FROM e),
o AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    CASE WHEN g.source_size = 0 THEN 0::DOUBLE ELSE g.target / g.source_size END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY
      length(size::VARCHAR) * 100 + CAST(substr(rpad(size::VARCHAR, 2, '0'), 1, 2) AS INT),
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'n' || size)), 1, 8))::BIGINT % ({BUCKETS} * (1 + (SELECT count(*) FROM s) // {ROWS})),
      size, doc_id NULLS FIRST) AS place
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT *, (floor(place * rate + {offset(SEED)!r}::DOUBLE) - floor((place - 1) * rate + {offset(SEED)!r}::DOUBLE))::BIGINT AS copies FROM o)
"""
