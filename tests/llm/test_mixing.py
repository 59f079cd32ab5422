from collections import defaultdict

import pytest

from ivmspark.llm import mixing as m

from .conftest import oracle, rows, sf_dir


def brute_targets(sizes):
    """Reshare the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: m.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s: 2.0 * sizes[s] for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def check(df):
    plan = m.plan_copies(df).collect()
    sizes = defaultdict(int)
    for r in plan:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in plan if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert own[0]["target"] == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert all(int(rate) <= r["copies"] <= int(rate) + 1 and r["copies"] <= 2 for r in own)
        assert abs(sum(r["copies"] for r in own) - rate * len(own)) < 1 + 1e-6  # systematic: the count is the expected one
    return plan


def test_targets_and_counts(spark, edge, small):
    check(small)
    check(edge)


def test_taken_is_near_the_target(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in m.plan_copies(df).groupBy("source").agg({"target": "max", "size": "sum"}).collect():
        assert r["max(target)"] <= 2 * r["sum(size)"]
    taken = m.plan_copies(df).selectExpr("target", "source", "copies * size AS t").groupBy("source", "target").sum("t").collect()
    assert all(abs(r["sum(t)"] / r["target"] - 1) < 0.15 for r in taken)


def test_query_is_its_sql(spark, edge, small, tmp_path):
    for k, df in enumerate((small, edge.dropDuplicates().where("doc_id IS NOT NULL"))):
        assert rows(m.op2_mixing(spark, sf_dir(df, tmp_path / str(k)))) == oracle(m.OP2_SQL, documents=df)


def test_reruns_agree_however_the_rows_lie(spark, small):
    one = sorted(map(tuple, m.plan_copies(small).collect()))
    assert one == sorted(map(tuple, m.plan_copies(small.repartition(7, "n_chars")).collect()))


def test_mixed_rows(spark, edge, small, empty):
    for df in (small, edge):
        plan = m.plan_copies(df).groupBy("id").sum("copies").collect()
        mixed = m.mix(df)
        assert mixed.columns == df.columns
        assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r["id"]: r["sum(copies)"] for r in plan if r["sum(copies)"]}
    assert m.mix(empty).count() == 0 and m.plan_copies(empty).count() == 0


def test_clashing_columns(spark, small):
    df = small.limit(20).selectExpr("*", "1 AS size", "2 AS copies", "3 AS id", "4 AS target", "5 AS `a.b`")
    mixed = m.mix(df)
    assert mixed.columns == df.columns and {r["a.b"] for r in mixed.collect()} == {5}


def test_ids_of_a_pattern_are_spread(spark):
    """Whatever step the ids have, and without ids, no bucket gets many."""
    docs = spark.range(20_000).selectExpr("id * 61 AS doc_id", "concat_ws(' ', sequence(0, 99 + id % 7)) AS text", "'a' AS source")
    sized = docs.select(m.col("doc_id").alias("id"), m.sizes(docs).alias("size"))
    top = sized.groupBy(m._bucket(m.BUCKETS).alias("b")).count().agg({"count": "max", "b": "count"}).first()
    assert top["max(count)"] < 2 * 20_000 / m.BUCKETS and top["count(b)"] == m.BUCKETS
