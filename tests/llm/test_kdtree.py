import numpy as np
import pytest

from ivmspark.llm import kdtree as k

from .conftest import SF, oracle, rows, sf_dir


@pytest.mark.parametrize("floor", [None, "kth", "low"])
def test_tree_against_all_scores(floor):
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(900, 8)) * 6)
    v[:40] = v[0]  # ties
    ids = rng.permutation(900)
    tree = k.KDTree.unpack(k.KDTree(ids, ids + 5000, v, leaf=16).pack(), False)
    assert (tree.lo[0] == v.min(0)).all() and (tree.hi[0] == v.max(0)).all()
    for q in (0, 5, 400):
        want = sorted([(-int(s), int(i)) for s, i in zip(v @ v[q], ids) if i != ids[q]])[:20]
        f = None if floor is None else float(-want[-1][0]) if floor == "kth" else float(-want[-1][0]) - 50
        assert [(-int(s), i) for s, i in tree.search(v[q], int(ids[q]) + 5000, 20, f)] == want


def test_queries_in_one_shard_and_in_many(spark, monkeypatch, tmp_path):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = oracle(k.OP6_SQL, embeddings=df)
    assert rows(k.op6_topk(spark, SF)) == want
    monkeypatch.setattr(k, "SHARD", 60)
    assert rows(k.op6_topk(spark, SF)) == want


def test_components_past_floating_point(spark, tmp_path, monkeypatch):
    data = [(i, [float(2**24 + i % 7), float(-(2**23) * (i % 5)), 1.0 / (i + 1)]) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    monkeypatch.setattr(k, "SHARD", 40)
    monkeypatch.setattr(k, "LEAF", 8)
    held = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in data]
    want = []
    for i, q in held:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in held if j != i)[:20]
            want += [(i, r + 1, -s, j) for r, (s, j) in enumerate(best)]
    assert rows(k.op6_topk(spark, sf_dir(df, tmp_path, "embeddings"))) == sorted(want, key=str)


def test_edges(spark, tmp_path, monkeypatch):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.25, -1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [-1.0, -0.01]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(k.op6_topk(spark, sf_dir(df, tmp_path / "a", "embeddings")))
    assert got == oracle(k.OP6_SQL, embeddings=df)
    monkeypatch.setattr(k, "SHARD", 3)
    assert rows(k.op6_topk(spark, str(tmp_path / "a"))) == got
    assert k.op6_topk(spark, sf_dir(df.limit(0), tmp_path / "b", "embeddings")).count() == 0
    assert not [r for r in got if r[3] in (2, 3, 4, 5, 6, 7)]


def test_a_repeated_query_row_is_a_candidate_of_its_copy(spark, tmp_path):
    """By all pairs of rows: ids don't tell rows apart."""
    rng = np.random.default_rng(4)
    held = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    held += [held[20], held[40], held[40], (20, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1) for r in held], "vec_id long, embedding array<double>, `row` int")
    quant = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in held]
    want = []
    for a, (i, q) in enumerate(quant):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(quant) if a != b)[:20]
            want += [(i, n + 1, -s, j) for n, (s, j) in enumerate(best)]
    got = rows(k.op6_topk(spark, sf_dir(df, tmp_path, "embeddings")))
    assert got == sorted(want, key=str) == oracle(k.OP6_SQL, embeddings=df)
