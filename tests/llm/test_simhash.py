import itertools
import random

import numpy as np
import pytest
import xxhash

from ivmspark.llm import simhash as s

from .conftest import SF, sf_dir


def plain(text, k=4):
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clusters(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprints():
    for t in (b"", b" \t\x0b", b"a", b"A b\nC", b"a b c d", b"a b c d e", "É É x é y ".encode() * 50, b"w " * 200_000):
        assert s.fingerprint(t) == plain(t[:2000] if len(t) > 2000 else t) or len(t) > 2000
    assert s.fingerprint(b"ABC def ghi JKL") == s.fingerprint(b"abc  def\tghi\njkl")


@pytest.mark.parametrize("radius", [1, 2, 4, 7])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = s.covering_masks(radius, list(range(64)), 5)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= (18 if radius > 1 else 16)
    rng = random.Random(3)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not differ & m for m in masks)


def test_links_of_a_bucket_are_exact_at_any_block_size():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for b in base for _ in range(40)})
    want = clusters(fps, fps)
    for block in (8, 64, 4096):
        parent = list(range(len(fps)))
        for i, r in s.links_in_bucket(np.array(fps, np.uint64), 4, 0, block):
            parent[i] = r
        assert [fps[p] for p in parent] == want


def test_query_against_all_pairs(spark, edge, empty, tmp_path):
    for df, folder in ((edge, sf_dir(edge, tmp_path / "a")), (spark.read.parquet(f"{SF}/documents.parquet"), SF)):
        held = df.collect()
        fps = [plain((r["text"] or "").encode()) if len(r["text"] or "") < 30000 else s.fingerprint(r["text"].encode()) for r in held]
        want = sorted(zip([r["doc_id"] for r in held], [f"{x:016x}" for x in fps], clusters([r["doc_id"] for r in held], fps)), key=str)
        assert sorted(map(tuple, s.op3_simhash(spark, folder).select("doc_id", "fingerprint", "component_id").collect()), key=str) == want
    assert s.op3_simhash(spark, sf_dir(empty, tmp_path / "b")).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    found = {r["node"]: r["root"] for r in s.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert {found.get(i, i) for i in range(61)} == {0} and {found.get(100 + i, 100 + i) for i in range(50)} == {100}
    assert s.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, edge, small, empty):
    kept = s.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert 7 not in ids and ids.count(3) == 1 and 9 in ids
    held = small.collect()
    assert sorted(r["doc_id"] for r in s.keep_one(small).collect()) == survivors([r["doc_id"] for r in held], [r["text"] for r in held])
    assert s.keep_one(empty).count() == 0
    nameless = spark.createDataFrame([(None, "x y"), (None, "x y"), (None, "other words here now")], "doc_id long, text string")
    assert s.keep_one(nameless).count() == 2


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y))


def survivors(ids, texts):
    """The least id of each group that the stage's links make, by comparing all pairs."""
    fps, sets, parent = [plain((x or "").encode(), 5) for x in texts], [shingles(x) for x in texts], list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        x, y = sets[i], sets[j]
        if (fps[i] ^ fps[j]).bit_count() <= 7 or min(len(x), len(y)) >= 0.8 * max(len(x), len(y), 1) and len(x & y) >= 0.8 * len(x | y) > 0:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return sorted(least.values())


def test_stage_links_all_of_jaccard_08(spark):
    rng = random.Random(5)
    held = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 400))]
        held.append(" ".join(base))
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randrange(1, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            held.append(" ".join(words))
    fps = [plain(x.encode(), 5) for x in held]
    assert sum((fps[i] ^ fps[j]).bit_count() > 7 and jaccard(held[i], held[j]) >= 0.8 for i, j in itertools.combinations(range(len(held)), 2)) > 20
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in s.keep_one(docs).collect()) == survivors(range(len(held)), held)


def test_one_stays_with_null_and_repeated_ids(spark):
    say = lambda seed: [f"w{random.Random(seed).randrange(10**6)}-{i}" for i in range(120)]
    a, b, c, d = (say(i) for i in range(4))
    near = lambda w: " ".join([*w[:60], "edited", *w[61:]])
    rows = [(None, " ".join(a)), (None, near(a)), (5, " ".join(b)), (None, near(b)), (7, " ".join(c)), (7, " ".join(d))]
    kept = [tuple(r) for r in s.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 4 and {x for x in kept if x[0] is not None} == {rows[2], rows[4], rows[5]}
    assert sum(x in rows[:2] for x in kept) == 1


def test_rows_of_one_id_and_columns_of_any_name(spark):
    """Rows that share an id but not a text are different documents, wherever one has copies."""
    say = lambda seed: " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(60))
    alpha, zeta = say(1), say(2)
    ddl = "doc_id long, text string, `a.b` int, id int, fp string, t int, component_id int"
    rows = [(5, alpha, 1, 1, "x", 1, 1), (5, zeta, 2, 2, "y", 2, 2), (6, zeta, 3, 3, "z", 3, 3)]
    docs = spark.createDataFrame(rows, ddl)
    assert sorted(map(tuple, s.keep_one(docs).collect())) == sorted(rows[:2])
    found = s.near_duplicates(docs.select("doc_id", "text", "id", "fp"))
    assert sorted((r["id"], r["component_id"]) for r in found.collect()) == [(5, 5), (5, 5), (6, 5)] and found.select("fp").distinct().count() == 2


def crowd(rng, n, words=120, own=0.12):
    """Texts of one common passage with some words of their own: many are alike by half or three quarters."""
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    for _ in range(n):
        at = rng.randrange(words - 40)
        yield " ".join([*base[:at], *(f"x{rng.randrange(10**6)}" for _ in range(int(words * own * rng.uniform(0.1, 1.6)))), *base[at:]])


def test_a_crowded_bucket_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    held = list(crowd(rng, 260))
    rows, kept = {}, s.materialize

    def counted(df, name):
        done = kept(df, name)
        rows[name] = max(rows.get(name, 0), done.count())
        return done

    monkeypatch.setattr(s, "materialize", counted)
    found = s.keep_one(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == survivors(range(len(held)), held)
    assert rows["apart"] > 0 and max(rows.values()) <= s.BANDS * len(held)


@pytest.mark.parametrize("group", [1 << 22, 2000])
def test_links_of_a_bucket_by_jaccard(spark, monkeypatch, group):
    monkeypatch.setattr(s, "GROUP", group)  # 2000: some ten parts
    rng = random.Random(3)
    held = list(crowd(rng, 90, 200))
    docs = spark.createDataFrame(list(enumerate(held)), "t long, text string")
    rows = [(1, i, 100 + i, len(shingles(x)), (0, i % 60, i % 60)) for i, x in enumerate(held)]
    buckets = spark.createDataFrame(rows, "k long, t long, fp long, n long, root struct<k: int, v: long, f: long>")
    edges = [(r["a"] - 100, r["b"] - 100) for r in s.similar_in_buckets(buckets, docs, 5, 0.8).collect()]
    want = [(i, j) for i, j in itertools.combinations(range(90), 2) if jaccard(held[i], held[j]) >= 0.8]

    def close(pairs):
        at = [i % 60 for i in range(90)]
        for i, j in pairs:
            at = [at[i] if x == at[j] else x for x in at]
        return [at.index(x) for x in at]

    assert want and all(jaccard(held[i], held[j]) >= 0.8 for i, j in edges) and close(edges) == close(want)
    assert group < 1 << 22 or len(edges) < 60


def test_only_wanted_texts_are_moved(spark):
    """They are picked by a bitmap before anything is dealt out, whatever may be broadcast."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(f"text {i}",) for i in range(4000)] * 2, "text string").select(F.xxhash64("text").alias("t"), "text")
    wanted = docs.where("text LIKE '%7'").select("t").distinct()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = s.texts_of(wanted, docs)
        assert sorted(r["text"] for r in got.collect()) == sorted(f"text {i}" for i in range(7, 4000, 10))
        plan = got._jdf.queryExecution().executedPlan().toString()  # the last step comes first
        assert plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_dense_graphs_shrink_to_their_nodes_at_once(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(c * 1000 + rng.randrange(200), c * 1000 + rng.randrange(200)) for c in range(2) for _ in range(6000)]
    sizes, kept = [], s.materialize

    def counted(df, name):
        done = kept(df, name)
        sizes.append(done.count())
        return done

    monkeypatch.setattr(s, "materialize", counted)
    found = {r["node"]: r["root"] for r in s.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p}
    assert {x: found.get(x, x) for x in nodes} == {x: min(y for y in nodes if y // 1000 == x // 1000) for x in nodes}
    assert sizes[0] > 8000 and max(sizes[1:]) <= len(nodes)
