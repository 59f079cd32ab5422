"""Exact top-k search by inner product: a KD-tree for each shard of the vectors.

Vectors are dealt into shards by hash. In a shard, median splits along the widest side give a tree whose
nodes have tight bounding boxes. A query goes down best first: for a box [lo, hi] the score of any vector in
it is at most the sum over components of the larger of q*lo and q*hi, so nodes wait in a heap by that bound,
and the search of a shard ends when the best bound left is below the query's kth score so far.

The kth score is propagated: a query is first searched in one shard, its home; the k results there give a
score that the answer's kth can't be below, and with it the query visits the other shards, where boxes that
can't pass it are never opened. Ties count: a box is dropped only if its bound is below the kth score, and
equal scores go to the smaller id. Scores are exact: in floating point while components are below 2^20,
in Python's numbers beyond.

Queries against all shards is a stated set against all rows, in blocks. A shard's tree is built once, where its
home queries are searched, and is written to the shared folder, as are those queries with their kth scores.
From there on only the names of files move: a task takes one shard's tree and reads the other shards' queries
file by file, so vectors are shuffled once, into shards, and memory is a tree and a file of queries. A task
lists its files in its output rows, so files of lost attempts are never read.

A row is told from others by a number of its own, not by its id: a query's own row takes no part in its
answer, a copy of it does.

Edge cases: vectors that are null, empty or hold a null or non-finite component take no part; vectors of
other lengths aren't compared; repeated rows and ids are candidates each, ordered by score, then id, and a
repeated query row has an answer of its own; null ids take no part; fewer candidates than k give what there
is; an empty table gives no rows; other columns may have any name. Scores too large for a 64-bit number raise
OverflowError.
"""

from __future__ import annotations

import heapq
import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, col, materialize, read_file, scratch_path, table, write_file

K = 20
LEAF = 256
#: Rows of a shard, on average.
SHARD = 16_384
#: Components below this keep products and sums of any usual length exact in 64-bit floating point.
_EXACT = 1 << 20


class KDTree:
    """A tree over integer vectors (rows of a matrix of whole numbers), with their ids and row numbers. Rows
    lie in the order of the leaves; nodes are arrays of bounds, children (-1: a leaf) and places."""

    PARTS = ("ids", "rows", "vectors", "lo", "hi", "kids", "places")

    def __init__(self, ids, rows, vectors, leaf: int = LEAF):
        import numpy as np

        lo, hi, kids, places = [], [], [], []
        order = np.arange(len(ids))

        def build(a: int, b: int) -> int:
            me = len(lo)
            part = vectors[order[a:b]]
            lo.append(part.min(0))
            hi.append(part.max(0))
            kids.append((-1, -1))
            places.append((a, b))
            side = int(np.argmax(hi[me] - lo[me]))
            if b - a > leaf and hi[me][side] > lo[me][side]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, side], half)]
                kids[me] = build(a, a + half), build(a + half, b)
            return me

        if len(ids):
            build(0, len(ids))
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.lo, self.hi, self.kids, self.places = (np.array(x) for x in (lo, hi, kids, places))

    def pack(self) -> dict:
        """The parts as matrices of 64-bit numbers."""
        import numpy as np

        return {k: np.asarray(getattr(self, k)).astype(np.int64) for k in self.PARTS}

    @classmethod
    def unpack(cls, parts: dict, exact: bool) -> KDTree:
        """exact: in Python's numbers, else in floating point."""
        import numpy as np

        self = object.__new__(cls)
        for k in cls.PARTS:
            x = parts[k]
            setattr(self, k, x.astype(object if exact else np.float64) if k in ("vectors", "lo", "hi") else x)
        return self

    def search(self, query, own, k: int, floor=None) -> list[tuple]:
        """Up to k (score, id), best first and smaller ids first, of all but row own whose score is at least
        floor."""
        import numpy as np

        best: list[tuple] = []  # a heap of (score, -id): its first is the worst kept
        if not len(self.ids):
            return best
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        waiting = [(-(up @ self.hi[0] + down @ self.lo[0]), 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            if floor is not None and -bound < floor:
                break
            kids = self.kids[node]
            if kids[0] >= 0:
                bounds = self.hi[kids] @ up + self.lo[kids] @ down
                for c, b in zip(kids.tolist(), bounds.tolist()):
                    if floor is None or b >= floor:
                        heapq.heappush(waiting, (-b, c))
                continue
            a, b = self.places[node]
            scores = self.vectors[a:b] @ query
            fit = np.arange(b - a) if floor is None else np.flatnonzero(scores >= floor)
            if len(fit) > 2 * k + 2:  # the kth of these is a floor; equals of it stay
                kth = np.partition(scores[fit], len(fit) - k - 1)[len(fit) - k - 1]
                fit = fit[scores[fit] >= kth]
            for s, i, row in zip(scores[fit].tolist(), self.ids[a + fit].tolist(), self.rows[a + fit].tolist()):
                if row != own:
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            if len(best) == k and (floor is None or best[0][0] > floor):
                floor = best[0][0]
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _exact(*matrices) -> bool:
    """Whether scores need Python's whole numbers, which are exact at any size and slower."""
    return any(m.size and max(int(m.max()), -int(m.min())) >= _EXACT for m in matrices)


def _by_length(table, *columns: str) -> dict[int, tuple]:
    """An Arrow table of rows with vectors v: for each length of vectors their matrix and the other columns."""
    import numpy as np

    v = table["v"].combine_chunks()
    lengths = np.diff(v.offsets.to_numpy())
    flat = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() :] if len(v) else np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    rest = [table[c].to_numpy() for c in columns]
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = (flat[starts[at][:, None] + np.arange(n)].astype(np.int64), *(x[at] for x in rest))
    return out


def _save(folder: str, kind: str, parts: dict[str, dict]) -> str:
    import numpy as np

    data, name = io.BytesIO(), f"{folder}/{kind}-{uuid.uuid4().hex}.npz"
    np.savez(data, **{f"{n}.{k}": x for n, own in parts.items() for k, x in own.items()})
    write_file(name, [data.getvalue()])
    return name


def _open(name: str) -> dict[int, dict]:
    import numpy as np

    out: dict[int, dict] = {}
    with np.load(io.BytesIO(read_file(name))) as data:
        for k in data.files:
            n, part = k.split(".")
            out.setdefault(int(n), {})[part] = data[k]
    return out


def _answers(tree: dict, asked: dict, k: int, exact: bool) -> list[tuple]:
    """(query row, query id, vec_id, score) of one shard's tree for queries of its length of vectors."""
    import numpy as np

    built, rows = KDTree.unpack(tree, exact), []
    for q, row, i, floor, known in zip(asked["vectors"].astype(object if exact else np.float64), *(asked[c].tolist() for c in ("rows", "ids", "floor", "known"))):
        rows += [(row, i, c, int(s)) for s, c in built.search(q, row, k, floor if known else None)]
    return rows


_FOUND = "query_row long, query_id long, vec_id long, score long"


def _index(folder: str, k: int):
    """A shard's task: its tree is built and written, its home queries answered from it and written with what
    they know."""

    def run(key, candidates, queries):
        import numpy as np
        import pyarrow as pa

        trees, asked, rows = {}, {}, []
        for n, (v, ids, numbers) in _by_length(candidates, "vec_id", "row").items():
            trees[n] = KDTree(ids, numbers, v.astype(object if _exact(v) else np.float64)).pack()
        for n, (v, ids, numbers) in _by_length(queries, "query_id", "row").items():
            asked[n] = {"vectors": v, "ids": ids, "rows": numbers, "floor": np.zeros(len(v), np.int64), "known": np.zeros(len(v), bool)}
            if n in trees:
                found = _answers(trees[n], asked[n], k, _exact(v, trees[n]["vectors"]))
                rows += found
                place = {row: i for i, row in enumerate(numbers.tolist())}
                count = np.zeros(len(v), np.int64)
                least = np.full(len(v), np.iinfo(np.int64).max)
                for row, _, _, s in found:
                    i = place[row]
                    count[i] += 1
                    least[i] = min(least[i], s)
                asked[n] |= {"floor": np.where(count >= k, least, 0), "known": count >= k}
        shard = key[0].as_py()
        tree = _save(folder, "tree", {str(n): x for n, x in trees.items()})
        some = _save(folder, "queries", {str(n): x for n, x in asked.items()}) if asked else None
        out = [(shard, tree, some, None, None, None, None)] + [(shard, None, None, *r) for r in rows]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["shard", "tree", "queries", "query_row", "query_id", "vec_id", "score"])

    return run


def _visit(k: int):
    def run(batches):
        import pyarrow as pa

        at, trees, exact = None, {}, {}
        for batch in batches:
            for tree, queries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tree != at:
                    at, trees = tree, _open(tree)
                    exact = {n: _exact(x["vectors"]) for n, x in trees.items()}
                rows = []
                for n, asked in _open(queries).items():
                    if n in trees:
                        rows += _answers(trees[n], asked, k, exact[n] or _exact(asked["vectors"]))
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vec_id, v): a number of its own for each row, and floor(scale * x) of each component as a long;
    only vectors that take part. To be written before it is used twice."""
    v = col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fit = col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad
    return vectors.where(fit).select(F.monotonically_increasing_id().alias("row"), col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """From (row, vec_id, v) and (row, query_id, v): each query's k best (query_id, rank, vec_id, score). A
    query whose row is one of the vectors' isn't compared with that one; rows of other queries are below 0."""
    spark = vectors.sparkSession
    shards = 1 + vectors.count() // SHARD
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    groups = vectors.select("row", "vec_id", "v", shard).groupBy("shard").cogroup(queries.select("row", "query_id", "v", shard).groupBy("shard"))
    schema = f"shard int, tree string, queries string, {_FOUND}"
    first = materialize(groups.applyInArrow(_index(scratch_path(spark, "kd"), k), schema), "home")
    found = first.where("tree IS NULL").select("query_row", "query_id", "vec_id", "score")
    if shards > 1:
        listed = first.where("tree IS NOT NULL").select("shard", "tree", "queries")
        homes = listed.where("queries IS NOT NULL").select(F.col("shard").alias("home"), "queries")
        pairs = listed.select("shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("home")).where("shard <> home").join(homes, "home")
        # a shard's visits side by side where there are fewer shards than tasks at once
        split = 1 + 2 * spark.sparkContext.defaultParallelism // shards
        pairs = pairs.repartition(shards * split, "shard", F.col("home") % split).sortWithinPartitions("shard", "home")
        found = found.union(arrow_map(pairs.select("tree", "queries"), _visit(k), _FOUND))
    order = W.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    vectors = materialize(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


OP6_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
