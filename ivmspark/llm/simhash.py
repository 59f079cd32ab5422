"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints (64 bits, over 4-word shingles) are made in one narrow map over whole texts. Equal
fingerprints are folded to one node first, so a group of copies of any size is one row from there on.

Candidates come from a *covering* family of bit masks: give bit i a random vector m(i) of r+1 bits; for
each nonzero v of r+1 bits, the mask of v keeps the bits with <m(i), v> = 1. Two nodes that differ in at
most r bits differ in bits whose vectors span at most r dimensions, so some v is orthogonal to all of
them, and under its mask the two are equal: each linked pair shares a bucket in at least one of the
2^(r+1)-1 tables, for certain. Inside a bucket an exact comparison finds the links; it emits a spanning
forest of the bucket's link graph, never its pairs, so components keep every link. A bucket of more than
``BLOCK`` nodes is split by the same masks on further bits (the others can't differ), and what is left
after that is compared in blocks: all of it is exact, and nothing is capped.

Components are found on the links of each node to its smallest neighbour, by alternating large-star and
small-star steps, and so on with the links between these; each step is two group-bys and an equi-join over links
only, written to the shared folder.

The pipeline's stage also links texts of shingle-set Jaccard ``SIMILARITY`` or more, which differ in more
bits than masks can cover. Candidates share one of ``BANDS`` MinHash bands of ``BAND`` values: a pair of
Jaccard 0.8 shares none with probability (1 - 0.8^7)^48, about 1 in 80,000. Each candidate not yet linked is
decided by its exact Jaccard: first all of a bucket against one of it, then, inside each bucket, all that are
still apart; that too emits a bucket's spanning links, never its pairs.

Edge cases: null and empty texts have fingerprint 0 and are linked like any other; a text of any length is
hashed as a whole; repeated rows and ties share a component; rows of one id with texts that don't link are in
components of their own; null ids keep their rows and take part, and the id reported is the smallest that is
not null; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import functools
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SCRATCH, arrow_map, col, materialize, table, utf8

RADIUS = 4
SHINGLE = 4
#: What the pipeline's stage takes: five words, and the largest radius whose tables (255) are still few.
STAGE_RADIUS, STAGE_SHINGLE = 7, 5
#: And texts of this Jaccard of shingles or more, at any radius, found by bands of MinHash values.
SIMILARITY, BANDS, BAND = 0.8, 48, 7
#: A bucket of up to this many nodes is compared at once.
BLOCK = 4096
#: A MinHash bucket's texts are compared in parts of about so many shingles; and the bitmap of wanted texts has
#: 2^WORDS words of 64 bits.
GROUP, WORDS = 1 << 22, 17


# ---- fingerprints -----------------------------------------------------------------------------------


def digests(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 8-byte hashes of a whole text's (UTF-8) shingles, one after another."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and space and TAB to CR only
    if not words:
        return b""
    if len(words) <= shingle:
        return xxhash.xxh64_digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a whole text (UTF-8)."""
    return simhash(digests(text, shingle))


def simhash(h: bytes) -> int:
    import numpy as np

    n = len(h) // 8
    if n < 2:
        return int.from_bytes(h, "big")
    counts = np.zeros(64, np.int64)
    rows = np.frombuffer(h, np.uint8).reshape(n, 8)
    for i in range(0, n, 65536):
        counts += np.unpackbits(rows[i : i + 65536], axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long of the same 64 bits."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = [fingerprint(x, shingle) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x - (x >> 63 << 64) for x in fp], pa.int64())], ["id", "fp"])

    narrow = docs.select(col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text"))
    return arrow_map(narrow, run, "id long, fp long")


# ---- Jaccard of shingles ----------------------------------------------------------------------------


def shingle_set(h: bytes):
    """Sorted distinct uint64."""
    import numpy as np

    return np.unique(np.frombuffer(h, np.uint64))


def bands(shingles) -> list[int]:
    """Signed longs, one for each band of the set's MinHash values; none for an empty set."""
    import numpy as np
    import xxhash

    if not len(shingles):
        return []
    least = None
    for i in range(0, len(shingles), 2048):
        part = (_factors()[:, None] * shingles[None, i : i + 2048]).min(1)
        least = part if least is None else np.minimum(least, part)
    raw, step = least.tobytes(), 8 * BAND
    return [x - (x >> 63 << 64) for x in (xxhash.xxh64_intdigest(raw[i * step : i * step + step], i) for i in range(BANDS))]


@functools.cache
def _factors():
    import numpy as np

    rng = random.Random(11)
    return np.array([rng.getrandbits(64) | 1 for _ in range(BANDS * BAND)], np.uint64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, fp, t, n, bands) of docs (id, text, t): t is the text's hash, n the size of its set of shingles."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            h = [digests(x, shingle) for x in utf8(batch.column(1))]
            sets = [shingle_set(x) for x in h]
            fp = [x - (x >> 63 << 64) for x in map(simhash, h)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), batch.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(bands, sets)), pa.list_(pa.int64()))], ["id", "fp", "t", "n", "bands"])

    return arrow_map(docs, run, "id long, fp long, t long, n long, bands array<long>")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(t, text) of docs (t, text) for the t's of wanted (distinct), one row each. t is a text's hash, so a bitmap of its
    bits, whose size is bounded, is sent to the texts and leaves those at home that it shows not to be
    wanted; the join that follows is exact, and moves little else than the wanted."""
    word = F.shiftrightunsigned("t", 64 - WORDS)
    bits = F.expr("shiftleft(1L, int(t & 63)) | shiftleft(1L, int(shiftright(t, 6) & 63))")
    words = wanted.groupBy(word.alias("w")).agg(F.bit_or(bits).alias("held"))
    maybe = docs.select("t", "text").join(F.broadcast(words), (word == F.col("w")) & (F.col("held").bitwiseAND(bits) == bits))
    # an inner join with distinct rows: a semi-join would be pushed below the bitmap, to all texts
    return maybe.select("t", "text").join(wanted, "t").groupBy("t").agg(F.min("text").alias("text"))


def sets_of(wanted: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(t, s): the sets of shingles, sorted, of the texts whose t's are in wanted; only these are read again."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(digests(x, shingle)).view(np.int64) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["t", "s"])

    return materialize(arrow_map(texts_of(wanted, docs), run, "t long, s array<long>"), "sets")


def similar(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): fingerprints of those of the pairs (ta, tb, fa, fb) whose texts' exact Jaccard is similarity
    or more."""
    sets = sets_of(pairs.selectExpr("explode(array(ta, tb)) AS t").distinct(), docs, shingle)
    both = pairs.join(sets.selectExpr("t AS ta", "s AS sa"), "ta").join(sets.selectExpr("t AS tb", "s AS sb"), "tb")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / (F.size("sa") + F.size("sb") - shared) >= similarity).selectExpr("fa AS a", "fb AS b").distinct()


def links_by_jaccard(sets: list, roots, similarity: float) -> list[tuple[int, int]]:
    """Pairs of indexes of sets of Jaccard similarity or more that connect what all such pairs connect, where
    sets of one root are connected already. Exact: each set is compared with all of other roots that are not
    too large, by a count of what they hold of it."""
    import numpy as np

    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    size, root = sizes[order], np.unique(roots, return_inverse=True)[1][order]
    values, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(size)
    starts, mine, found = ends - size, np.zeros(len(values), bool), []
    for i in range(len(order) - 1):
        upto = int(np.searchsorted(size, size[i] / similarity + 1, "right"))
        if (root[i + 1 : upto] == root[i]).all():
            continue
        own = flat[starts[i] : ends[i]]
        mine[own] = True
        shared = np.add.reduceat(mine[flat[ends[i] : ends[upto - 1]]], starts[i + 1 : upto] - ends[i], dtype=np.int64)
        mine[own] = False
        near = shared / (size[i] + size[i + 1 : upto] - shared) >= similarity
        for j in (np.flatnonzero(near & (root[i + 1 : upto] != root[i])) + i + 1).tolist():
            if root[j] != root[i]:
                found.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return found


def similar_in_buckets(held: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): fingerprints of texts of Jaccard similarity or more that share a bucket: of each bucket as many
    as connect what all its pairs connect, never its pairs. held: (k, t, fp, n, root), rows of a bucket k with
    one root being connected already. A bucket of more than ``GROUP`` shingles is cut into parts, and any two
    of them are a group: no more than two parts are held at once."""
    bucket = Window.partitionBy("k").orderBy("t")
    part = F.floor((F.sum("n").over(bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")) / GROUP)
    cut = held.withColumn("part", part).withColumn("parts", F.max("part").over(Window.partitionBy("k")))
    other = F.when(F.col("parts") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), "parts"), lambda x: x != F.col("part")))
    cut = cut.withColumn("other", F.explode(other))
    cut = cut.select("k", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "t", "fp", F.col("root")["f"].alias("r"))
    sets = sets_of(held.select("t").distinct(), docs, shingle)
    dealt = cut.join(sets, "t").select("k", "i", "j", "fp", "r", "s").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(group):
            if len(group) > 1 and (found := links_by_jaccard([x[2] for x in group], np.array([x[1] for x in group]), similarity)):
                yield pa.RecordBatch.from_arrays([pa.array([group[x[e]][0] for x in found], pa.int64()) for e in (0, 1)], ["a", "b"])

        key, group = None, []
        for batch in batches:
            k, i, j, fp, r = (batch.column(c).to_pylist() for c in range(5))
            flat = batch.column(5)
            values, ends = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
            for x in range(batch.num_rows):
                if (k[x], i[x], j[x]) != key:
                    yield from links(group)
                    key, group = (k[x], i[x], j[x]), []
                group.append((fp[x], r[x], values[ends[x] : ends[x + 1]].copy()))
        yield from links(group)

    return arrow_map(dealt, run, "a long, b long").distinct()


# ---- covering masks ---------------------------------------------------------------------------------


def covering_masks(radius: int, bits: list[int], seed: int) -> list[int]:
    """2^(radius+1)-1 masks over the given bit positions; any set of up to radius of them is missed by one.
    Vectors are dealt evenly in a random order; of several orders, that whose lightest mask keeps the most
    bits, since a mask of few bits has large buckets."""
    rng = random.Random(seed)
    every = list(range(1, 2 ** (radius + 1)))
    best: list[int] = []
    for _ in range(24):
        dealt = rng.sample(every, len(every))
        vectors = [dealt[i % len(dealt)] for i in range(len(bits))]
        rng.shuffle(vectors)
        masks = [sum(1 << b for b, m in zip(bits, vectors) if (m & v).bit_count() & 1) for v in every]
        if not best or min(map(int.bit_count, masks)) > min(map(int.bit_count, best)):
            best = masks
    return best


def links_in_bucket(fps, radius: int, fixed: int, block: int = BLOCK, seed: int = 1):
    """A spanning forest, as (node, smaller node of the same tree) pairs of indexes, of the graph that
    links nodes of a bucket at up to radius differing bits. fps: distinct uint64; all agree on the bits
    of fixed. Exact: a large bucket is split by covering masks on its other bits, and blocks of what
    can't be split further are compared with one another."""
    import numpy as np

    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a: int, b: int) -> None:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    def compare(at, other) -> None:
        near = np.bitwise_count(fps[at][:, None] ^ fps[other][None, :]) <= radius
        for i, row in zip(at.tolist(), near):
            r = root(i)
            for j in other[row].tolist():
                if parent[j] != r and j != i:
                    join(i, j)
                    r = root(i)

    def search(at, known: int, depth: int) -> None:
        if len(at) < 2:
            return
        free = [b for b in range(64) if not known >> b & 1]
        if len(at) <= block or len(free) <= 12 or depth > 3:
            for i in range(0, len(at), 1024):
                for j in range(i, len(at), 4096):
                    compare(at[i : i + 1024], at[j : j + 4096])
            return
        for mask in covering_masks(radius, free, seed + depth):
            key = fps[at] & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    search(at[np.sort(part)], known | mask, depth + 1)

    search(np.arange(len(fps)), fixed, 0)
    return [(i, r) for i in range(len(fps)) if (r := root(i)) != i]


def forest(nodes: DataFrame, radius: int = RADIUS, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(a, b): edges, all of them links' closure, that connect what links at up to radius bits connect.
    nodes: distinct fp. One shuffle of 2^(radius+1)-1 small rows a node."""
    masks = covering_masks(radius, list(range(64)), seed)
    every = F.array(*[F.lit(m - (m >> 63 << 64)) for m in masks])
    keyed = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"))
    bucket = F.col("fp").bitwiseAND(F.get(every, F.col("t")))
    # only the table's number and the node are moved; the bucket is worked out on either side
    dealt = keyed.repartition(F.col("t"), bucket).select("t", bucket.alias("k"), "fp").sortWithinPartitions("t", "k")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(t, group):
            fps = np.sort(np.concatenate(group)).view(np.uint64) if len(group) > 1 else np.sort(group[0]).view(np.uint64)
            found = links_in_bucket(fps, radius, masks[t], block)
            if not found:
                return None
            ij = np.array(found)
            return pa.RecordBatch.from_arrays([pa.array(fps[ij[:, 0]].view(np.int64)), pa.array(fps[ij[:, 1]].view(np.int64))], ["a", "b"])

        held, kt, kk = [], None, None  # the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(t) != 0) | (k[1:] != k[:-1])) + 1, [len(t)]))
            size = np.diff(cuts)
            for g in np.flatnonzero((size > 1) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == len(size) - 1)).tolist():
                a, b = cuts[g], cuts[g + 1]
                if held and (t[a], k[a]) != (kt, kk):
                    if sum(map(len, held)) > 1 and (out := pairs(kt, held)) is not None:
                        yield out
                    held = []
                if b < len(t):  # it ends here
                    held.append(fp[a:b])
                    if sum(map(len, held)) > 1 and (out := pairs(int(t[a]), held)) is not None:
                        yield out
                    held = []
                else:
                    held.append(fp[a:b].copy())
                    kt, kk = int(t[a]), int(k[a])
        if held and sum(map(len, held)) > 1 and (out := pairs(kt, held)) is not None:
            yield out

    return dealt.mapInArrow(run, "a long, b long")


# ---- components -------------------------------------------------------------------------------------


def _flat(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of each node, of any type with an order, that isn't its component's root. Roots are
    their components' smallest nodes. No step gathers a node's neighbours.

    Each node is tied to its smallest neighbour, which leaves fewer links than nodes, however dense the graph;
    the components of these are found by stars, and links between two of them are all that goes on. A pass at
    least halves the nodes that have links."""
    state, found = materialize(_flat(edges), "edges"), None
    for _ in range(rounds):
        both = state.union(state.selectExpr("b AS a", "a AS b"))
        ties = materialize(_flat(both.groupBy("a").agg(F.min("b").alias("b"))), "edges")
        comp = _stars(ties, rounds)
        if found is not None:  # these nodes are roots of the passes before
            found = _stars(materialize(_flat(found.union(comp).toDF("a", "b")), "edges"), rounds)
        else:
            found = comp
        rest = state
        for end in ("a", "b"):
            rest = rest.join(comp, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
        state = materialize(_flat(rest), "edges")
        if not state.limit(1).count():
            return found
    raise RuntimeError(f"components not settled after {rounds} passes")


def _stars(state: DataFrame, rounds: int) -> DataFrame:
    """components() of distinct edges a > b: alternating large-star and small-star steps until nothing
    changes."""
    seen = None
    for _ in range(rounds):
        both = state.union(state.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS m")
        large = _flat(both.where("b > a").join(least, F.col("a") == F.col("node")).selectExpr("b AS a", "m AS b"))
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = large.join(least, F.col("a") == F.col("node")).selectExpr("explode(array(struct(b AS a, m AS b), struct(a AS a, m AS b))) AS e").select("e.*")
        state = materialize(_flat(small), "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return materialize(state.groupBy("a").agg(F.min("b").alias("root")).selectExpr("a AS node", "root"), "roots")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable by links at up to radius bits and,
    where similarity is given, by links of that Jaccard of shingles or more; then also root_fp, which tells
    components of one component_id apart, and t, the text's hash.

    A node is known by the smallest id that has its fingerprint (none sorts after all ids) and the
    fingerprint, so a component's root is its component_id, and nothing is ever grouped
    or joined by component: one that holds a third of the nodes is as even as any."""
    own = None
    if similarity is None:
        marked = materialize(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    else:
        own = docs.select(col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text"), F.xxhash64(col(text_column).cast("string")).alias("t"))
        signed = materialize(signatures(own, shingle), "fingerprints")
        marked = signed.select("id", "fp", "t")
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    # the fingerprint keeps nodes apart that share an id
    label = F.struct(F.col("least").isNull().cast("int").alias("k"), F.coalesce("least", F.lit(0)).alias("v"), F.col("fp").alias("f"))
    names = nodes.select("fp", label.alias("label"))
    root = F.coalesce("root", "label")

    def labelled(edges: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            edges = edges.join(names.select(F.col("fp").alias(end), F.col("label").alias(f"to_{end}")), end)
        return edges.selectExpr("to_a AS a", "to_b AS b")

    def rooted(comp: DataFrame) -> DataFrame:
        return names.join(comp, F.col("label") == F.col("node"), "left").select("fp", root.alias("root"))

    edges = materialize(forest(nodes.select("fp"), radius).distinct(), "forest")
    if similarity is None:
        named = rooted(components(labelled(edges)))
    else:
        apart = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) > radius
        sized = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-6
        texts = materialize(signed.select("t", "fp", "n").distinct(), "texts")
        # buckets of two texts or more; copies of a text are one row from here on
        rows = signed.select("t", F.explode("bands").alias("k")).distinct()
        bucket = Window.partitionBy("k")
        shared = rows.withColumns({"hub": F.min("t").over(bucket), "c": F.count("*").over(bucket)}).where("c > 1").drop("c")
        shared = materialize(shared, "buckets")
        known = lambda df, t, x: df.join(texts.selectExpr(f"t AS {t}", f"fp AS f{x}", f"n AS n{x}"), t)
        stars = shared.where("t <> hub").select(F.col("t").alias("ta"), F.col("hub").alias("tb")).distinct()
        stars = materialize(known(known(stars, "ta", "a"), "tb", "b").where(apart & sized), "stars")
        edges = edges.union(materialize(similar(stars, own, shingle, similarity), "similar"))
        comp = components(labelled(edges))
        named = materialize(rooted(comp), "named")
        # what shares a bucket and is still apart
        held = shared.join(texts, "t").join(named, "fp").select("k", "t", "fp", "n", "root")
        held = held.withColumns({"lo": F.min("root").over(bucket), "hi": F.max("root").over(bucket)}).where("lo <> hi").drop("lo", "hi")
        more = materialize(similar_in_buckets(materialize(held, "apart"), own, shingle, similarity), "similar")
        if more.limit(1).count():  # the components that were found are stars now
            named = rooted(components(comp.toDF("a", "b").union(labelled(more))))
    named = named.select("fp", F.when(F.col("root")["k"] == 0, F.col("root")["v"]).alias("component_id"), F.col("root")["f"].alias("root_fp"))
    # copies of one text share fp, so this join's left side can be skewed: adaptive execution splits it
    return marked.join(named, "fp", "left").select("id", "fp", "component_id", *["root_fp", "t"][: 2 * (similarity is not None)])


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = STAGE_RADIUS, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents less all but one of each near-duplicate group: the one with the smallest id stays (a
    null id goes only where another of its group has one; of rows with that same id, one stays). Columns
    as they came."""
    groups = materialize(near_duplicates(docs, id_column, text_column, radius, shingle, similarity), "groups")
    # the survivor of a component: its root's id and fingerprint (both may be others' too), the least text
    key, digest, n = f"{SCRATCH}id", f"{SCRATCH}t", f"{SCRATCH}n"
    own = groups.where((F.col("fp") == F.col("root_fp")) & F.col("id").eqNullSafe(F.col("component_id")))
    keep = own.groupBy("id", "fp", "t").agg(F.count("*").alias("n")).groupBy("id", "fp").agg(F.min(F.struct("t", "n")).alias("m")).select(F.col("id").alias(key), F.col("m.t").alias(digest), F.col("m.n").alias(n))
    same = col(id_column).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(col(text_column).cast("string")) == F.col(digest))
    # hashed at every size: ids are no more than a few bytes a document, texts are dealt out once, unsorted
    kept = docs.join(keep.where(f"{n} = 1").hint("shuffle_hash"), same, "left_semi")
    again = keep.where(f"{n} > 1")
    if again.limit(1).count():  # rows that come more than once: one of each
        kept = kept.unionByName(docs.join(again, same, "left_semi").dropDuplicates([id_column, text_column]))
    return kept


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 4 or fewer differing fingerprint bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
