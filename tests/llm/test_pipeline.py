import collections
import math

import corpus_pipeline as c
from ivmspark.llm import langid, pieces

from .conftest import SF
from .test_langid import brute as language
from .test_lines import brute as without_boilerplate
from .test_simhash import survivors


def words(text):
    return len((text or "").encode().split())


def test_run_against_plain_python(spark, small):
    """All five stages in turn, each by a plain version of its own over what the one before kept."""
    docs = [r.asDict() for r in small.collect()]
    samples = langid.training_sample(small)
    kept = [d for d in docs if language(samples, d["text"] or "")[0] != "und"]
    assert 0 < len(kept) <= len(docs)
    frame = spark.createDataFrame([tuple(d[x] for x in small.columns) for d in kept], small.schema)
    lined = dict(without_boilerplate(frame.collect())[0])
    stay = set(survivors(list(lined), list(lined.values())))
    sources = {d["doc_id"]: d["source"] for d in kept if d["doc_id"] in stay}
    got = c.run(spark, SF).collect()
    library = __import__("sentencepiece").SentencePieceProcessor(model_file=__import__("public_tokenizers").path(pieces.MODEL))
    ids = {i: library.encode(lined[i], num_threads=1) for i in stay}
    times = collections.Counter(r["doc_id"] for r in got)
    assert set(times) <= stay and all(r["ids"] == ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in got)
    # each source's words come near its target, and each document's copies are its rate rounded down or up
    size, names = collections.Counter(), sorted({str(x) for x in sources.values()})
    for i, x in sources.items():
        size[str(x)] += words(lined[i])
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:
        each = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if weight[x] * each >= 2 * size[x]}
        if not full:
            break
        for x in full:
            target[x] = 2 * size[x]
            left -= target[x]
        open_ -= full
    target |= {x: weight[x] * each for x in open_}
    taken = collections.Counter()
    for i, x in sources.items():
        rate = target[str(x)] / size[str(x)] if size[str(x)] else 0
        assert math.floor(rate) <= times[i] <= math.ceil(rate), (i, rate, times[i])
        taken[str(x)] += times[i] * words(lined[i])
    largest = max(map(words, lined.values()))
    assert all(abs(taken[x] - target[x]) <= 2 * largest for x in names)


def test_stages_keep_the_columns(spark, small):
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, small, SF).columns == small.columns
    assert c.ORACLE_SQL is None and [n for n, _ in c.STAGES][2] == "SimHash near-dedup"


def test_edges_pass_through(spark, edge, empty, tmp_path):
    """Nulls, empty texts, repeated rows, a long text, and columns whose names clash with the stages' own."""
    more = edge.selectExpr("*", "1 AS ids", "2 AS host", "3 AS `a.b`", "4 AS n_tokens", "5 AS id", "6 AS size", "7 AS fp", "8 AS line")
    more.write.parquet(str(tmp_path / "edge" / "documents.parquet"))
    done = c.run(spark, str(tmp_path / "edge"))
    assert done.columns == [x for x in more.columns if x != "text"] + ["n_tokens_1", "ids_1"]
    rows = done.collect()
    assert rows and all((r["ids"], r["host"], r["a.b"], r["n_tokens"], r["id"], r["size"], r["fp"], r["line"]) == (1, 2, 3, 4, 5, 6, 7, 8) and len(r["ids_1"]) == r["n_tokens_1"] for r in rows)
    assert {r["doc_id"] for r in rows} <= {r[0] for r in edge.select("doc_id").collect()} - {1, 2, 4, 12}  # no letters there
    empty.write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert c.run(spark, str(tmp_path / "empty")).count() == 0
