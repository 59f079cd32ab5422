from ivmspark.llm import lines as l

from .conftest import SF, oracle, rows, sf_dir


def brute(held, ratio=l.RATIO, least=l.LEAST):
    pages, seen = {}, {}
    for r in held:
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for x in set((r["text"] or "").split("\n")) - {""} if r["text"] is not None else ():
            seen[r["source"], x] = seen.get((r["source"], x), 0) + 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return sorted([(r["doc_id"], r["text"] and "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in drop)) for r in held], key=str), drop


def test_against_plain_python(spark, edge, small):
    for df in (edge, small):
        want, drop = brute(df.collect())
        assert sorted(map(tuple, l.drop_boilerplate(df).select("doc_id", "text").collect()), key=str) == want
        assert drop or df is small
    kept = {r["doc_id"]: r["text"] for r in l.drop_boilerplate(edge).collect()}
    assert kept[1] is None and kept[2] == "" and kept[6] == "" and kept[5].endswith("shared line")


def test_the_join_without_broadcast_is_the_same(spark, small, monkeypatch):
    want = rows(l.drop_boilerplate(small))
    monkeypatch.setattr(l, "BROADCAST", -1)
    assert rows(l.drop_boilerplate(small)) == want


def test_query_is_its_sql(spark, edge, small, empty, tmp_path):
    assert rows(l.op4_line_dedup(spark, SF)) == oracle(l.OP4_SQL, documents=small)
    assert rows(l.op4_line_dedup(spark, sf_dir(edge, tmp_path / "a"))) == oracle(l.OP4_SQL, documents=edge)
    assert l.op4_line_dedup(spark, sf_dir(empty, tmp_path / "b")).count() == 0


def test_columns_stay(spark, small):
    df = small.selectExpr("*", "1 AS host", "2 AS line", "3 AS pages", "4 AS `a.b`")
    kept = l.drop_boilerplate(df)
    assert kept.columns == df.columns and {(r["host"], r["a.b"]) for r in kept.collect()} == {(1, 4)}


def test_a_small_hosts_footer_goes_and_its_lone_lines_stay(spark):
    docs = spark.createDataFrame([(i, f"page {i} of this\n" + ("the footer" if i < 4 else "an ending"), "host") for i in range(6)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in l.drop_boilerplate(docs).collect()} == {i: f"page {i} of this" for i in range(6)}
