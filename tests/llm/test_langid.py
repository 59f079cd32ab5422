import itertools
import math
import zlib

from ivmspark.llm import langid as g

from .conftest import sf_dir

DOCS = "/root/testdata/sf0.01"


def longest(text, word):
    """Phrases by definition: from each place, the longest piece of the word that the text has."""
    n = i = 0
    while i < len(word):
        k = 1
        while i + k < len(word) + 1 and word[i : i + k] in text:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_automaton_against_its_definition():
    text = " the cat that thatched the hat on the mat banana bandana "
    a = g.SuffixAutomaton(text)
    for word in (" the ", " hatband ", " zzz ", " bananas ", "t", " thatthat ", "xhex", " "):
        assert a.phrases(word) == longest(text, word), word


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    said = [r for r in g.op10_langid(spark, DOCS).collect()]
    assert len(said) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in said)
    out = [r for r in said if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in said)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    a = g.training_sample(docs)
    b = g.training_sample(docs.where(~g.held_out("doc_id")))
    assert a == b and set(a) == {"de", "en", "es", "fr"} and all(len(x) <= g.LETTERS for x in a.values())


def test_edges(spark, edge, empty, tmp_path):
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in g.op10_langid(spark, sf_dir(edge, tmp_path / "a")).collect()}
    assert said[1] == said[2] == said[4] == said[12] == ("und", 0.0)
    assert said[9][0] in ("en", "fr")
    assert g.op10_langid(spark, sf_dir(empty, tmp_path / "b")).count() == 0
    unlabelled = edge.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert {r["lang_pred"] for r in g.op10_langid(spark, sf_dir(unlabelled, tmp_path / "c")).collect()} == {"und"}
    assert g.keep_identified(unlabelled).count() == unlabelled.count()


def brute(samples, text):
    """Language, score and phrases a letter and mark by definition: substring search and fractions of bits."""
    words = ["".join(w) for keep, w in itertools.groupby(text.lower(), str.isalpha) if keep]
    if not words:
        return "und", 0.0
    letters = sum(map(len, words))
    bits = [(sum(longest(x[: g.LETTERS], f" {w} ") for w in words) * math.log2(max(g.LEAST, min(g.LETTERS, len(x)))) / letters, i, lang) for i, (lang, x) in enumerate(samples.items())]
    best = sorted(bits)
    return best[0][2], 1 - best[0][0] / best[1][0] if len(best) > 1 else 1.0


def test_predictions_against_their_definition(spark, edge):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text", "lang")
    samples = {lang: x[:4000] for lang, x in g.training_sample(docs).items()}
    odd = [(10**9 + i, t, None) for i, t in enumerate(["½ ² Ⅷ Ⅸ", "Ⅷth ½é", "x_y 3z", "ÀÉÎ Straße ẞ ﬁn", "a" * 50_000, "漢字 the", None, "", "e\u0301te\u0301"])]
    small = docs.where("doc_id % 9 = 0").unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(edge.select("doc_id", "text", "lang").where("length(text) < 1000"))
    text = [(r["doc_id"], r["text"] or "") for r in small.collect() if len(r["text"] or "") < 3000 or r["doc_id"] > 10**8]
    want = sorted((i, *brute(samples, t)) for i, t in text if i is not None)
    got = sorted(map(tuple, g.predict(small.where("doc_id IS NOT NULL"), samples).collect()))
    got = [r for r in got if r[0] in {w[0] for w in want}]
    assert [r[:2] for r in got] == [w[:2] for w in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))
    assert {r[1] for r in got if r[0] == 10**9} == {"und"}


def test_a_script_of_many_letters():
    a = g.SuffixAutomaton("".join(chr(0x4E00 + i * i % 5000) for i in range(20_000)))
    assert sum(map(len, a.next)) < 3 * 20_000  # transitions, not states times letters


def test_one_language():
    assert g.CrossParser({"en": " the cat "}).predict(["cat", "123"])[0][:2] == ("en", 1.0)


def test_stage_keeps_what_can_be_told(spark, edge):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    strange = spark.createDataFrame([(-1, None, "en", "a", 0), (-2, "12 34 !!", "en", "a", 0), (-3, "漢字仮名交文" * 30, "en", "a", 0)], docs.schema)
    kept = g.keep_identified(docs.unionByName(strange))
    assert kept.columns == docs.columns and kept.where("doc_id < 0").count() == 0
    assert kept.count() == docs.count()


def test_word_cache_is_bounded():
    c = g.CrossParser({"en": " the cat sat on a mat ", "xx": " zxq vbn qqq zzz xxx "}, words=2)
    assert [c.predict([x])[0][0] for x in ("the cat sat", "zxq zzz qqq", "mat the cat")] == ["en", "xx", "en"]


def test_a_rare_language_changes_no_other(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").limit(60).coalesce(1)
    rare = spark.createDataFrame([(10**9, "Hello world", "xx", "a", 11)], docs.schema)
    assert not rare.select(g.held_out("doc_id")).first()[0]
    two = docs.unionByName(rare).coalesce(1)
    a, b = g.training_sample(docs), g.training_sample(two)
    assert set(b) - set(a) == {"xx"}
    want, got = ({r["id"]: tuple(r) for r in g.predict(docs, m).collect()} for m in (a, b))
    assert want == got
    assert sorted(r[0] for r in g.keep_identified(two).where("lang <> 'xx'").select("doc_id").collect()) == sorted(r[0] for r in g.keep_identified(docs).select("doc_id").collect())


def test_letters_after_digits_and_in_later_rows_teach(spark):
    late = [(i, "12 34 " * 2000 + "el gato duerme", "es") for i in range(6)]
    blank = [(100 + i, "12 34 !!", "fr") for i in range(60)] + [(200 + i, "le chat dort", "fr") for i in range(6)]
    docs = spark.createDataFrame(late + blank, "doc_id long, text string, lang string").coalesce(1)
    got = g.training_sample(docs, sample=2, letters=30)
    assert set(got) == {"es", "fr"} and "gato" in got["es"] and "chat" in got["fr"] and all(len(x) == 30 for x in got.values())
