import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ivmspark.llm import coder as c
from ivmspark.llm import lengths as n

from .conftest import SF, sf_dir


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(c.TOKENIZER))  # as it comes
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


ODD = ["", " ", "  ", "a  b", "a   b ", " a", "a ", "x\n \ny", "x \n\t y", "it's 's  ", "é 中 文", "a\n b", "a\n  b", "1 2  3", "\0 \0", "a  b", "a  b", "<|endoftext|> x", "word\n\n next \x1c z"]


def test_chunks_give_the_librarys_ids(library, small):
    items = ODD + [r["text"] for r in small.collect()]
    t = c.Tokens(public_tokenizers.path(c.TOKENIZER))
    assert [x.tolist() for x in t.encode(items)] == [library(x) for x in items]
    t.known = dict.fromkeys(map(str, range(c.CHUNKS + 1)), b"") | {" cat": t.known.get(" cat", t.encode([" cat"])[0].tobytes())}
    assert t.encode(["the cat sat"])[0].tolist() == library("the cat sat") and len(t.known) < 10 and len(t.old) > c.CHUNKS


@pytest.mark.parametrize("ids", [[], [5], [0] * 9000, list(range(50257)), np.random.default_rng(1).integers(0, 50257, 20001), [2**27 - 1, 0, 7] * 3000, np.random.default_rng(2).zipf(1.3, 30000) % 50000])
def test_files_round_trip(ids):
    ids = np.asarray(ids, np.int32)
    docs = [(None, len(ids) // 2), (-9, len(ids) - len(ids) // 2), (2**62, 0)]
    got, back = c.unpack(c.pack(docs, ids))
    assert got == docs and (back == ids).all() and len(back) == len(ids)


def bits(ids):
    return 8 * len(c.pack([(1, len(ids))], ids)) / len(ids)


def entropy(counts):
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def test_each_order_pays():
    """Streams that one order alone can tell, beside what an order below it could do at best."""
    rng = np.random.default_rng(3)
    n = 120_000
    flat = rng.integers(0, 256, n)
    assert bits(flat) < 8.8  # nothing to tell: little is lost
    skew = rng.zipf(1.5, n) % 3000
    assert bits(skew) < 1.05 * entropy(np.bincount(skew)) + 1
    # order 0 adapts: each block has ids of its own, all of them equally frequent in the file
    own = (np.arange(n) // c._blocks(n)[0] * 8 + rng.integers(0, 8, n)) % 256
    assert bits(own) < 0.7 * entropy(np.bincount(own))
    # order 1: each id says the next but for one of four
    one = np.zeros(n, np.int64)
    step, pick = rng.integers(0, 200, (200, 4)), rng.integers(0, 4, n)
    for i in range(1, n):
        one[i] = step[one[i - 1], pick[i]]
    assert bits(one) < 0.55 * entropy(np.bincount(one))
    # order 2: two ids say the third, one alone doesn't
    two = [1, 2]
    for i in range(n - 2):
        two.append((two[-1] * 7 + two[-2] * 11) % 17 if i % 97 else int(rng.integers(0, 17)))
    pairs = np.array(two)[:-1] * 17 + np.array(two)[1:]
    assert bits(two) < 0.75 * (entropy(np.bincount(pairs)) - entropy(np.bincount(two)))


def test_damage():
    data = bytearray(c.pack([(1, 9000)], np.arange(9000)))
    for at in (3, 20, 60, len(data) - 50):
        bad = bytearray(data)
        bad[at] ^= 0x41
        with pytest.raises((ValueError, zlib.error)):
            c.unpack(bytes(bad))


def test_ids_out_of_range():
    with pytest.raises(ValueError):
        c.pack([(1, 1)], [-1])


def test_query(spark, edge, small, empty, library, tmp_path, monkeypatch):
    for df, folder in ((edge, sf_dir(edge, tmp_path / "a")), (small, SF)):
        held = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        at, want = 0, []
        for r in held:
            ids = np.array([*library(r["text"]), 2], "<u4")
            want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = sorted(map(tuple, c.op8_token_ids(spark, folder).collect()), key=lambda r: r[1])
        assert got == want
    assert c.op8_token_ids(spark, sf_dir(empty, tmp_path / "b")).count() == 0


def test_ids_themselves(spark, small, library):
    written = c.write_ids(small.limit(20), c.scratch_path(spark, "t"))
    got = {r["doc_id"]: r["ids"] for r in c.read_ids(c.listing(c.materialize(written, "w"))).collect()}
    assert all(got[r["doc_id"]] == [*library(r["text"]), 2] for r in small.limit(20).collect())


def test_length_histogram(spark, edge, small, empty, library, tmp_path):
    for df in (edge, small):
        lens = sorted(len(library(r["text"])) for r in df.collect())
        sums = n.suffix_sums(n.histogram(n.lengths(df)))
        for r in sums.collect():
            limit = r["n_tokens"]
            assert r["docs"] == lens.count(limit) and r["tokens"] == limit * r["docs"] and r["docs_past"] == sum(x > limit for x in lens)
            assert r["tokens_past"] == sum(x for x in lens if x > limit) and r["tokens_cut"] == sum(min(x, limit) for x in lens)
            assert r["docs_upto"] == len(lens) - r["docs_past"] and r["quantile"] == pytest.approx(r["docs_upto"] / len(lens))
        for limit in (0, 1, 37, 500, 10**7):
            assert n.cut_total(sums, limit) == sum(min(x, limit) for x in lens)
        assert n.quantile(sums, 0.5) == lens[-(-len(lens) // 2) - 1]
    assert n.op7_token_lengths(spark, sf_dir(empty, tmp_path / "e")).count() == 0


def test_words_met_are_not_merged_again(monkeypatch):
    """The library isn't asked for each chunk anew: a word met before another mark asks nothing, marks are asked once."""
    t = c.Tokens(public_tokenizers.path(c.TOKENIZER))
    t.encode(["the alphabeta gammadelta"])
    asked, merge, encode = [], getattr(t, "merge", None), t._encode
    monkeypatch.setattr(t, "merge", lambda x: asked.append(x) or merge(x), raising=False)
    monkeypatch.setattr(t, "_encode", lambda items: asked.extend(items) or encode(items))
    t.encode(["the alphabeta. gammadelta,\nThe alphabeta, gammadelta."])
    assert asked == [".", ",", "Ċ", "The", ","]


def test_chunks_cut_further_give_the_librarys_ids(library):
    """Words, marks and white space in every order, each chunk's parts already met or not."""
    rng = np.random.default_rng(5)
    parts = ["the", "The", "don", "'t", "'s", "'", ".", ",\n", ".\n\n", "\n", "\r\n", "\t", "%%%", "42", "²", "Ⅷ", "é", "Ça", "中", "😀", "_", "\x85", "　", "́", "‍", "ª", " ", " ", " "]
    items = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)]
    t = c.Tokens(public_tokenizers.path(c.TOKENIZER))
    assert [x.tolist() for x in t.encode(items)] == [library(x) for x in items]
