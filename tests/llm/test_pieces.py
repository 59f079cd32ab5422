import hashlib
import struct
import zlib

import public_tokenizers
import pytest
import sentencepiece

from ivmspark.llm import pieces as p

from .conftest import SF, sf_dir

ODD = ["", " ", "  a  b\tc\n d ", "ﬁ é 中 ½ é ​ <s> </s> <0x41>", "a" * 5000, "中文字" * 2000, " " * 37 + "x", "\n\n\n a\n", "▁▁ ▁a", "hello" * 2000, "😀😀 zz", "the.the,THE!!", "aaaaaaaaaaaaab" * 700]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(p.MODEL))


@pytest.fixture(scope="module")
def machine():
    return p.load(p.MODEL)


def test_is_the_library(library, machine, small):
    for x in ODD + [r["text"] for r in small.collect()]:
        ids = machine.encode(x).tolist()
        assert ids == library.encode(x), x[:50]
        assert machine.decode(ids) == library.decode(ids)


def test_random_texts(library, machine):
    import random

    rng = random.Random(5)
    for _ in range(1500):
        x = "".join(rng.choice("aabcdeeiinnostrth  .,é中\n▁ABZ09") for _ in range(rng.randrange(30)))
        assert machine.encode(x).tolist() == library.encode(x), x


def test_bounds(library):
    t = p.load(p.MODEL)
    t.most = 3
    for x in ("one two three four five", "six seven", "one two three"):
        assert t.encode(x).tolist() == library.encode(x)


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            key = number << 3
            out += (bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])) + bytes([value])
        else:
            n = len(value)
            out += bytes([number << 3 | 2]) + (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])) + value
    return out


def unigram(fallback):
    """A small unigram model, written by hand: the library reads it too."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    pieces += [(x, s, 1) for x, s in (("▁", -2.0), ("a", -3.0), ("b", -3.1), ("c", -3.3), ("ab", -4.0), ("bc", -4.7), ("abc", -8.0), ("▁a", -3.7), ("▁ab", -5.2), ("ca", -5.1))]
    body = b"".join(_message((1, _message((1, x.encode()), (2, s), (3, k)))) for x, s, k in pieces)
    trainer = _message((3, 1), *([(35, 1)] if fallback else []))
    return body + _message((2, trainer), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_models_take_the_cheapest_path(fallback):
    import itertools

    library = sentencepiece.SentencePieceProcessor(model_proto=unigram(fallback))
    t = p.Transducer(unigram(fallback))
    for n in range(1, 6):
        for x in map("".join, itertools.product("abc ", repeat=n)):
            cost = lambda ids: sum(library.get_score(i) for i in ids)
            assert cost(t.encode(x).tolist()) == pytest.approx(cost(library.encode(x))), x
    assert t.encode("axb").tolist() == library.encode("axb")


def test_models_not_compiled():
    with pytest.raises(ValueError):
        p.Transducer(_message((1, _message((1, b"<unk>"), (3, 2))), (3, _message((2, b"map")))))


def test_query(spark, edge, small, empty, library, tmp_path):
    for df, folder in ((edge, sf_dir(edge, tmp_path / "a")), (small, SF)):
        want = []
        for r in df.collect():
            ids = library.encode(r["text"] or "")
            back = library.decode(ids)
            want.append((r["doc_id"], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), hashlib.md5(back.encode()).hexdigest(), back == (r["text"] or "")))
        assert sorted(map(tuple, p.op9_pieces(spark, folder).collect()), key=str) == sorted(want, key=str)
    assert p.op9_pieces(spark, sf_dir(empty, tmp_path / "b")).count() == 0


def test_frames(spark, small, library):
    ids = p.encode_documents(small.limit(15))
    back = {r["id"]: r["text"] for r in p.decode_documents(ids).collect()}
    assert back == {r["doc_id"]: r["text"] for r in small.limit(15).collect()}
    df = p.with_ids(small.limit(5).selectExpr("*", "'x' AS ids", "7 AS extra"))
    assert df.columns == ["doc_id", "lang", "source", "n_chars", "ids", "extra", "n_tokens", "ids_1"]
    assert {r["ids"] for r in df.collect()} == {"x"}
    assert all(r["n_tokens"] == len(r["ids"]) for r in df.collect())
