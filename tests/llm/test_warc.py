import base64
import hashlib
import zlib

import pytest

from ivmspark.llm import warc as w
from ivmspark.llm.common import read_file

from .conftest import SF, oracle, rows, sf_dir

PAGES = [(1, "http://a/\nx", "x"), (2, "u", "x"), (2, "u", "x"), (3, None, None), (None, "u", ""), (4, "v", ""), (None, "z", "x"), (5, "q", "é" * 3_000_000), (6, "r", "y\r\n\r\nWARC/1.1\r\n")]


def brute(held):
    """The last of equal payloads by id (null least) is the response; of equal ids, any one."""
    groups, out = {}, []
    for r in held:
        groups.setdefault((r["html"] or "").encode(), []).append(r["page_id"])
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(i, len(payload), sha, "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(payload), sha, "response", None)]
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert sorted(map(tuple, w.op5_warc(spark, sf_dir(df, tmp_path / "a", "pages")).collect()), key=str) == brute(df.collect())
    assert sorted(map(tuple, w.op5_warc(spark, SF).collect()), key=str) == brute(spark.read.parquet(f"{SF}/pages.parquet").collect())
    for d in (df, spark.read.parquet(f"{SF}/pages.parquet")):
        assert oracle(w.OP5_SQL, pages=d) == brute(d.collect())
    assert rows(w.op5_warc(spark, SF)) == oracle(w.OP5_SQL, pages=spark.read.parquet(f"{SF}/pages.parquet"))
    assert w.op5_warc(spark, sf_dir(df.limit(0), tmp_path / "b", "pages")).count() == 0


def test_every_member_stands_alone(spark, monkeypatch):
    monkeypatch.setattr(w, "ROLL", 3000)
    archives = w.archive(spark.read.parquet(f"{SF}/pages.parquet"))
    held = archives.collect()
    assert sum(r["records"] for r in held) == spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in held[:5]:
        data, at = read_file(r["archive"]), 0
        for line in read_file(r["sidecar"]).decode().splitlines():
            offset, length, kind, _ = line.split()
            assert int(offset) == at and zlib.decompress(data[at : at + int(length)], 31).startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode())
            at += int(length)
        assert at == len(data)
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in w.read_archives(archives).where("record_type = 'response'").collect()}
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert all(given[k] == v for k, v in back.items()) and back


def test_columns_of_any_name_and_what_revisits_refer_to(spark):
    df = spark.createDataFrame([(1, "u", "x", 5), (2, "v", "x", 6)], "page_id long, url string, html string, `payload.digest` int")
    back = {r["page_id"]: r for r in w.read_archives(w.archive(df)).collect()}
    assert back[1]["refers_to"] == 2 and back[1]["refers_to_record"] == back[2]["record"] and back[2]["record"].startswith("<urn:uuid:")


def test_least_payload(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = {r["record_type"] for r in w.read_archives(w.archive(df, least=2)).collect()}
    assert kinds == {"response"}


def test_streams():
    raw = b"".join(w.response("<r>", i, "u", bytes([65 + i % 26]) * (i * 997), "S") for i in range(40))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = z.compress(raw) + z.flush()
    for size in (1, 1000, len(one)):
        if size > 1:
            assert b"".join(w.inflate(one[i : i + size] for i in range(0, len(one), size))) == raw
    bomb = zlib.compressobj(9, zlib.DEFLATED, 31)
    big = bomb.compress(bytes(20_000_000)) + bomb.flush()
    assert max(len(x) for x in w.inflate([big])) <= 1 << 20 and sum(len(x) for x in w.inflate([big])) == 20_000_000
    two = one + one
    assert len(list(w.records(w.inflate([two])))) == 80
    for bad in (one[:-9], one[: len(one) // 2]):
        with pytest.raises(ValueError):
            list(w.records(w.inflate([bad])))
    with pytest.raises(ValueError, match="no WARC"):
        list(w.records([b"HTTP/1.1 200 OK\r\n\r\n"]))


def foreign():
    """An archive by another hand: five kinds of records, loose heads, several gzip members."""
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    make = lambda kind, more, body: (f"WARC/1.0\r\nwarc-type:{kind}\r\n{more}CONTENT-LENGTH:{len(body)}\r\n\r\n").encode("latin-1") + body + b"\r\n\r\n"
    return [
        make("warcinfo", "WARC-Record-ID: <i>\r\nContent-Type: application/warc-fields\r\n", b"software: other\r\n"),
        make("request", "WARC-Record-ID: <q>\r\nWARC-Target-URI: http://a/\r\n", b"GET / HTTP/1.1\r\n\r\n"),
        make("response", "WARC-Record-ID: <r1>\r\nWARC-Target-URI: http://a/\r\n  tail\r\nX-Odd: \xe9\r\n", http + b"same payload"),
        make("metadata", "WARC-Record-ID: <m>\r\n", b"fetchTimeMs: 1"),
        make("response", "WARC-Record-ID: <r2>\r\nWARC-Target-URI: http://b/\r\n", http + b"same payload"),
        make("response", "WARC-Record-ID: <r3>\r\n", b"no http head"),
        make("resource", "WARC-Record-ID: <s>\r\n", b""),
    ]


def test_archives_of_other_writers(spark, tmp_path):
    raw = foreign()
    pack = lambda x: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush()
    (tmp_path / "one.warc.gz").write_bytes(pack(b"".join(raw)))
    (tmp_path / "many.warc.gz").write_bytes(b"".join(pack(b"".join(raw[i : i + 2])) for i in range(0, len(raw), 2)))
    for name in ("one", "many"):
        files = spark.createDataFrame([(str(tmp_path / f"{name}.warc.gz"),)], "file string")
        back = w.read_archives(w.normalise_archives(files)).orderBy("offset").collect()
        assert [r["record_type"] for r in back] == ["warcinfo", "request", "revisit", "metadata", "response", "response", "resource"]
        assert [r["record"] for r in back] == ["<i>", "<q>", "<r1>", "<m>", "<r2>", "<r3>", "<s>"]
        assert (back[2]["refers_to_record"], back[2]["payload_bytes"], back[2]["url"]) == ("<r2>", 12, "http://a/ tail")
        assert [bytes(back[i]["payload"]) for i in (0, 1, 4, 5, 6)] == [b"software: other\r\n", b"GET / HTTP/1.1\r\n\r\n", b"same payload", b"no http head", b""]
        archive = w.normalise_archives(files).first()
        data = read_file(archive["archive"])
        whole = [zlib.decompress(data[int(a) : int(a) + int(b)], 31) for a, b, *_ in (x.split() for x in read_file(archive["sidecar"]).decode().splitlines())]
        assert [x for i, x in enumerate(whole) if i != 2] == [x for i, x in enumerate(raw) if i != 2]  # byte by byte
