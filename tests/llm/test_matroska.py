import hashlib
import random
import zlib

import pytest

from ivmspark.llm import matroska as m

from .conftest import SF, sf_dir


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 4096, 4160, 131072, 131136, 400_000])
def test_round_trip(n):
    payload = m.payload_of(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and len(payload) >= 64 and len(payload) - n < 64 + (n == 0)
    back, p = m.read_back(m.mux(payload))
    assert back == payload and len(p.rows) == -(-len(payload) // m.FRAME)
    assert [r[2] for r in p.rows] == [i * m.FRAME_MS for i in range(len(p.rows))]
    assert [c for _, _, c in p.cues] == p.clusters and p.tracks[1]["codec"] == "A_PCM/INT/LIT" and p.tracks[1]["bits"] == 8


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacings(lacing):
    frames = [b"a" * 300] if not lacing else [b"a" * 300] * 4 if lacing == 2 else [b"a" * 300, b"b", b"c" * 255, b"d" * 510, b"", b"e" * 70000]
    block = m.simple_block(3, -5, frames, lacing)
    data = m._HEADER + m.element(m.SEGMENT, m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 100) + block))
    p = m.parse(data)
    assert [data[o : o + n] for _, _, _, o, n, _, _ in p.rows] == frames
    assert p.rows[0][0] == 3 and p.rows[0][2] == 95 and p.rows[0][6] == m.LACINGS[lacing]


def test_unknown_sizes_groups_and_foreign_elements():
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\x00\x01\x00xyz") + m.uint(m.REFERENCE_BLOCK, 1))
    cluster = m.CLUSTER.to_bytes(4, "big") + unknown + m.uint(m.TIMESTAMP, 7) + m.element(0xEC, b"void") + group
    data = m._HEADER + m.SEGMENT.to_bytes(4, "big") + unknown + cluster + cluster
    p = m.parse(data)
    assert [(r[1], r[2], r[5]) for r in p.rows] == [(0, 8, False), (1, 8, False)] and [data[r[3] : r[3] + r[4]] for r in p.rows] == [b"xyz"] * 2


def test_one_frame_in_a_lace():
    for lacing in (1, 2, 3):
        block = m.element(m.SIMPLE_BLOCK, m.vint(1) + b"\x00\x00" + bytes([0x80 | lacing << 1, 0]) + b"frame")
        data = m._HEADER + m.element(m.SEGMENT, m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 0) + block))
        p = m.parse(data)
        assert [data[r[3] : r[3] + r[4]] for r in p.rows] == [b"frame"]


def test_any_bytes_give_packets_or_an_error(spark):
    """Every byte of a small file, changed, and its every prefix: rows or an error, never a dead task."""
    good = m.mux(m.payload_of(b"seven" * 300))
    rng = random.Random(8)
    bad = [good[:i] + bytes([rng.randrange(256)]) + good[i + 1 :] for i in range(len(good) - len(b"seven" * 300))] + [good[:i] for i in range(0, len(good), 7)]
    short = m._HEADER + m.element(m.SEGMENT, m.element(m.INFO, m.element(m.DURATION, b"\x00\x01")))
    found = m.packet_table(spark.createDataFrame([(i, x) for i, x in enumerate([short, *bad])], "id long, `media.x` binary"), media_column="media.x").collect()
    assert [r["error"] for r in found if r["id"] == 0] == ["a float of 2 bytes at byte " + str(len(short) - 2)]
    assert {r["id"] for r in found} >= {r for r in range(len(good), len(bad))} and all((r["error"] is None) != (r["offset"] is None) for r in found)


def plain_feature(payload):
    """What op1's feature says of a payload, from the way it is laid out."""
    frames = [payload[i : i + m.FRAME] for i in range(0, len(payload), m.FRAME)]
    span = m.LACED * m.BLOCKS
    kinds = {}
    for c in range(0, len(frames), span):
        cluster = frames[c : c + span]
        for b in range(0, len(cluster), m.LACED):
            block = cluster[b : b + m.LACED]
            kind = "none" if len(block) == 1 else "fixed" if len(block[-1]) == m.FRAME else "ebml" if len(block) % 2 else "xiph"
            kinds[kind] = kinds.get(kind, 0) + len(block)
    n = -(-len(frames) // span)
    laced = ",".join(f"{k}:{kinds[k]}" for k in m.LACINGS if k in kinds)
    return (
        f"tracks=1;clusters={n};packets={len(frames)};cues={n};cues_ok=1;laced={laced};last_ms={64 * (len(frames) - 1)};"
        f"duration_ms={len(payload) / 8:g};sum={sum(payload)};peak={max(payload)};zeros={payload.count(0)}"
    )


def test_damage():
    good = m.mux(m.payload_of(b"x" * 5000))
    for bad in (b"", b"nothing", good[: len(good) // 2], good[:-1]):
        with pytest.raises((ValueError, IndexError)):
            m.parse(bad)


def test_packet_table(spark, edge):
    media = m.with_media(edge.where("doc_id = 9"))
    found = m.packet_table(media).orderBy("offset").collect()
    assert sum(r["size"] for r in found) == 150016 and found[0]["error"] is None
    bad = m.packet_table(spark.createDataFrame([(1, b"junk"), (2, None)], "id long, media binary")).collect()
    assert len(bad) == 2 and all(r["error"] for r in bad)


def test_query(spark, edge, empty, tmp_path):
    def check(df, folder):
        got = {(r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["payload_bytes"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in m.op1_matroska(spark, folder).collect()}
        want = set()
        for r in df.collect():
            p = m.payload_of((r["text"] or "").encode())
            want.add((r["doc_id"], len((r["text"] or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p), len(m.mux(p)), hashlib.sha256(m.mux(p)).hexdigest(), plain_feature(p)))
        assert got == want

    check(edge, sf_dir(edge, tmp_path / "a"))
    check(spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert m.op1_matroska(spark, sf_dir(empty, tmp_path / "b")).count() == 0
    by_text = {}
    for r in m.op1_matroska(spark, str(tmp_path / "a")).collect():
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
