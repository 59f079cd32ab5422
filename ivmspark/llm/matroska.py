"""Media columns: Matroska files held in a binary column.

``mux`` turns a payload into a Matroska file (one 8-bit PCM track, laced SimpleBlocks in clusters, cues);
``parse`` reads any Matroska bytes into a packet table: variable-length EBML elements, clusters, all four
lacings and cues become rows of track, timestamp, byte range. Both are pure functions of one value, so the
DataFrame forms are narrow maps: no shuffle, memory of one Arrow batch.

Edge cases: null or empty text gives a payload of 64 zero bytes; a text of any length is one file, held as a
whole in its row; an empty table gives no rows; bytes that are no whole Matroska file raise ValueError in
``parse``, and ``packet_table`` returns one row for them with ``error`` set; null ids stay null, repeated rows
are kept; only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, col, table, utf8

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")

RATE = 8000  # samples a second
FRAME = 512  # samples a packet: 64 ms
LACED = 8  # packets a block
BLOCKS = 32  # blocks a cluster: 16.4 s, inside the signed 16-bit block timestamp
FRAME_MS = FRAME * 1000 // RATE


# ---- writing ----------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """An EBML size of the least width (or the given one); all-ones values mean unknown and are avoided."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, data: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(sizes: list[int], lacing: int) -> bytes:
    """The lace header of a block: frame count less one, then all sizes but the last as the lacing says."""
    head = bytes([len(sizes) - 1])
    if lacing == 1:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == 3:
        out = [vint(sizes[0])]
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            out.append(vint(d + (1 << 7 * w - 1) - 1, w))
        return head + b"".join(out)
    return head


def simple_block(track: int, rel: int, frames: list[bytes], lacing: int = 0) -> bytes:
    body = vint(track) + struct.pack(">hB", rel, 0x80 | lacing << 1)
    return element(SIMPLE_BLOCK, body + (_lace([len(f) for f in frames], lacing) if lacing else b"") + b"".join(frames))


_HEADER = element(
    EBML,
    uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(MAX_ID_LENGTH, 4) + uint(MAX_SIZE_LENGTH, 8)
    + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1)
        + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """The payload's bytes as the 8-bit samples of one track, losslessly; equal payloads, equal files."""
    info = element(
        INFO,
        uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE))
        + element(MUXING_APP, b"ivmspark") + element(WRITING_APP, b"ivmspark"),
    )
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    span = FRAME * LACED * BLOCKS
    for start in range(0, len(payload), span):
        base = start // FRAME * FRAME_MS
        blocks = [uint(TIMESTAMP, base)]
        for b in range(start, min(start + span, len(payload)), FRAME * LACED):
            block = payload[b : min(b + FRAME * LACED, start + span)]
            frames = [block[i : i + FRAME] for i in range(0, len(block), FRAME)]
            # equal packets need no sizes; a short last one is what the two other lacings are for
            lacing = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3 if len(frames) % 2 else 1
            blocks.append(simple_block(1, b // FRAME * FRAME_MS - base, frames, lacing))
        cues.append((base, at))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(
        element(CUES, b"".join(element(CUE_POINT, uint(CUE_TIME, t) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, p))) for t, p in cues))
    )
    return _HEADER + element(SEGMENT, b"".join(parts))


# ---- reading ----------------------------------------------------------------------------------------


@dataclass
class Packets:
    """A file's packet table, tracks and cues. Packets: (track, cluster, timestamp in scale units, offset,
    size, keyframe, lacing)."""

    rows: list[tuple] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, absolute cluster offset
    clusters: list[int] = field(default_factory=list)  # absolute offsets
    scale: int = 1_000_000
    duration: float = 0.0


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """(value, next offset, width); keep leaves the marker in, as ids do; an unknown size is -1."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"EBML number cut short at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep:
        n &= (1 << 7 * width) - 1
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, at + width, width


def _children(data: bytes, at: int, end: int, stop: frozenset = frozenset()):
    """(id, body start, body end) of each element; one of unknown size reaches to the next id in stop, or
    to the end, and is yielded with that as its end."""
    while at < end:
        eid, body, _ = _vint(data, at, keep=True)
        size, body, _ = _vint(data, body)
        to = end if size < 0 else body + size
        if to > end:
            raise ValueError(f"element {eid:#x} at byte {at} passes its parent's end")
        if size < 0 and eid == CLUSTER:
            to = _unknown_end(data, body, end)
        yield eid, body, to
        at = to


def _unknown_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next top-level element."""
    while at < end:
        eid, body, _ = _vint(data, at, keep=True)
        if eid in (CLUSTER, CUES, INFO, TRACKS):
            return at
        size, body, _ = _vint(data, body)
        at = body + size
    return end


def _frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if not lacing:
        return [end - at], at
    if at >= end:
        raise ValueError("lace cut short")
    n = data[at] + 1
    at += 1
    if n == 1:  # a lone frame: no size is coded
        return [end - at], at
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed lace doesn't divide")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            s = 0
            while True:
                b = data[at]
                at += 1
                s += b
                if b < 255:
                    break
            sizes.append(s)
    else:
        s, at, _ = _vint(data, at)
        sizes.append(s)
        for _ in range(n - 2):
            d, at, w = _vint(data, at)
            s += d - ((1 << 7 * w - 1) - 1)
            sizes.append(s)
        sizes = sizes[: n - 1]
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes pass the block's end")
    return sizes, at


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise ValueError(f"a float of {b - a} bytes at byte {a}")
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def parse(data: bytes) -> Packets:
    """All packets, tracks and cues of a Matroska file. Raises ValueError where the bytes are not one."""
    out = Packets()
    if not data:
        raise ValueError("empty file")
    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for eid, seg, seg_end in top:
        if eid != SEGMENT:
            continue
        for eid, a, b in _children(data, seg, seg_end):
            if eid == CLUSTER:
                _cluster(data, a, b, out)
            elif eid == INFO:
                for eid, a2, b2 in _children(data, a, b):
                    if eid == TIMESTAMP_SCALE:
                        out.scale = _number(data, a2, b2)
                    elif eid == DURATION:
                        out.duration = _real(data, a2, b2)
            elif eid == TRACKS:
                for eid, a2, b2 in _children(data, a, b):
                    if eid == TRACK_ENTRY:
                        _track(data, a2, b2, out)
            elif eid == CUES:
                for _, a2, b2 in _children(data, a, b):
                    _cue(data, a2, b2, seg, out)
    return out


def _track(data: bytes, a: int, b: int, out: Packets) -> None:
    t = {"codec": "", "type": 0, "default_ns": 0, "rate": 0.0, "bits": 0}
    number = 0
    for eid, x, y in _children(data, a, b):
        if eid == TRACK_NUMBER:
            number = _number(data, x, y)
        elif eid == CODEC_ID:
            t["codec"] = data[x:y].decode("ascii", "replace")
        elif eid == TRACK_TYPE:
            t["type"] = _number(data, x, y)
        elif eid == DEFAULT_DURATION:
            t["default_ns"] = _number(data, x, y)
        elif eid == AUDIO:
            for eid, p, q in _children(data, x, y):
                if eid == SAMPLING_FREQUENCY:
                    t["rate"] = _real(data, p, q)
                elif eid == BIT_DEPTH:
                    t["bits"] = _number(data, p, q)
    out.tracks[number] = t


def _cue(data: bytes, a: int, b: int, seg: int, out: Packets) -> None:
    time = 0
    for eid, x, y in _children(data, a, b):
        if eid == CUE_TIME:
            time = _number(data, x, y)
        elif eid == CUE_TRACK_POSITIONS:
            track = position = 0
            for eid, p, q in _children(data, x, y):
                if eid == CUE_TRACK:
                    track = _number(data, p, q)
                elif eid == CUE_CLUSTER_POSITION:
                    position = _number(data, p, q)
            out.cues.append((time, track, seg + position))


def _cluster(data: bytes, a: int, b: int, out: Packets) -> None:
    cluster, base = len(out.clusters), 0
    # the cluster's own start: its id has 4 bytes, its size, of 8 bytes at most, lies between
    at = data.rfind(CLUSTER.to_bytes(4, "big"), max(0, a - 12), a)
    out.clusters.append(at)
    for eid, x, y in _children(data, a, b):
        if eid == TIMESTAMP:
            base = _number(data, x, y)
        elif eid == SIMPLE_BLOCK:
            _block(data, x, y, cluster, base, None, out)
        elif eid == BLOCK_GROUP:
            inner = list(_children(data, x, y))
            key = all(i[0] != REFERENCE_BLOCK for i in inner)
            for eid, p, q in inner:
                if eid == BLOCK:
                    _block(data, p, q, cluster, base, key, out)


def _block(data: bytes, x: int, y: int, cluster: int, base: int, key: bool | None, out: Packets) -> None:
    track, at, _ = _vint(data, x)
    if at + 3 > y:
        raise ValueError(f"block cut short at byte {x}")
    rel, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    sizes, at = _frame_sizes(data, at + 3, y, lacing)
    step = out.tracks.get(track, {}).get("default_ns", 0) // max(1, out.scale)
    keyframe = bool(flags & 0x80) if key is None else key
    t = base + rel
    for n in sizes:
        out.rows.append((track, cluster, t, at, n, keyframe, LACINGS[lacing]))
        at += n
        t += step


# ---- DataFrame forms --------------------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def with_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as a Matroska file in a binary column."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(payload_of(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"]
            )

    narrow = docs.select(col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text"))
    return arrow_map(narrow, run, "id long, n_bytes long, media binary")


def packet_table(media: DataFrame, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """One row for each packet: id, track, cluster, timestamp_ns, offset, size, keyframe, lacing, error.
    A value that is null or no Matroska file gives one row that has only id and error."""
    schema = "id long, track int, cluster int, timestamp_ns long, offset long, size long, keyframe boolean, lacing string, error string"

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    p = parse(x or b"")
                    found = [(i, t, c, ts * p.scale, o, n, k, lacing, None) for t, c, ts, o, n, k, lacing in p.rows]
                    if any(abs(r[3]) >= 1 << 63 or r[1] >= 1 << 31 for r in found):
                        raise ValueError("a timestamp or track number that no column holds")
                    rows += found
                except (ValueError, IndexError) as e:
                    rows.append((i, *[None] * 7, str(e)))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return arrow_map(media.select(col(id_column).cast("long").alias("id"), col(media_column).cast("binary").alias("media")), run, schema)


def read_back(data: bytes) -> tuple[bytes, Packets]:
    """The samples of track 1, gathered from the packet table's byte ranges."""
    p = parse(data)
    return b"".join([data[o : o + n] for t, _, _, o, n, _, _ in p.rows if t == 1]), p


def feature(payload: bytes, p: Packets) -> str:
    """What the packet table and the samples say, as one string."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    laces = ",".join(f"{k}:{n}" for k in LACINGS if (n := sum(r[6] == k for r in p.rows)))
    return (
        f"tracks={len(p.tracks)};clusters={len(p.clusters)};packets={len(p.rows)};cues={len(p.cues)};"
        f"cues_ok={int(all(c in p.clusters for _, _, c in p.cues))};laced={laces};last_ms={p.rows[-1][2] if p.rows else 0};"
        f"duration_ms={p.duration:g};sum={int(x.sum(dtype=np.int64))};peak={int(x.max())};zeros={int((x == 0).sum())}"
    )


def media_digest(media: DataFrame) -> DataFrame:
    """From (id, n_bytes, media): what the stored bytes hold, read back through the packet table."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, n, x in zip(*(batch.column(k).to_pylist() for k in range(3))):
                payload, p = read_back(x)
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature(payload, p)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

    return arrow_map(media, run, schema)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document text stored as a Matroska media column and read back."""
    return media_digest(with_media(table(spark, sf_dir, "documents")))
