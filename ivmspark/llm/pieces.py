"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three machines. N, the normaliser, writes spaces as the meta mark and adds
the dummy prefix. L, the lexicon, is a trie over characters whose final arcs write piece ids at a weight; a
character that no piece covers has a fallback arc, which writes its bytes' ids (or the unknown id). C, for
merge models, is an acceptor of piece sequences: its state is the last piece, and an arc to the next is
there when the merges, run on the two pieces' characters alone, leave exactly these two.

An input is composed with N, L and C, and the shortest path in the tropical semiring is the encoding:
- unigram models: L's weights are minus the scores, C accepts all: the shortest path is the best cut;
- merge (BPE) models: a sequence is what the merges make of the text if and only if each piece is what they
  make of its own characters and each neighbouring pair is left a pair, since until a merge crosses a
  boundary for the first time each side runs as if alone. So C leaves one finite path, and it is the
  library's encoding, ties and all. A piece weighs 1.

Composition is lazy, and the path is found by relaxing states (place, last piece) from left to right. L alone
says what the rest of a text costs at least; states that can't be on a path of a given cost are not made, and
that cost is raised from the least that L allows until a path is there. No piece spans certain character
pairs, the meta mark after a letter above all; texts are cut there, and each task keeps the paths of
chunks it has met, two generations of ``CHUNKS``. A chunk longer than ``LONG`` is cut at every pair that no piece spans.

Edge cases: null and empty texts encode to no ids; repeated rows each get theirs; an empty table gives no
rows; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import SCRATCH, arrow_map, col, free, resident, table, texts

MODEL = "piece_bpe_32k.model"
CHUNKS = 500_000
LONG = 4096
META = "▁"

# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""

    def number(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return n, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            n, at = number(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Normaliser:
    """N: from each state, what a space and what any other character writes, and the state after."""

    START, INSIDE, GAP = range(3)

    def __init__(self, prefix: bool, squeeze: bool):
        mark = META if prefix else ""
        if squeeze:  # spaces at the ends go, runs of them are one
            self.space = ("", self.START), ("", self.GAP), ("", self.GAP)
            self.other = (mark, self.INSIDE), ("", self.INSIDE), (META, self.INSIDE)
        else:
            self.space = (mark + META, self.INSIDE), (META, self.INSIDE), (META, self.INSIDE)
            self.other = (mark, self.INSIDE), ("", self.INSIDE), ("", self.INSIDE)

    def run(self, text: str, state: int = START) -> str:
        out = []
        for c in text:
            write, state = self.space[state] if c == " " else self.other[state]
            out.append(write if c == " " else write + c)
        return "".join(out)


class Transducer:
    """A compiled model: encode and decode."""

    def __init__(self, data: bytes, chunks: int = CHUNKS):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        kind, fallback, prefix, squeeze, charsmap = UNIGRAM, 0, 1, 1, b""
        for n, v in _fields(data):
            if n == 1:
                piece = dict(_fields(v))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif n == 2:
                spec = dict(_fields(v))
                kind, fallback = spec.get(3, UNIGRAM), spec.get(35, 0)
            elif n == 3:
                spec = dict(_fields(v))
                charsmap, prefix, squeeze = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1)
        if charsmap or kind not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds:
            raise ValueError("only unigram and BPE models with an identity character map and no user-defined pieces are compiled")
        self.bpe, self.prefix, self.squeeze = kind == BPE, bool(prefix), bool(squeeze)
        self.unknown = self.kinds.index(UNKNOWN)
        byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_ids = [byte_id[b] for b in range(256)] if fallback and len(byte_id) == 256 else None
        words = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.words = words
        self.penalty = UNKNOWN_PENALTY - min([self.scores[i] for i in words.values()], default=0.0)
        # L: nodes are dicts of characters; what a node writes is under the empty string
        self.trie: dict = {}
        spanned = set()
        for p, i in words.items():
            if self.bpe and self._merged(p) != [p]:  # no path of C has it
                continue
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = i
            spanned.update(p[j : j + 2] for j in range(len(p) - 1))
        self.spanned = spanned
        self.cuts = self._cutter(spanned)
        self.fits: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.normaliser = Normaliser(self.prefix, self.squeeze)
        self.most = chunks
        self.known: list[dict[str, bytes]] = [{}, {}]  # by N's state: START for a text's first chunk, INSIDE
        self.old: dict[str, bytes] = {}  # the generation before, of INSIDE
        self.fallback: dict[int, tuple[int, ...]] = {}  # what a fallback arc writes, by its label
        raw = [p.replace(META, " ").encode() if k in (NORMAL, BYTE) else b"" for p, k in zip(self.pieces, self.kinds)]
        for b, i in byte_id.items():
            raw[i] = bytes([b])
        raw[self.unknown] = " ⁇ ".encode()
        self.raw = raw

    def _cutter(self, spanned: set[str]):
        """Chunks no path crosses: a run of marks with what follows, if no piece has a mark after another
        character, and line breaks by themselves, if no piece joins them to anything."""
        if self.squeeze or any(s[1] == META != s[0] for s in spanned):
            return None
        alone = not any("\n" in s for s in spanned)
        mark = f" {META}"  # before N either is a mark
        return re.compile(f"[{mark}]+[^{mark}\n]*|\n+|[^{mark}\n]+" if alone else f"[{mark}]*[^{mark}]+|[{mark}]+").findall

    # ---- C: labels are piece ids, or -1 - code point for a character that no piece is

    def _spelled(self, label: int) -> str:
        return self.pieces[label] if label >= 0 else chr(-1 - label)

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored pair first, the leftmost of equals."""
        parts, words, scores = list(text), self.words, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = words.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: int, b: int) -> bool:
        x, y = self._spelled(a), self._spelled(b)
        self.fits.setdefault(a, {})[b] = ok = self._merged(x + y) == [x, y]
        self.pairs += 1
        return ok

    # ---- input o L o C

    def _arcs(self, text: str, i: int) -> list[tuple[int, int, float]]:
        """(end, label, weight) of L's arcs from a position."""
        node, j, out, n = self.trie.get(text[i]), i + 1, [], len(text)
        while node is not None:
            label = node.get("")
            if label is not None:
                out.append((j, label, -self.scores[label]))
            if j == n:
                break
            node, j = node.get(text[j]), j + 1
        if not out or out[0][0] != i + 1:
            out.append((*self._spare(text[i], i + 1), self.penalty))
        return out

    def _spare(self, char: str, end: int) -> tuple[int, int]:
        """(end, label) of the fallback arc of a character that no piece is."""
        label = -1 - ord(char)
        if self.byte_ids and label not in self.fallback:
            self.fallback[label] = tuple(self.byte_ids[b] for b in char.encode())
        return end, label

    def path(self, text: str) -> list[int]:
        """Labels of the shortest path through L and C."""
        return self._merges(text) if self.bpe else self._scores(text)

    def _scores(self, text: str) -> list[int]:
        """Where C accepts all, it has one state: a cost and an arc back for each place."""
        best: list = [None] * (len(text) + 1)
        best[0] = (0.0, 0, 0)
        for i in range(len(text)):
            if best[i]:
                for j, label, weight in self._arcs(text, i):
                    cost = best[i][0] + weight
                    if best[j] is None or cost < best[j][0]:
                        best[j] = (cost, i, label)
        out, i = [], len(text)
        while i:
            _, i, label = best[i]
            out.append(label)
        return out[::-1]

    def _merges(self, text: str) -> list[int]:
        """States are (place, last piece); weights are 1, so costs are counted as what they have over the
        least that L alone allows, and no state over the limit is made."""
        n, fits, trie = len(text), self.fits, self.trie
        arcs: list = [None] * n  # (end, label) from each place
        rest = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            node, j, own, least = trie.get(text[i]), i + 1, [], n
            while node is not None:
                label = node.get("")
                if label is not None:
                    own.append((j, label))
                    if rest[j] < least:
                        least = rest[j]
                if j == n:
                    break
                node = node.get(text[j])
                j += 1
            if not own or own[0][0] != i + 1:
                own.append(self._spare(text[i], i + 1))
                least = min(least, rest[i + 1])
            arcs[i], rest[i] = own, 1 + least
        limit = 0
        while True:
            states: list = [None] * (n + 1)
            states[0] = {None: (0, 0, None)}  # last piece: excess, place and piece before
            for i in range(n):
                here = states[i]
                if here is None:
                    continue
                least = 1 - rest[i]
                for j, label in arcs[i]:
                    more = least + rest[j]
                    if more > limit:
                        continue
                    there = states[j]
                    for last, before in here.items():
                        excess = before[0] + more
                        if excess > limit or there and label in there and there[label][0] <= excess:
                            continue
                        if last is not None:
                            known = fits.get(last)
                            ok = known.get(label) if known else None
                            if ok is None:
                                ok = self._fit(last, label)
                            if not ok:
                                continue
                        if there is None:
                            there = states[j] = {}
                        there[label] = (excess, i, last)
            if states[n]:
                break
            limit = 2 * limit + 1
        out, i = [], n
        label = min(states[n], key=lambda x: states[n][x][0]) if n else None
        while i:
            out.append(label)
            _, i, label = states[i][label]
        return out[::-1]

    def _ids(self, raw: str, state: int) -> bytes:
        """The ids of a chunk, as N leaves it from a state."""
        chunk = self.normaliser.run(raw, state)
        out: list[int] = []
        if len(chunk) > LONG:
            at = [0, *(i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.spanned), len(chunk)]
            labels = chain.from_iterable(self.path(chunk[a:b]) for a, b in zip(at, at[1:]))
        else:
            labels = self.path(chunk)
        for label in labels:
            if label >= 0:
                out.append(label)
            elif self.byte_ids:
                out += self.fallback[label]
            elif not out or out[-1] != self.unknown or self.bpe:
                out.append(self.unknown)
        return array("I", out).tobytes()

    def encode(self, text: str):
        """The ids of a whole text, as an array of 32-bit numbers."""
        import numpy as np

        if sum(map(len, self.known)) > self.most:
            self.old, self.known = self.known[1], [{}, {}]
        if self.pairs > 2 * self.most:
            self.fits, self.pairs = {}, 0
        if len(self.fallback) > self.most:
            self.fallback = {}
        chunks = self.cuts(text) if self.cuts else [text]
        if not chunks:
            return np.empty(0, np.uint32)
        (first, known), old = self.known, self.old
        head = chunks[0]
        if head not in first:
            first[head] = self._ids(head, Normaliser.START)
        chunks[0] = ""
        known[""] = b""
        out = list(map(known.get, chunks))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    c = chunks[i]
                    ids = known.get(c)
                    if ids is None:
                        known[c] = ids = old[c] if c in old else self._ids(c, Normaliser.INSIDE)
                    out[i] = ids
        out[0] = first[head]
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids) -> str:
        """The text of a sequence of ids: pieces and fallback bytes joined, the dummy prefix dropped."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def load(model: str) -> Transducer:
    """The transducer of a public model file."""
    import public_tokenizers

    with open(public_tokenizers.path(model), "rb") as f:
        return Transducer(f.read())


def compiled(model: str) -> Transducer:
    """As load, kept by the worker."""
    return resident(("pieces", model), lambda: load(model))


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids): every whole text's ids as an array."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = compiled(model)
        for batch in batches:
            ids = [t.encode(x) for x in texts(batch.column(1))]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["id", "ids"])

    return arrow_map(docs.select(col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text")), run, "id long, ids array<int>", model=True)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(id, text) of (id, ids)."""

    def run(batches):
        import pyarrow as pa

        t = compiled(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return arrow_map(encoded.select("id", "ids"), run, "id long, text string", model=True)


def with_ids(docs: DataFrame, text_column: str = "text", model: str = MODEL) -> DataFrame:
    """The rows, columns as they came, with n_tokens and ids in place of the text; where a column has one of
    the two names already, the new one gets a number after its name. Each text's ids are decoded again; if
    that gives another text, ValueError."""
    kept = [c for c in docs.columns if c != text_column]
    length, listed = free(docs, "n_tokens"), free(docs, "ids")
    narrow = docs.select(*map(col, kept), col(text_column).cast("string").alias(SCRATCH))
    schema = StructType([*narrow.schema.fields[:-1], StructField(length, LongType()), StructField(listed, ArrayType(IntegerType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = compiled(model)
        for batch in batches:
            items = texts(batch.column(len(kept)))
            ids = [t.encode(x) for x in items]
            for x, y in zip(items, ids):
                # the mark itself reads as a space, in the library as here
                if t.decode(y.tolist()) != x.replace(META, " "):
                    raise ValueError(f"ids don't decode to their text: {x[:60]!r}")
            ends = pa.array(np.concatenate(([0], np.cumsum([len(y) for y in ids]))), pa.int32())
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(y) for y in ids], pa.int64()), pa.ListArray.from_arrays(ends, flat)], [*kept, length, listed])

    return arrow_map(narrow, run, schema, model=True)


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_md5, round_trip): each text encoded and its ids decoded again, in
    one pass, so no ids are kept. ids_crc32 is of the ids as little-endian 32-bit numbers; text_md5 of the
    decoded text."""
    schema = "doc_id long, n_tokens long, ids_crc32 long, text_md5 string, round_trip boolean"

    def run(batches):
        import pyarrow as pa

        t = compiled(model)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = t.encode(x)
                back = t.decode(ids.tolist())
                rows.append((i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.md5(back.encode()).hexdigest(), back == x))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

    return arrow_map(docs.select(col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text")), run, schema, model=True)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document text encoded to SentencePiece ids and decoded again."""
    return digests(table(spark, sf_dir, "documents"))
