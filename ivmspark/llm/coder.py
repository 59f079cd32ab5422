"""Token-id files: documents' ids under an adaptive context-mixing range coder.

A file holds whole documents in order. Its id stream is cut into blocks of ``BLOCK`` ids; a block's coder
starts from nothing but the file's header, and a checksum of its ids says whether it came back whole.

An id is its *cell* and, where the cell has several ids, its place there; cells are up to 256 runs of ids, by
falling frequency, of about equal weight, so a frequent id has one to itself. Three orders predict the cell:

- order 0: the cells of the block so far, on top of the file's frequencies; its distribution is made anew
  every ``REFRESH`` ids;
- order 1: the file's counts of cells after the cell before;
- order 2: the cell of the id that last came after the two ids before, if their slot of a hashed table holds
  one, with the chance that such a prediction has had in the block at its confidence.

Orders 0 and 1 are mixed by a weight that follows which of them has given the cells the larger share; order
2's cell gets its chance and the mixture the rest. Inside a cell that order 2 had right, its id has a chance
of its own; any other goes by frequency. A carryless 64-bit range coder, writing 16 bits at a time, narrows to
the intervals. All numbers are whole, or quotients and products rounded as IEEE has it, so a file reads the
same on any machine.

Blocks of a file are coded side by side, one NumPy lane each: a step codes the t-th id of every block. So
the work per id is that of a hundred vector operations or so, and memory is ``LANES`` blocks' tables.

Files are written in ascending order of document id: a range shuffle, a sort inside partitions, and a file
for each ``FILE`` ids, in the shared folder. A task lists its files in its output rows, so files of lost
attempts are never read. Where a file's first id stands among all ids is a running sum over one row a file.

Edge cases: null and empty texts hold the end id alone; null ids come first; repeated rows are documents of
their own; an empty table gives no files and no rows; a damaged file raises ValueError; other columns may
have any name.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, col, materialize, read_file, resident, scratch_path, table, texts, write_file

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Ids of a block, but for files that have few; blocks coded at a time.
BLOCK = 2048
LANES = 4096
FILE = 8_000_000
#: Chunks of text whose ids a worker keeps: two generations of so many.
CHUNKS = 600_000
#: Characters of the longest chunk that is kept.
LONGEST = 256
MAGIC = b"CMRC0002"

CELLS = 256
TOTAL, GAP = 1 << 20, 32  # of a distribution over cells: its scale, and the least share of each
PRIOR, COUNT = 1 << 14, 16  # what the file's frequencies and each id of the block weigh in order 0
REFRESH = 128
SLOTS = 1024  # of a block's table of order 2
_MOST = 61440  # the most that order 2 may claim of 2^16
_SCALE = 24  # bits of the scale on which a cell has its interval


# ---- the model ----------------------------------------------------------------------------------------


def _levels():
    """Counts are carried rounded down to one of these: steps of one, then of about an eighth."""
    out = [0, 1]
    while out[-1] < 1 << 31:
        out.append(out[-1] + max(1, out[-1] // 8))
    return out


def _bounds(weights):
    """Rows of a whole weight for each cell as upper bounds on the scale of TOTAL, each share at least GAP."""
    import numpy as np

    upto = weights.cumsum(1)
    scale = float(TOTAL - CELLS * GAP) / np.maximum(1, upto[:, -1:])
    out = (upto * scale).astype(np.int32)
    out += GAP * np.arange(1, CELLS + 1, dtype=np.int32)
    out[:, -1] = TOTAL
    return out


class _Model:
    """What a file's header says: ids by falling frequency, their cells, and the distributions that blocks
    start from."""

    def __init__(self, seen, counts, pairs: bytes):
        import numpy as np

        rank = np.lexsort((seen, -counts))
        self.ids, n = seen[rank].astype(np.int64), counts[rank].astype(np.int64)
        cells, left, cell, held = [], int(n.sum()), 0, 0
        for k in n.tolist():  # a cell is full when the next id would take it further past its share than it is short
            if held and cell < CELLS - 1 and (2 * held + k) * (CELLS - cell) >= 2 * left:
                left, cell, held = left - held, cell + 1, 0
            cells.append(cell)
            held += k
        cell = np.array(cells, np.int64)
        mass = np.bincount(cell, n, CELLS).astype(np.int64)
        self.prior = (mass * PRIOR // max(1, int(mass.sum()))).astype(np.int32)
        # inside a cell: shares of 2^16 by frequency, each at least 1
        size = np.bincount(cell, minlength=CELLS)
        share = 1 + n * (65536 - size[cell]) // np.maximum(1, mass[cell])
        lead = np.flatnonzero(np.diff(cell, prepend=-1))
        share[lead] += 65536 - np.bincount(cell, share, CELLS).astype(np.int64)[cell[lead]]
        start = np.cumsum(share) - share - cell * 65536
        self.key = cell * 65536 + start
        self.lone = np.full(CELLS, -1, np.int64)  # the id of a cell of one
        self.lone[cell[lead]] = np.where(size[cell[lead]] == 1, self.ids[lead], -1)
        self.several = size > 1
        top = int(seen.max()) + 1 if len(seen) else 1
        self.cell = np.zeros(top, np.int64)
        self.start, self.width = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.cell[self.ids], self.start[self.ids], self.width[self.ids] = cell, start, share
        if pairs:
            level = np.array(_levels(), np.int64)[np.frombuffer(zlib.decompress(pairs), np.uint8)].reshape(CELLS, CELLS)
            self.after = _bounds(np.where(level.any(1, keepdims=True), level, self.prior))
            self.after_coarse = np.ascontiguousarray(self.after[:, 15::16])

    def pairs(self, ids) -> bytes:
        """The file's counts of a cell after a cell, rounded, less the rare ones as far as that makes the
        file smaller: a short file can't pay for all of them."""
        import numpy as np

        c = self.cell[ids]
        both = np.bincount(c[:-1] * CELLS + c[1:], minlength=CELLS * CELLS).reshape(CELLS, CELLS)
        levels = np.array(_levels(), np.int64)
        zero = self.prior / max(1, int(self.prior.sum()))
        best = None
        for least in (1, 2, 3, 5, 9, 1 << 30):
            level = np.searchsorted(levels, np.where(both >= least, both, 0), "right") - 1
            held = zlib.compress(level.astype(np.uint8).tobytes(), 6)
            after = levels[level] / np.maximum(1, levels[level].sum(1, keepdims=True))
            mixed = np.where(level.any(1, keepdims=True), 0.75 * after + 0.25 * zero, zero)
            size = 8 * len(held) - float((both * np.log2(np.maximum(mixed, GAP / TOTAL))).sum())
            if best is None or size < best[0]:
                best = size, held
        return best[1]


class _Lanes:
    """The mixed model of many blocks side by side. A slot of order 2 holds id * 16 + confidence."""

    def __init__(self, model: _Model, lanes: int):
        import numpy as np

        self.model, self.lane = model, np.arange(lanes, dtype=np.int64)
        self.counts = np.tile(model.prior, (lanes, 1))
        self._refresh()
        self.weight = np.full(lanes, 768, np.int32)  # of order 1, of 1024
        self.slots = np.zeros(lanes * SLOTS, np.int32)
        first = [1000 if c == 0 else min(_MOST, (2 * c + 1) * 65536 // (2 * c + 8)) for c in range(16)]
        self.chance = [np.tile(np.array(x, np.int32), lanes) for x in (first, [49152] * 16)]
        self.cell, self.one, self.two = (np.zeros(lanes, np.int64) for _ in range(3))
        self.steps = 0

    def _refresh(self) -> None:
        import numpy as np

        self.zero = _bounds(self.counts)
        self.zero_coarse = np.ascontiguousarray(self.zero[:, 15::16])

    def begin(self, n: int) -> None:
        """Order 2's prediction for the next id of the first n lanes."""
        lane = self.lane[:n]
        at = self.two[:n] * 54059 ^ self.one[:n] * 40503
        self.at = lane * SLOTS + ((at ^ at >> 9) & SLOTS - 1)
        self.held = self.slots.take(self.at)
        self.sure = self.held & 15
        self.guess = self.held >> 4
        self.want = self.model.cell.take(self.guess)
        self.rank = lane * 16 + self.sure
        self.claim = self.chance[0].take(self.rank)
        self.rows = lane * CELLS, self.cell[:n] * CELLS
        self.part = self.weight[:n]

    def _mixed(self, a, b, part):
        b = b - a
        b *= part
        b >>= 10
        b += a
        return b

    def find(self, n: int, v):
        """The cell whose interval holds v, on the scale of 2^_SCALE."""
        import numpy as np

        r0, r1 = self.rows
        want, claim = self.want, self.claim.astype(np.int64)
        rest = 65536 - claim
        # order 2's share lies inside its cell: past it v is taken less the share, before it the cell is that at most
        edge = self._mixed(self.zero.take(r0 + want), self.model.after.take(r1 + want), self.part).astype(np.int64)
        claim <<= _SCALE - 16
        past = v >= (edge * rest >> 36 - _SCALE) + claim
        v = v - claim * past + 1 << 36 - _SCALE
        least = np.minimum(-(-v // rest), TOTAL)  # of a bound that is above v
        least = np.repeat(least.astype(np.int32), 16).reshape(n, 16)
        part = np.repeat(self.part, 16).reshape(n, 16)

        def below(a, b):
            count = np.bitwise_count((self._mixed(a, b, part) < least).view(np.uint64))
            return (count[:, 0] + count[:, 1]).astype(np.int64)

        high = below(self.zero_coarse[:n], self.model.after_coarse.take(self.cell[:n], 0))
        low = below(self.zero.reshape(-1, 16).take((r0 >> 4) + high, 0), self.model.after.reshape(-1, 16).take((r1 >> 4) + high, 0))
        cell = high * 16 + low
        return np.where(past, cell, np.minimum(cell, want))

    def interval(self, n: int, cell):
        """(start, width) of a cell on the scale of 2^_SCALE; the orders learn it."""
        import numpy as np

        zero, after, part, claim = self.zero, self.model.after, self.part, self.claim
        at0, at1 = (r + cell for r in self.rows)
        # the bound before the first of a row is the last of the row before: TOTAL, which the mask makes 0
        h0, h1 = zero.take(at0), after.take(at1)
        l0, l1 = zero.take(at0 - 1) & TOTAL - 1, after.take(at1 - 1) & TOTAL - 1
        rest = (65536 - claim).astype(np.int64)
        low = self._mixed(l0, l1, part) * rest
        high = self._mixed(h0, h1, part) * rest
        low >>= 36 - _SCALE
        high >>= 36 - _SCALE
        hit = cell == self.want
        share = claim.astype(np.int64) << _SCALE - 16
        low += share * (cell > self.want)
        high += share * (cell >= self.want)
        if self.steps & 3 == 0:  # weights go to the order that gave the cell the larger share, and slowly back to even
            one = (h1 - l1) * part.astype(np.float64)
            now = (one * 1024.0 / (one + (h0 - l0) * (1024.0 - part))).astype(np.int32)
            self.weight[:n] = now + (512 - now >> 4)
        self.chance[0][self.rank] = np.minimum(claim + ((hit * np.int32(65536) - claim) >> 5), _MOST)
        counts = self.counts.reshape(-1)
        counts[at0] = counts.take(at0) + np.int32(COUNT)
        self.hit = hit
        return low.astype(np.uint64), (high - low).astype(np.uint64)

    def doubts(self, cell):
        """(lanes whose cell order 2 had right and that has several ids, the chance of its id)."""
        import numpy as np

        at = np.flatnonzero(self.hit & self.model.several.take(cell))
        return at, self.chance[1].take(self.rank.take(at))

    def settle(self, at, chance, right) -> None:
        import numpy as np

        self.chance[1][self.rank.take(at)] = np.minimum(np.maximum(chance + ((right * np.int32(65536) - chance) >> 5), 65536 - _MOST), _MOST)

    def end(self, n: int, ids, cell) -> None:
        import numpy as np

        sure = self.sure
        hit = ids == self.guess
        kept = self.held - sure + np.where(hit, np.minimum(sure + 1, 15), sure >> 1)
        self.slots[self.at] = np.where(hit & (sure > 0) | (sure > 1), kept, (ids.astype(np.int32) << 4) + 1)
        self.two[:n] = self.one[:n]
        self.one[:n] = ids
        self.cell[:n] = cell
        self.steps += 1
        if self.steps % REFRESH == 0:
            self._refresh()


# ---- the coder ----------------------------------------------------------------------------------------


def _blocks(n: int) -> list[int]:
    """Sizes of a file's blocks: shorter ones in a short file, so that there are some hundred to code side by
    side, whatever their number a step's cost."""
    size = min(BLOCK, max(256, -(-n // 512)))
    return [min(size, n - i) for i in range(0, n, size)]


_TOP, _BOT = 1 << 48, 1 << 40


class _Range:
    """Lanes of a carryless range coder: 64 bits wide, 16 at a time. A lane's range is above _BOT between
    ids, which leaves room for the intervals of an id."""

    def __init__(self, lanes: int):
        import numpy as np

        self.low, self.rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def narrow(self, n: int, start, width) -> None:
        """The first n lanes to intervals on the scale of 2^_SCALE."""
        import numpy as np

        r = self.rng[:n] >> np.uint64(_SCALE)
        self.low[:n] += r * start
        np.multiply(r, width, out=self.rng[:n])

    def narrow_at(self, at, start, width) -> None:
        """Some lanes to intervals on the scale of 2^16."""
        import numpy as np

        r = self.rng.take(at) >> np.uint64(16)
        self.low[at] += r * start
        self.rng[at] = r * width

    def settle(self, n: int, shift) -> None:
        """Shift 16 bits out of, or into, each of the first n lanes while it has them; shift(lanes, low)
        moves them."""
        import numpy as np

        top, bot, w16 = np.uint64(_TOP), np.uint64(_BOT), np.uint64(16)
        lo, rg = self.low[:n], self.rng[:n]
        same = (lo ^ (lo + rg)) < top
        at = np.flatnonzero(same | (rg < bot))
        while len(at):
            lo, rg = self.low[at], self.rng[at]
            same = (lo ^ (lo + rg)) < top
            rg = np.where(same, rg, (~lo + np.uint64(1)) & (bot - np.uint64(1)))
            shift(at, lo)
            lo, rg = lo << w16, rg << w16
            self.low[at], self.rng[at] = lo, rg
            at = at[((lo ^ (lo + rg)) < top) | (rg < bot)]


def _encode_lanes(ids, sizes: list[int], model: _Model) -> list[bytes]:
    """Each lane's code. ids: a row a lane, longest first."""
    import numpy as np

    lanes, steps = len(sizes), sizes[0]
    mixer, coder = _Lanes(model, lanes), _Range(lanes)
    cap = 3 * steps + 8
    out, pos = np.zeros((lanes, cap), np.uint16), np.arange(lanes, dtype=np.int64) * cap
    flat = out.reshape(-1)
    w16, w48 = np.uint64(16), np.uint64(48)
    columns = np.ascontiguousarray(ids.T)

    def shift(at, lo):
        flat[pos[at]] = (lo >> w48).astype(np.uint16)
        pos[at] += 1

    n = lanes
    for t in range(steps):
        while sizes[n - 1] <= t:
            n -= 1
        x = columns[t, :n].astype(np.int64)
        cell = model.cell.take(x)
        mixer.begin(n)
        coder.narrow(n, *mixer.interval(n, cell))
        plain = model.several.take(cell)
        at, chance = mixer.doubts(cell)
        right = x.take(at) == mixer.guess.take(at)
        coder.narrow_at(at, np.where(right, 0, chance).astype(np.uint64), np.where(right, chance, 65536 - chance).astype(np.uint64))
        mixer.settle(at, chance, right)
        plain[at[right]] = False
        at = np.flatnonzero(plain)
        own = x.take(at)
        coder.narrow_at(at, model.start.take(own), model.width.take(own))
        coder.settle(n, shift)
        mixer.end(n, x, cell)
    low = coder.low
    for _ in range(4):
        flat[pos] = (low >> w48).astype(np.uint16)
        pos += 1
        low <<= w16
    return [flat[i * cap : end].astype("<u2").tobytes() for i, end in enumerate(pos.tolist())]


def _decode_lanes(codes: list[bytes], sizes: list[int], model: _Model):
    """The lanes' ids, a row a lane."""
    import numpy as np

    lanes, steps = len(sizes), sizes[0]
    mixer, coder = _Lanes(model, lanes), _Range(lanes)
    low, rng = coder.low, coder.rng
    longest = max(len(c) for c in codes) // 2 + 4
    words = np.zeros((lanes, longest), np.uint16)
    for i, c in enumerate(codes):
        words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    flat = words.reshape(-1)
    pos = np.arange(lanes, dtype=np.int64) * longest
    ends = pos + longest - 1
    w16, one = np.uint64(16), np.uint64(1)
    code = np.zeros(lanes, np.uint64)

    def shift(at, _):
        code[at] = code[at] << w16 | flat[np.minimum(pos[at], ends[at])]
        pos[at] += 1

    def value(at, bits: int):
        found = (code[at] - low[at]) // np.maximum(rng[at] >> np.uint64(bits), one)
        return np.minimum(found, np.uint64((1 << bits) - 1)).astype(np.int64)

    for _ in range(4):
        shift(np.arange(lanes), None)
    out = np.zeros((steps, lanes), np.int32)
    n = lanes
    for t in range(steps):
        while sizes[n - 1] <= t:
            n -= 1
        mixer.begin(n)
        cell = mixer.find(n, value(slice(n), _SCALE))
        coder.narrow(n, *mixer.interval(n, cell))
        x = model.lone.take(cell)
        at, chance = mixer.doubts(cell)
        right = value(at, 16) < chance
        coder.narrow_at(at, np.where(right, 0, chance).astype(np.uint64), np.where(right, chance, 65536 - chance).astype(np.uint64))
        mixer.settle(at, chance, right)
        at = at[right]
        x[at] = mixer.guess[at]
        at = np.flatnonzero(x < 0)
        own = model.ids[np.searchsorted(model.key, cell.take(at) * 65536 + value(at, 16), "right") - 1]
        x[at] = own
        coder.narrow_at(at, model.start.take(own), model.width.take(own))
        coder.settle(n, shift)
        out[t, :n] = x
        mixer.end(n, x, cell)
    return np.ascontiguousarray(out.T)


# ---- files ------------------------------------------------------------------------------------------


def pack(docs: list[tuple], ids) -> bytes:
    """A file's bytes: docs are (doc id or None, number of ids), ids all their ids in turn."""
    import numpy as np

    ids = np.asarray(ids, np.int32)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 27):
        raise ValueError("ids must be from 0 to 2^27 - 1")
    if len(ids) and ids.max() < len(ids):  # by counting, not sorting
        counts = np.bincount(ids)
        seen = np.flatnonzero(counts).astype(np.int32)
        counts = counts[seen]
    else:
        seen, counts = np.unique(ids, return_counts=True)
    pairs = _Model(seen, counts, b"").pairs(ids) if len(ids) else b""
    model = _Model(seen, counts, pairs) if len(ids) else None
    sizes, codes = _blocks(len(ids)), []
    for g in range(0, len(sizes), LANES):
        group = sizes[g : g + LANES]
        rows = np.zeros((len(group), group[0]), np.int32)
        part = ids[g * sizes[0] : g * sizes[0] + sum(group)]
        rows.reshape(-1)[: len(part)] = part
        codes += _encode_lanes(rows, group, model)
    known = np.array([i is not None for i, _ in docs], np.uint8)
    numbers = np.array([i or 0 for i, _ in docs], "<i8")
    lengths = np.array([c for _, c in docs], "<u4")
    steps = np.diff(numbers, prepend=np.int64(0)).astype("<i8") if len(numbers) else numbers
    head = zlib.compress(b"".join([known.tobytes(), steps.tobytes(), lengths.tobytes()]), 6)
    order0 = zlib.compress(np.diff(seen, prepend=0).astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 6)
    sums = [zlib.crc32(ids[i * sizes[0] : i * sizes[0] + n].astype("<u4").tobytes()) for i, n in enumerate(sizes)]
    index = b"".join(struct.pack("<III", n, len(c), s) for n, c, s in zip(sizes, codes, sums))
    fixed = struct.pack("<QIIIIII", len(ids), len(docs), len(sizes), len(seen), len(head), len(order0), len(pairs))
    body = b"".join([fixed, head, order0, pairs, index])
    return b"".join([MAGIC, struct.pack("<I", zlib.crc32(body)), body, *codes])


def unpack(data: bytes):
    """(docs, ids) of a file's bytes; ValueError if a checksum fails."""
    import numpy as np

    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    n, n_docs, n_blocks, n_seen, n_head, n_order0, n_pairs = struct.unpack_from("<QIIIIII", data, 12)
    at = 12 + struct.calcsize("<QIIIIII")
    end = at + n_head + n_order0 + n_pairs + 12 * n_blocks
    if zlib.crc32(data[12:end]) != struct.unpack_from("<I", data, 8)[0]:
        raise ValueError("the header's checksum fails")
    head = zlib.decompress(data[at : at + n_head])
    known = np.frombuffer(head, np.uint8, n_docs)
    numbers = np.cumsum(np.frombuffer(head, "<i8", n_docs, n_docs))
    lengths = np.frombuffer(head, "<u4", n_docs, 9 * n_docs)
    docs = [(i if k else None, c) for k, i, c in zip(known.tolist(), numbers.tolist(), lengths.tolist())]
    order0 = zlib.decompress(data[at + n_head : at + n_head + n_order0])
    seen = np.cumsum(np.frombuffer(order0, "<u4", n_seen).astype(np.int64))
    counts = np.frombuffer(order0, "<u4", n_seen, 4 * n_seen).astype(np.int64)
    at += n_head + n_order0
    model = _Model(seen, counts, data[at : at + n_pairs]) if n else None
    index = [struct.unpack_from("<III", data, at + n_pairs + 12 * i) for i in range(n_blocks)]
    ids, place, done = np.zeros(n, np.int32), end, 0
    for g in range(0, n_blocks, LANES):
        group = index[g : g + LANES]
        codes = []
        for _, size, _ in group:
            codes.append(data[place : place + size])
            place += size
        rows = _decode_lanes(codes, [x[0] for x in group], model)
        for (size, _, check), row in zip(group, rows):
            if zlib.crc32(row[:size].astype("<u4").tobytes()) != check:
                raise ValueError("a block's checksum fails")
            ids[done : done + size] = row[:size]
            done += size
    return docs, ids


# ---- encoding ---------------------------------------------------------------------------------------


#: How the library splits ASCII text, and a word that starts a chunk.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_WORD = re.compile(r" ?[^\W\d_]+").match
#: ASCII marks and at most one white space that a piece ends with wherever a letter follows.
_GAP = re.compile(r"[!-&(-/:-@\[-`{-~]+(?=[A-Za-z])|[!-&(-/:-@\[-`{-~]*[\t-\r](?=[^\W\d_])").match


def _alphabet() -> dict[int, str]:
    """Byte-level BPE's character for each byte: itself if it prints, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)}.difference(own)))}


class _Odd(Exception):
    """A text that chunks might not suit."""


class _Known(dict):
    """Chunks' ids as 32-bit numbers; what is asked for and not there is learnt."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        ids = self.learn(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


class _Letters(dict):
    """Letters and the space in the model's alphabet; a character that the library takes for none is None."""

    def __init__(self, cut, alphabet):
        self.cut, self.alphabet = cut, alphabet
        self[" "] = alphabet[32]

    def __missing__(self, c: str):
        self[c] = "".join(self.alphabet[b] for b in c.encode()) if len(self.cut("a" + c)) == 1 else None
        return self[c]


class Tokens:
    """The tokenizers library over whole texts, as it is. Where each space has a letter, digit or mark after
    it, a text's pieces never cross the gap before a space, so it is encoded by such chunks, and the ids of
    chunks met are kept; any other text, and one with a special token's string, is encoded whole. A new chunk
    is cut into the library's pieces and its model merges each: a word of letters, those the library takes for
    some, is one piece up to what is none; what follows is cut by the library's expression if it is ASCII, else
    by the library. A tokenizer of another build than byte-level BPE encodes all texts whole.

    Chunks are kept in two generations: when the young one is full it becomes the old one, and what is met
    again comes back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        build = json.loads(words.to_str())
        split, model = build["pre_tokenizer"] or {}, build["model"]
        self.plain = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and model["type"] == "BPE" and not model["dropout"]
        self.plain = self.plain and not (build["normalizer"] or build["truncation"] or build["padding"])
        self.special = ["\0", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        if self.plain:
            words.model._resize_cache(0)  # its own cache costs more than it saves on words not met before
            self.merge, self.cut, self.alphabet = words.model.tokenize, words.pre_tokenizer.pre_tokenize_str, _alphabet()
            self.letters = _Letters(self.cut, self.alphabet)
            self.raw = [struct.pack("=i", i) for i in range(words.get_vocab_size(True))]
        self.known, self.old = _Known(self._learn), {}

    def _encode(self, items: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def pieces(self, chunk: str) -> list[str]:
        """The library's pieces of a chunk, in the model's alphabet."""
        return [x.translate(self.alphabet) for x in _SPLIT.findall(chunk)] if chunk.isascii() else [x for x, _ in self.cut(chunk)]

    def _merged(self, pieces) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for x in pieces for t in self.merge(x)])

    def _word(self, word: str) -> bytes | None:
        """The ids of a word of letters, None if it holds others."""
        if word.isascii():
            return self._merged((word.replace(" ", self.alphabet[32]),))
        own = [*map(self.letters.__getitem__, word)]
        return None if None in own else self._merged(("".join(own),))

    def _learn(self, chunk: str) -> bytes:
        if chunk[:1] == " " and (len(chunk) == 1 or chunk[1].isspace()):
            raise _Odd
        ids = self.old.get(chunk)
        if ids is not None:
            return ids
        word = _WORD(chunk)
        end = word.end() if word else 0
        if end == len(chunk):
            ids = self._word(chunk) if end else b""
        elif end and (chunk[end] < "\x80" or not self.letters[chunk[end]]):
            head = chunk[:end]
            ids = self.known.get(head) or self.old.get(head) or self._word(head)
            if ids is not None:
                ids += self.known[chunk[end:]]
        elif gap := _GAP(chunk):
            ids = self.known[gap[0]] + self.known[chunk[gap.end() :]]
        return self._merged(self.pieces(chunk)) if ids is None else ids

    def encode(self, items: list[str]) -> list:
        """Each text's ids as an array."""
        import numpy as np

        if len(self.known) > CHUNKS:
            self.known, self.old = _Known(self._learn), self.known
        at, out, whole = self.known.__getitem__, [], []
        for i, x in enumerate(items):  # a text at a time: its chunks are used while they are near
            try:
                if not self.plain or any(map(x.__contains__, self.special)):
                    raise _Odd
                out.append(np.frombuffer(b"".join(map(at, x.replace(" ", "\0 ").split("\0"))), np.int32))
            except _Odd:
                out.append(None)
                whole.append(i)
        for i, ids in zip(whole, self._encode([items[i] for i in whole])):
            out[i] = np.array(ids, np.int32)
        return out


def tokens(name: str) -> Tokens:
    import public_tokenizers

    return resident(("tokens", name), lambda: Tokens(public_tokenizers.path(name)))


# ---- DataFrame forms --------------------------------------------------------------------------------


def write_ids(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Files of all documents' ids in ascending order of document id. Rows, one a file: part, seq (their
    order), file, docs, n_tokens, bytes."""
    schema = "part int, seq int, file string, docs long, n_tokens long, bytes long"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = tokens(tokenizer), TaskContext.get().partitionId()
        listed, parts, size, seq = [], [], 0, 0

        def close():
            name = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            n = write_file(name, [pack(listed, np.concatenate(parts))])
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, seq, name, len(listed), size, n), kinds)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch.column(1)))):
                listed.append((i, len(ids) + 1))
                parts += [ids, np.array([end_id], np.int32)]
                size += len(ids) + 1
                if size >= FILE:
                    yield close()
                    listed, parts, size, seq = [], [], 0, seq + 1
        if listed:
            yield close()

    narrow = docs.select(col(id_column).cast("long").alias("doc_id"), col(text_column).cast("string").alias("text"))
    return arrow_map(narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), run, schema, model=True)


def read_ids(files: DataFrame) -> DataFrame:
    """From (file, start): a row for each document: doc_id, start, n_tokens, ids."""
    schema = "doc_id long, start long, n_tokens long, ids array<int>"
    return arrow_map(files.select("file", "start"), _reader(schema, False), schema)


def digest_ids(files: DataFrame) -> DataFrame:
    """From (file, start): doc_id, start, n_tokens, ids_crc32 of each document read back."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return arrow_map(files.select("file", "start"), _reader(schema, True), schema)


def _reader(schema: str, digest: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32())]
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs, ids = unpack(read_file(name))
                ends = np.cumsum([n for _, n in docs])
                for g in range(0, len(docs), 512):
                    rows = []
                    for (i, n), end in zip(docs[g : g + 512], ends[g : g + 512].tolist()):
                        own = ids[end - n : end]
                        rows.append((i, start + end - n, n, zlib.crc32(own.astype("<u4").tobytes()) if digest else own))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def listing(written: DataFrame) -> DataFrame:
    """Files with start, the number of ids in all files before; a row a file, so one ordered window."""
    order = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to range-coded files in order of doc_id and read back."""
    written = materialize(write_ids(table(spark, sf_dir, "documents"), scratch_path(spark, "ids")), "ids-files")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return digest_ids(listing(written).repartition(n))
