"""WARC archives: a writer, a normaliser of monolithic gzip, and a reader by sidecar index.

``write_monolithic`` puts a response record for each page in WARC files that are one gzip stream each, as
careless writers do: nothing in such a file can be reached but by inflating all before it. ``normalise``
inflates each stream once, rewrites every record as a gzip member of its own, and writes a sidecar index of
offsets; on the way, responses whose payload another record already has become revisits. ``read_archives``
reaches records through the index. Archives of other writers are listed by ``scan_streams`` and take the same
way: their warcinfo, request, metadata and other records pass through byte by byte.

Which record of equal payloads stays a response is decided on (digest, page id) pairs alone: a maximum
for each digest, summed before the shuffle, and an equi-join that only digests held twice or more take
part in. Pages themselves are never shuffled. Files hold up to ``ROLL`` payload bytes, so every task's
memory is one chunk of a stream and the largest record. Files go to the folder executors share; a task
names its files afresh and lists them in its output rows, so files of a lost or repeated attempt are never
read.

Heads are read as they come: names of fields in any case, with or without a blank after the colon, folded
lines, bytes that are no UTF-8.

Edge cases: null html is an empty payload, a null url an empty one; equal empty payloads are revisits like
others (``LEAST`` 0); a page of any size is one record; null page ids count as smallest; of rows with the same
id and payload one is the response; a payload shorter than ``least`` is always a response; an empty table
gives no files and no rows; other columns may have any name; a stream that ends early, or holds no WARC
record where one should start, raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, col, materialize, open_file, read_file, scratch_path, table, texts, utf8, write_file

ROLL = 32_000_000
LEAST = 0
LEVEL = 6
_GZIP = 31  # zlib's window bits for gzip framing
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Record:
    """A record as it was: its head (bytes, without the empty line), its fields and its body."""

    def __init__(self, head: bytes, body: bytes):
        self.head, self.body, self.fields = head, body, []
        for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
            if line[:1] in " \t" and self.fields:
                name, value = self.fields[-1]
                self.fields[-1] = name, f"{value} {line.strip()}".strip()
            else:
                name, _, value = line.partition(":")
                self.fields.append((name.strip(), value.strip()))
        self._by_name = {k.lower(): v for k, v in reversed(self.fields)}

    def get(self, name: str) -> str | None:
        return self._by_name.get(name.lower())

    @property
    def kind(self) -> str:
        return (self.get("WARC-Type") or "").lower()

    @property
    def payload(self) -> bytes:
        """A response's body after its HTTP head; another record's whole body."""
        if self.kind == "response" and (self.get("Content-Type") or "application/http").lower().startswith("application/http"):
            _, cut, payload = self.body.partition(b"\r\n\r\n")
            return payload if cut else self.body
        return self.body

    def bytes(self) -> bytes:
        return self.head + b"\r\n\r\n" + self.body + b"\r\n\r\n"


def _record(kind: str, fields: list[tuple[str, str]], body: bytes) -> Record:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(body)}"]
    return Record("\r\n".join(lines).encode("utf-8", "surrogateescape"), body)


def response(record: str, page_id, url: str, payload: bytes, sha: str) -> bytes:
    """A response record: HTTP head and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record), ("WARC-Date", _DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + sha), ("X-Page-ID", _id(page_id)), ("Content-Type", "application/http;msgtype=response")]
    return _record("response", fields, http + payload).bytes()


def revisit(was: Record, refers_to: str, page_id, size: int, sha: str) -> Record:
    """The revisit record of a response: no body; the full payload's length and digest in fields, and whose
    payload it is, by record id and page."""
    gone = {"warc-type", "content-length", "content-type", "warc-payload-digest", "warc-block-digest"}
    keep = [(k, v) for k, v in was.fields if k.lower() not in gone]
    more = [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Refers-To", refers_to), ("X-Refers-To-Page-ID", _id(page_id)), ("X-Payload-Length", str(size)),
    ]
    return _record("revisit", keep + more, b"")


def _id(page_id) -> str:
    return "null" if page_id is None else str(page_id)


def _number(text: str | None):
    return int(text) if text and text.lstrip("-").isdigit() else None


def _clean(url: str) -> str:
    """A URL as a header value: on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", "", url)


# ---- streams ----------------------------------------------------------------------------------------


def inflate(chunks):
    """The bytes of a gzip stream, of one member or more, in pieces of bounded size, each byte once."""
    most, z, ended = 1 << 20, zlib.decompressobj(_GZIP), True
    for chunk in chunks:
        more = bool(chunk)
        while more:
            ended = False
            data = z.decompress(chunk, most)
            if data:
                yield data
            chunk = z.unconsumed_tail
            more = bool(chunk) or len(data) == most  # a full piece may have left output behind
            if z.eof:
                chunk, z, ended = z.unused_data, zlib.decompressobj(_GZIP), True
                more = bool(chunk)
    if not ended:
        raise ValueError("the gzip stream ends early")


def records(pieces):
    """Each WARC record in a byte stream."""
    held, start = bytearray(), 0
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        nonlocal start
        while len(held) - start < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            if start:
                del held[:start]
                start = 0
            held.extend(piece)
        return True

    while True:
        while fill(2) and held[start : start + 2] == b"\r\n":
            start += 2
        if len(held) == start:
            return
        sought = start
        while (end := held.find(b"\r\n\r\n", sought)) < 0:
            known = len(held) - start
            if not fill(known + 1):
                raise ValueError("a record's head is cut short")
            sought = max(start, start + known - 3)
        head = bytes(held[start:end])
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {head[:40]!r}")
        found = Record(head, b"")
        n, at = found.get("Content-Length"), end + 4 - start
        if n is None or not n.isdigit():
            raise ValueError(f"a record of no length: {head[:200]!r}")
        if not fill(at + int(n)):
            raise ValueError("a record's body is cut short")
        found.body = bytes(held[start + at : start + at + int(n)])
        start += at + int(n)
        yield found


def _chunks(uri: str, size: int = 1 << 20):
    with open_file(uri) as f:
        while data := f.read(size):
            yield data


# ---- stages -----------------------------------------------------------------------------------------

_WRITTEN = "file string, ordinal long, record string, page_id long, payload_bytes long, payload_digest string"


def _written(rows):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], [x.split()[0] for x in _WRITTEN.split(", ")])


def scan_streams(files: DataFrame) -> DataFrame:
    """From (file): what ``write_monolithic`` says of its own, for archives of any writer: a row for each
    response, with the page's id if the record has an X-Page-ID."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for ordinal, r in enumerate(records(inflate(_chunks(uri)))):
                    if r.kind == "response":
                        rows.append((uri, ordinal, r.get("WARC-Record-ID"), _number(r.get("X-Page-ID")), len(r.payload), digest(r.payload)))
                        if len(rows) >= 4096:
                            yield _written(rows)
                            rows = []
                if rows:
                    yield _written(rows)

    return arrow_map(files.select("file"), run, _WRITTEN)


def write_monolithic(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", roll: int = ROLL) -> DataFrame:
    """Response records in whole-file gzip streams in the folder; a row for each record."""

    def run(batches):
        uri, z, parts, rows, size = None, None, [], [], 0

        def close():
            parts.append(z.flush())
            write_file(uri, parts)
            return _written(rows)

        for batch in batches:
            for page_id, url, payload in zip(batch.column(0).to_pylist(), texts(batch.column(1)), utf8(batch.column(2))):
                if uri is None:
                    uri, z = f"{folder}/mono-{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                sha = digest(payload)
                record = f"<urn:uuid:{uuid.uuid4()}>"
                parts.append(z.compress(response(record, page_id, _clean(url), payload, sha)))
                rows.append((uri, len(rows), record, page_id, len(payload), sha))
                size += len(payload) + 512
                if size >= roll:
                    yield close()
                    uri, z, parts, rows, size = None, None, [], [], 0
        if uri is not None:
            yield close()

    narrow = pages.select(col(id_column).cast("long").alias("page_id"), col(url_column).cast("string").alias("url"), col(html_column).cast("string").alias("html"))
    return arrow_map(narrow, run, _WRITTEN)


def decisions(written: DataFrame, least: int = LEAST) -> DataFrame:
    """(file, revisits): for each file the ordinals whose records become revisits and the record and page
    each refers to. Of equal payloads the record of largest page id stays, by file and place among equals."""
    known = written.where(F.col("payload_bytes") >= least).select("payload_digest", F.struct("page_id", "file", "ordinal", "record").alias("r"))
    kept = known.groupBy("payload_digest").agg(F.max("r").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = known.join(kept, "payload_digest").where("r <> kept")
    files = written.select("file").distinct()
    lists = gone.groupBy("r.file").agg(F.collect_list(F.struct(F.col("r.ordinal").alias("ordinal"), F.col("kept.page_id").alias("page_id"), F.col("kept.record").alias("record"))).alias("revisits"))
    return files.join(lists, "file", "left")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """From (file, revisits): each stream inflated once and rewritten with a member for each record, and a
    sidecar index of lines "offset length type page". Rows: (archive, sidecar, records, bytes)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for uri, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                gone = {x["ordinal"]: x for x in gone or []}
                name = f"{folder}/norm-{uuid.uuid4().hex}.warc.gz"
                index: list[str] = []

                def members():
                    at = 0
                    for ordinal, r in enumerate(records(inflate(_chunks(uri)))):
                        if kept := gone.get(ordinal):
                            payload = r.payload
                            r = revisit(r, kept["record"] or "", kept["page_id"], len(payload), digest(payload))
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                        member = z.compress(r.bytes()) + z.flush()
                        index.append(f"{at} {len(member)} {r.kind or '-'} {r.get('X-Page-ID') or '-'}")
                        at += len(member)
                        yield member

                size = write_file(name, members())
                write_file(name + ".idx", ["\n".join(index).encode()])
                rows.append((name, name + ".idx", len(index), size))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.int64()])], ["archive", "sidecar", "records", "bytes"])

    return arrow_map(files, run, "archive string, sidecar string, records long, bytes long")


def read_record(f, offset: int, length: int) -> Record:
    """One record of an archive, reached by its index entry alone."""
    f.seek(offset)
    return next(records(inflate([f.read(length)])))


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to (a page), payload_bytes, payload_digest,
    payload (null for revisits), archive, offset, length, record, refers_to_record."""
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long, length long, "
        "record string, refers_to_record string"
    )

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)), kinds)], names)

        for batch in batches:
            for name, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                with open_file(name) as f:
                    for line in read_file(sidecar).decode().splitlines():
                        offset, length = map(int, line.split()[:2])
                        r = read_record(f, offset, length)
                        page, url, kind, own = _number(r.get("X-Page-ID")), r.get("WARC-Target-URI"), r.kind, r.get("WARC-Record-ID")
                        if kind == "revisit":
                            size, sha = _number(r.get("X-Payload-Length")), (r.get("WARC-Payload-Digest") or "").removeprefix("sha1:") or None
                            rows.append((page, url, kind, _number(r.get("X-Refers-To-Page-ID")), size, sha, None, name, offset, length, own, r.get("WARC-Refers-To")))
                        else:
                            payload = r.payload
                            rows.append((page, url, kind, None, len(payload), digest(payload), payload, name, offset, length, own, None))
                            held += len(payload)
                        if held > 4_000_000 or len(rows) >= 1024:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return arrow_map(archives.select("archive", "sidecar"), run, schema)


def normalise_archives(files: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives of any writer, from (file): (archive, sidecar, records, bytes), in the shared folder."""
    spark = files.sparkSession
    files = files.select("file").distinct()
    found = materialize(scan_streams(_spread(files)), "warc-found")
    gone = materialize(files.join(decisions(found, least), "file", "left"), "warc-decisions")
    return materialize(_spread(normalise(_spread(gone), scratch_path(spark, "warc-out"))), "warc-archives")


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages written, normalised and listed: (archive, sidecar, records, bytes), in the shared folder."""
    spark = pages.sparkSession
    written = materialize(write_monolithic(pages, scratch_path(spark, "warc-in")), "warc-written")
    files = materialize(decisions(written, least), "warc-decisions")
    return materialize(_spread(normalise(_spread(files), scratch_path(spark, "warc-out"))), "warc-archives")


def _spread(files: DataFrame) -> DataFrame:
    """A few rows that each stand for a file: dealt out so that files are worked on side by side."""
    n = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(n, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page, written as monolithic gzip, normalised, and read back."""
    found = read_archives(_spread(archive(table(spark, sf_dir, "pages"))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, strlen(x) AS payload_bytes, sha1(x) AS h FROM p),
o AS (
  SELECT *, row_number() OVER w AS place, first(page_id) OVER w AS kept FROM d
  WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN kept END AS refers_to
FROM o
"""
