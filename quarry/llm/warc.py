"""WARC archives, written with an index and read back by coalesced ranges (operator 10).

Each task writes one archive of gzip members into a shared folder and returns a row
per record: file, offset, length, URL and digest. That index is a table; an archive
left by a failed attempt is in no index row and so is never read. Reading sorts the
selected index rows by file and offset, joins near byte ranges into one read, and
takes the records out of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, dropped, keyed_join, new_path, qualified, written

MIN_REVISIT_BYTES = 1000
GAP, READ = 1 << 16, 1 << 22  # joined if no further apart; at most so many bytes at once
TASK = 1 << 24  # compressed bytes that a task reads
WRITTEN_AT = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, header_digest string, header_bytes long, payload binary"


def _number(x) -> str:
    return "" if x is None else str(x)


def _one_line(text: str) -> str:
    """A header value: what would end the line is escaped, as in a URL."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_id(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, of)))}>"


def info(name: str) -> bytes:
    """The record that begins an archive."""
    body = b"software: quarry\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('info', name)}", f"WARC-Date: {WRITTEN_AT}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", 4, mtime=0)


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One record as a gzip member: a response is an HTTP message, a revisit its head
    alone. What the format has no field for stands in X- fields: page ids, the payload's
    length, and URLs that are null or that a header line can't hold as they are."""
    uri = f"urn:page:{_number(page_id)}" if url is None else _one_line(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {WRITTEN_AT}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Page-ID: {_number(page_id)}", f"X-Payload-Length: {len(payload)}",
    ]
    if url != uri:
        head.append("X-URL: " + ("" if url is None else base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()))
    body = http + payload
    if refers_to is not None:
        to = f"urn:page:{refers_to}" if refers_url is None else _one_line(refers_url)
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {to}", f"WARC-Refers-To-Date: {WRITTEN_AT}", f"X-Refers-To-Page: {refers_to}"]
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        body = http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode("utf-8", "replace") + body + b"\r\n\r\n", 4, mtime=0)


def parsed(member: bytes) -> tuple:
    """A row of RECORDS from a gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    f = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = lambda k: int(f[k]) if f.get(k) else None
    url = f["WARC-Target-URI"] if "X-URL" not in f else base64.b64decode(f["X-URL"]).decode("utf-8", "surrogatepass") if f["X-URL"] else None
    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    _, _, payload = rest[: int(f["Content-Length"])].partition(b"\r\n\r\n")
    return n("X-Page-ID"), url, f["WARC-Type"], n("X-Refers-To-Page"), digest, n("X-Payload-Length"), payload if f["WARC-Type"] == "response" else None


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to, refers_url. Payloads of at least ``least``
    bytes that are equal form a group; rows with its largest page_id are responses, the
    rest revisit it. Where all ids of a group are null, all are responses.

    Groups are found on ids and digests alone, and payloads meet their revisits by page
    and digest, so that no task gets the payloads of a large group."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow, at = written(p.filter(F.octet_length("html") >= least).select("page_id", "url", "digest"), "digests")
    groups, groups_at = written(narrow.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).filter("n > 1 and top.page_id is not null").select("digest", "n", F.col("top.page_id").alias("to"), F.col("top.url").alias("to_url")), "groups")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    members = keyed_join(narrow.select("page_id", "digest"), groups, "digest", "n", narrow.count()).filter(~F.col("page_id").eqNullSafe(F.col("to")))
    revisits, _ = written(members.select("digest", named("page_id").alias("name"), F.col("to").alias("refers_to"), F.col("to_url").alias("refers_url")).distinct(), "revisits")
    dropped(pages.sparkSession, at, groups_at)
    # rows with one page and digest meet in one task, which gives their records names of their own
    return p.withColumn("name", named("page_id")).join(revisits.hint("merge"), ["digest", "name"], "left").select("page_id", "url", "html", "digest", "refers_to", "refers_url")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder``, a URI that pyarrow can
    open on driver and executors, and return the index, written beside it.

    Null html is an empty payload; null ids and URLs are left out of the record and
    stay null; every row, repeated ones too, gives a record with an id of its own; a
    payload of any length is one record; an empty table gives an empty index; other
    columns are ignored, whatever their names."""
    spark = pages.sparkSession
    uri = qualified(spark, folder or new_path(spark, "warc"))

    def write(batches):
        from pyarrow import fs

        out, rows, at, name, named = None, [], 0, "", set()
        try:
            for batch in chunks(batches, 200):
                for page, url, html, digest, to, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        store, top = fs.FileSystem.from_uri(uri)
                        store.create_dir(top, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                        out.write(head := info(name))
                        at = len(head)
                    payload = html.encode("utf-8", "replace")
                    own = record_id(page, digest)  # what revisits refer to
                    if to is not None or own in named:
                        own = record_id(name, at)
                    named.add(own)
                    member = record(own, page, url, payload, digest, to, to_url)
                    out.write(member)
                    rows.append((page, url, f"{uri}/{name}", at, len(member), len(payload), digest, "response" if to is None else "revisit", to))
                    at += len(member)
        finally:
            if out is not None:
                out.close()
        # only now is the archive whole, so only now do its index rows go out
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 10_000], strict=True), _INDEX, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    index, _ = written(with_revisits(pages, least).mapInArrow(write, INDEX), "warc-index")
    return index


_INDEX = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_RECORDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[int]]]:
    """Reads (file, start, stop, places of rows) that cover (file, offset, length) rows."""
    out: list[list] = []
    for k in sorted(range(len(rows)), key=lambda k: rows[k]):
        file, a, n = rows[k]
        if out and out[-1][0] == file and a - out[-1][2] <= GAP and a + n - out[-1][1] <= READ:
            out[-1][2] = max(out[-1][2], a + n)
            out[-1][3].append(k)
        else:
            out.append([file, a, a + n, [k]])
    return [tuple(x) for x in out]


def read_records(selected: DataFrame) -> DataFrame:
    """The records of selected index rows: page_id, url, record_type, refers_to, the
    header's digest and full payload length, and the payload (null for revisits)."""
    rows = selected.select("file", "offset", "length")
    parts = max(1, -(-(rows.agg(F.sum("length")).first()[0] or 0) // TASK))
    rows = rows.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches):
        from pyarrow import fs

        for batch in chunks(batches, 1000):
            wanted = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for file, a, b, places in ranges(wanted):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as f:
                    f.seek(a)
                    raw = f.read(b - a)
                got = [parsed(raw[wanted[k][1] - a : wanted[k][1] - a + wanted[k][2]]) for k in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), _RECORDS, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return rows.mapInArrow(read, RECORDS)
