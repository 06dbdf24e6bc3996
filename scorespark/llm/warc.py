"""WARC archives: a writer with revisit records, and a reader that splits files at any byte.

Every record is a gzip member of its own. A reading task gets a byte range,
looks for the gzip magic in it, takes a hit for a member only if it inflates
to a WARC header whose Content-Length is met exactly where the member ends,
and owns the records that start inside its range, reading past the end of the
range to finish the last one.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import Staged, shuffle_partitions
from scorespark.llm.files import create, open_input, shared_folder

MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RECORD = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
          "payload binary")


# ---- writing --------------------------------------------------------------------------------------------------------

def plan_records(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url",
                 payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what each page's record will be.

    Of the pages with one payload of ``min_bytes`` or more, that with the
    largest id is a response and the others revisit it (refers_to). Digests
    are counted before the join, so copies meet as one row a digest and task;
    Spark splits a digest that very many pages share. Null payloads are empty;
    a page without id is a response.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    last = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
            .agg(F.max("page_id").alias("last"), F.count("page_id").alias("n")).where("n > 1").drop("n"))
    return rows.join(last, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]' + chr(39))}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    out, path, size, count = None, "", 0, 0

    def close():
        out.close()
        return pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": count}])

    for batch in batches:
        for row in zip(*batch.columns):
            page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
            if out is None:
                path, out = create(folder, ".warc.gz")
                size = count = 0
            data = record(page_id, url, payload, digest, refers_to, date)
            out.write(data)
            size, count = size + len(data), count + 1
            if size >= file_bytes:
                yield close()
                out = None
    if out is not None:
        yield close()


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> DataFrame:
    """Write planned records below ``folder``; the manifest (path, bytes, records) of the files comes back.

    A task starts a new file after ``file_bytes``. Characters that a header
    cannot hold are percent-encoded in URLs. No record gives no file.
    """
    source = records.select("page_id", "url", "payload", "digest", "refers_to")
    folder = shared_folder(records.sparkSession, folder)
    files = source.mapInArrow(partial(_write, folder=folder, date=date, file_bytes=file_bytes), MANIFEST)
    return Staged(records.sparkSession, "warc")(files, "manifest")


# ---- reading --------------------------------------------------------------------------------------------------------

class _Window:
    """Bytes of a file from ``at`` on, read as far as asked."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.size, self.data = f, at, size, b""

    def more(self) -> bool:
        end = self.at + len(self.data)
        if end >= self.size:
            return False
        self.data += self.f.read_at(min(_READ, self.size - end), end)
        return True

    def drop(self, to: int) -> None:
        """Forget what lies before ``to``."""
        self.data, self.at = self.data[to - self.at:], to


def _member(window: _Window, at: int) -> tuple[bytes, bytes, int] | None:
    """Header, block and end of the record whose member starts at ``at``; None if none does."""
    inflate, made, fed, header, need = zlib.decompressobj(31), [], at - window.at, None, 0
    have, start = 0, bytearray()  # a header may be as long as its URL
    try:
        while not inflate.eof:
            if fed >= len(window.data) and not window.more():
                return None
            part = window.data[fed:fed + (_READ if header or have > 1 << 16 else 512)]
            fed += len(part)
            got = inflate.decompress(part)
            made.append(got)
            have += len(got)
            if header is None:
                start += got
                if not start[:5] == b"WARC/"[:len(start[:5])]:
                    return None
                stop = start.find(b"\r\n\r\n", max(0, len(start) - len(got) - 3))
                if stop >= 0:
                    header = bytes(start[:stop])
                    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", header)
                    if not length or not re.search(rb"(?im)^warc-type:[ \t]*\S+", header):
                        return None
                    need = len(header) + 4 + int(length[1]) + 4
            if header is not None and have > need:
                return None
    except zlib.error:
        return None
    if header is None or have != need:
        return None
    return header, b"".join(made)[len(header) + 4:-4], window.at + fed - len(inflate.unused_data)


def read_range(path: str, start: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of the records that start in the byte range [start, end) of a file."""
    with open_input(path) as f:
        window, at = _Window(f, start, f.size()), start
        while at < end:
            found = window.data.find(MAGIC, at - window.at)
            if found < 0:
                at = max(at, window.at + len(window.data) - len(MAGIC) + 1)
                window.drop(min(at, window.at + len(window.data)))
                if not window.more():
                    return
                continue
            at = window.at + found
            if at >= end:
                return
            window.drop(at)
            member = _member(window, at)
            if member:
                yield member[:2]
            at = member[2] if member else at + 1


def parse(header: bytes, block: bytes) -> tuple:
    """A record's row: page_id, url, type, payload size and digest, the record it refers to, payload."""
    fields = dict(re.findall(r"(?m)^([^:\r\n]+):[ \t]*(.*?)\r?$", header.decode()))
    http, _, payload = block.partition(b"\r\n\r\n")
    named = lambda x: int(m[1]) if x and (m := re.search(r"(-?\d+)>$", x)) else None
    kind = fields["WARC-Type"]
    size = int(re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and len(payload) != size:
        raise ValueError("a payload is not as long as its header says")
    return (named(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, size, digest,
            named(fields.get("WARC-Refers-To")), payload if kind == "response" else None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    rows, size = [], 0
    for batch in batches:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            for header, block in read_range(path, start, end):
                rows.append(parse(header, block))
                size += len(block) + 500
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [-sum(1 for _ in read_range(*r)) for r in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["path", "n"])


def read_archives(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives in ``files`` (path, bytes), a range of ``split_bytes`` at a time.

    Rows: page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload (null in revisits). payload_bytes is the size of the full payload.
    Where ``files`` tells the number of records (as a manifest does), they are
    counted first, and a file with more or fewer stops the job.
    """
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "bytes", start.alias("start")).select(
        "path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    spread = ranges.repartition(shuffle_partitions(files.sparkSession), "path", "start")
    if "records" in files.columns:
        counts = files.select("path", F.col("records").alias("n")).union(spread.mapInArrow(_count, "path string, n long"))
        wrong = counts.groupBy("path").agg(F.sum("n").alias("n")).where("n <> 0").first()
        if wrong:
            raise ValueError(f"{wrong.path}: the records read and the manifest differ by {-wrong.n}")
    return spread.mapInArrow(_read, RECORD)
