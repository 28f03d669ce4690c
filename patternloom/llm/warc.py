"""WARC archives: writer with revisit records, and a splittable reader.

Writer: one gzip member per record. Of pages with equal payloads (same SHA-256 and length) of at least
`dedup_from` bytes, the largest id is the response and the others are revisits of it; smaller ones are all
responses. Each task streams its records to a file of its own; a file counts only if the manifest names it.

Reader: files are cut into byte ranges. A task scans its range for the gzip magic and tries each place: it is a
member only if it inflates to `WARC/1.` and a whole header block. Records belong to the range in which they start;
the last may end beyond it. After a record that was read to its end the scan goes on behind it, so bytes inside
a payload aren't tried; the places before a range's first member are, and the header check refuses them.

Records of other archives are read too: a block is an HTTP message only if its type says so, else it is the payload (warcinfo,
resource, metadata); a missing or odd Content-Length leaves the block as long as the member is, and bytes that
are no UTF-8 are replaced in headers. A payload that is stored without compression and itself holds a whole record is
told apart only by ranges that begin before it.

Defined cases: null html is an empty payload. Control characters and spaces in a url are percent-escaped; a null url is
`urn:none`. A null page_id is written as `null` and read back as null. Rows that repeat an id and payload are all
responses if that id is the largest. An empty table writes no file. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_fs, saved, workspace, write_whole

DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"

MANIFEST = "path string, bytes long, records long"
RECORD = "path string, offset long, record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def member(page_id, url, payload: bytes, refers: bool, refers_to) -> bytes:
    """One record as a gzip member. Revisits keep the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "urn:none" if url is None else re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if refers:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = http if refers else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, uri: str, dedup_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to WARC files under uri; the manifest (path, bytes, records), saved."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("long_enough", F.octet_length("payload") >= dedup_from)
    groups = rows.where("long_enough").groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = saved(groups.where("n > 1").select("digest", "first"), "warc-groups").withColumn("grouped", F.lit(True))
    rows = rows.join(groups, "digest", "left").withColumn("refers", F.expr("coalesce(grouped and long_enough and not (id <=> first), false)"))

    def write(batches):
        import pyarrow as pa

        path, n = f"{uri}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz", 0

        def members():
            nonlocal n
            for batch in batches:
                for i, url, payload, refers, first in zip(*(c.to_pylist() for c in batch.columns)):
                    n += 1
                    yield member(i, url, payload, refers, first)

        parts = members()
        begin = next(parts, None)
        if begin is not None:
            size = write_whole(path, _chain(begin, parts))
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}])

    return saved(rows.select("id", "url", "payload", "refers", "first").mapInArrow(write, MANIFEST), "warc-manifest")


def _chain(first, rest):
    yield first
    yield from rest


class _Window:
    """Bytes of a file by absolute position, read in pieces of 4 MB."""

    PIECE = 4 << 20

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def piece(self, at: int, most: int = PIECE) -> bytes:
        """At most `most` bytes from position at on; empty at the end."""
        if not self.at <= at < self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(self.PIECE, self.size - at)) if at < self.size else b""
        return self.data[at - self.at : at - self.at + most]

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place in [at, end) where what starts, or -1."""
        while at < end:
            if len(self.piece(at, len(what))) < len(what):
                self.data = b""
                if len(self.piece(at, len(what))) < len(what):
                    return -1
            k = self.data.find(what, at - self.at)
            if k >= 0:
                return self.at + k if self.at + k < end else -1
            at = self.at + len(self.data) - len(what) + 1
        return -1


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the member that starts at `at`, or None if it isn't a WARC record's.

    It is fed in steps that double, so a short member costs no copy of the bytes behind it."""
    unpack, out, checked, step = zlib.decompressobj(31), [], False, 512
    try:
        while not unpack.eof:
            data = window.piece(at, step)
            if not data:
                return None
            out.append(unpack.decompress(data))
            at += len(data)
            if not checked and len(out[-1]) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
            if checked:
                step = min(2 * step, window.PIECE)
    except zlib.error:
        return None
    content = b"".join(out)
    return (content, at - len(unpack.unused_data)) if content.startswith(b"WARC/1.") and b"\r\n\r\n" in content else None


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _id(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def _number(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"[0-9]+", text) else otherwise


def records(file, size: int, start: int, end: int):
    """(offset, header fields, HTTP fields, payload) of the records that start in [start, end)."""
    window, at = _Window(file, size), start
    while (at := window.find(MAGIC, at, end)) >= 0:
        found = _inflate(window, at)
        if found is None:
            at += 1
            continue
        head, _, rest = found[0].partition(b"\r\n\r\n")
        fields = _fields(head)
        block = rest[: _number(fields.get("content-length"), max(0, len(rest) - 4))]
        http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
        yield at, fields, _fields(http), payload
        at = found[1]


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """All records of the manifest's files, a task for each range of split_bytes."""
    ranges = manifest.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"))
    n = ranges.count()

    def read(batches):
        import pyarrow as pa

        kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_fs(row["path"])
                out, held = [], 0
                with store.open_input_file(path) as file:
                    for offset, head, http, payload in records(file, row["bytes"], row["start"], row["start"] + split_bytes):
                        out.append(
                            {"path": row["path"], "offset": offset, "record_type": (kind := head.get("warc-type")), "page_id": _id(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "refers_to": _id(head.get("warc-refers-to")),
                             "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": _number(http.get("content-length"), 0) if kind == "revisit" else len(payload), "payload": None if kind == "revisit" else payload}
                        )
                        held += len(payload)
                        if held > 4 << 20 or len(out) >= 2000:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    return ranges.repartition(max(1, min(n, 100_000))).mapInArrow(read, RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), workspace(spark, "warc"))
    out = read_warc(spark, manifest)

    @F.pandas_udf("string")
    def digest(payload, told):
        import pandas as pd

        return pd.Series([t if p is None else sha1_base32(p) for p, t in zip(payload, told)])

    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    return out.select("page_id", size.alias("payload_bytes"), digest("payload", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h),
b AS (SELECT page_id, h, array_to_string(list_transform(range(1, 41), lambda i:
  substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * (strpos('0123456789abcdef', substr(x, i, 1)) - 1) + 1 AS BIGINT), 4)), '') AS bits FROM p)
SELECT page_id, CAST(octet_length(encode(b.h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS BIGINT)
    + 8 * CAST(substr(bits, 5 * j + 2, 1) AS BIGINT) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS BIGINT) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS BIGINT) + CAST(substr(bits, 5 * j + 5, 1) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM b JOIN g ON b.h = g.h
"""
