"""WARC archives: an index written first, then coalesced byte-range reads of selected records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch, table

#: Equal payloads of fewer bytes are stored each time.
LEAST_REVISIT = 1_000
#: An archive file is closed when it has grown to this size.
FILE_BYTES = 256 << 20
#: Records whose gap is no larger are read in one go, up to SPAN_BYTES at a time.
GAP_BYTES, SPAN_BYTES = 64 << 10, 8 << 20
#: WARC-Date of all records, a parameter so that archives are reproducible.
DATE = "1970-01-01T00:00:00Z"

_INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _uri(text: str) -> str:
    """A URL that fits on a header line: white space and control characters are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), text)


def _b32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with a response record, or a revisit record (HTTP header only) if refers_to is given."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [] if url is None else [f"WARC-Target-URI: {_uri(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{_b32(digest)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parse(member: bytes) -> dict:
    """Fields of a record: type, page_id, refers_to, url, digest (hex) and length of the full payload, payload if it is there."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    http_end = block.index(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", block[:http_end])[1])
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    return {
        "record_type": fields["WARC-Type"],
        "page_id": number(fields["WARC-Record-ID"]),
        "refers_to": number(fields.get("WARC-Refers-To")),
        "url": fields.get("WARC-Target-URI"),
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "payload_bytes": size,
        "payload": block[http_end + 4 :] if fields["WARC-Type"] == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes every page as a WARC record into files of folder and returns the saved index, a row for each record.

    The index is complete before anything is read. A task writes files under names of its own attempt and the index
    names the files of the attempt that counted, so that a task that runs again does no harm. Which records are
    revisits is decided from (page, digest) pairs, of which only digests that occur more than once are joined.

    A null html is an empty payload, a null url leaves out the target. Of equal payloads of at least least_revisit
    bytes those with the largest page_id are responses; rows that repeat that id are responses, too. If all their
    ids are null, all are responses. Repeated rows give a record each; other columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    long = rows.where(F.octet_length("payload") >= least_revisit)
    copies = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Saved: a digest with very many records can then be split among tasks.
    rows = rows.join(save(copies, "copies"), "digest", "left")
    refers = F.when((F.octet_length("payload") >= least_revisit) & (F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())), F.col("first"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches):
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, at, index = None, None, 0, []
        for batch in batches:
            for page_id, url, body, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page_id, url, body, digest, refers_to)
                out.write(member)
                index.append((page_id, url, name, at, len(member), len(body), digest, "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), _INDEX_ARROW.types)], schema=_INDEX_ARROW)
                index = []
        if out is not None:
            out.close()

    return save(rows.mapInArrow(run, _INDEX), "warc-index")


def read_ranges(filesystem: pafs.FileSystem, path: str, ranges: list[tuple[int, int]]):
    """Bytes of each range (offset, length; sorted by offset) of a file, near ones from a common read."""
    with filesystem.open_input_file(path) as f:
        i = 0
        while i < len(ranges):
            j, end = i + 1, sum(ranges[i])
            while j < len(ranges) and ranges[j][0] - end <= GAP_BYTES and sum(ranges[j]) - ranges[i][0] <= SPAN_BYTES:
                end = max(end, sum(ranges[j]))
                j += 1
            span = f.read_at(end - ranges[i][0], ranges[i][0])
            for offset, length in ranges[i:j]:
                yield span[offset - ranges[i][0] :][:length]
            i = j


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary"


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that index (rows of the index, selected at will) names, read back from the archives.

    Rows are dealt by file and stretch of SPAN_BYTES into a task for each SPAN_BYTES that they name, and sorted by
    offset; ranges with small gaps are read at once.
    Size and digest of a response are computed from the payload that was read (intact: they equal the record's
    header); a revisit has those of its header. payloads: whether payloads are returned.
    """
    # A number of partitions of its own: index rows are tiny, while the bytes that they name are not.
    spans = -(-(index.agg(F.sum("length")).first()[0] or 0) // SPAN_BYTES)
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), spans)
    dealt = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN_BYTES).alias("stretch")).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def rows(filesystem, root, name, ranges):
        for member in read_ranges(filesystem, f"{root}/{name}", ranges):
            r = parse(member)
            intact = True
            if r["payload"] is not None:
                size, digest = len(r["payload"]), hashlib.sha1(r["payload"]).hexdigest()
                intact = (size, digest) == (r["payload_bytes"], r["payload_digest"])
                r["payload_bytes"], r["payload_digest"] = size, digest
            yield r | {"intact": intact, "payload": r["payload"] if payloads else None}

    def run(batches):
        filesystem, root = open_fs(folder)
        for batch in batches:
            files: dict[str, list] = {}
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns[:3])):
                files.setdefault(name, []).append((offset, length))
            out = []
            for name, ranges in files.items():
                for r in rows(filesystem, root, name, ranges):
                    out.append([r[n] for n in names])
                    if len(out) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return dealt.mapInArrow(run, _RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first THEN first END AS refers_to,
  TRUE AS intact
FROM m
"""
