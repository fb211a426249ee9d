"""WARC archives (operator 2): an index of every record, and reads of byte ranges that follow from it.

Writing: each task writes one archive, a gzip member per record, under a name of its own in the shared
folder, and gives an index row per record: file, offset, length, URL, digest. The index is a Parquet table
that Spark commits, so it lists just the archives of tasks that counted; what a lost or repeated task left
is never read. Reading: the selected index rows are sorted by file and offset, neighbouring ranges are
coalesced into one read, and every record is parsed and its digest verified.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import files, new_folder, parallel, small_batches, table, written

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
_DATE = "2024-01-01T00:00:00Z"


def record_roles(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``pages`` (``page_id, url, html``) with ``payload_digest`` and ``refers_to``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the largest ``page_id`` is the response; rows
    with other ids revisit it. Rows that share the largest id are all responses; a null id is the least, and
    where all are null, all are responses. Only digests that occur twice go into the join.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= least_bytes).select("payload_digest", "page_id")
    chosen = large.groupBy("payload_digest").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n")).where("n > 1 and chosen is not null")
    chosen = written(chosen.select(F.col("payload_digest").alias("_digest"), "chosen"), "responses")
    rows = rows.join(chosen, F.col("payload_digest") == F.col("_digest"), "left")
    refers = F.when(F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen")), F.col("chosen"))
    return rows.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


_UNFIT = re.compile(r"[\x00-\x1f\x7f]|^ | $")


def _target(url: str | None) -> list[bytes]:
    """The target line: the URL as it is. One with controls, or blanks at its ends, would not survive in a header: there
    these and the percent sign are escaped, and a line of its own says so."""
    if url is None:
        return []
    if not _UNFIT.search(url):
        return [b"WARC-Target-URI: " + url.encode()]
    return [b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url).encode(), b"X-Target-URI-Escaped: 1"]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """One record: HTTP response headers, and unless it is a revisit the payload.

    Its id is made from ``place``, the archive and offset, so no two records share one; page ids are in lines of their own.
    A revisit names the page that it repeats, and its digest.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <%s>" % uuid.uuid5(uuid.NAMESPACE_URL, place).urn.encode(), b"WARC-Date: " + _DATE.encode(),
        *([b"X-Page-ID: %d" % page_id] if page_id is not None else []), *_target(url), b"WARC-Payload-Digest: sha1:" + digest.encode(),
        *([] if refers_to is None else [b"X-Refers-To-Page-ID: %d" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` (None of a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    kind = fields[b"warc-type"].decode()
    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields[b'warc-record-id']} differs from its digest")

    def page(name: bytes) -> int | None:
        return int(fields[name]) if name in fields else None

    uri = fields[b"warc-target-uri"].decode() if b"warc-target-uri" in fields else None
    if b"x-target-uri-escaped" in fields:
        uri = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), uri)
    return {
        "page_id": page(b"x-page-id"), "url": uri,
        "record_type": kind, "refers_to": page(b"x-refers-to-page-id"), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000) -> DataFrame:
    """Writes a record per row of ``pages`` to the folder ``path`` (a URI) and returns the index, a written table.

    Columns other than ``page_id, url, html`` are not archived. A null html is an empty payload; a null URL has
    no target line. No rows: no archive, an empty index.
    """
    small_batches(pages.sparkSession)
    fs, folder = files(path)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = files(path)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{folder}/{name}", compression=None)
            rows = batch.to_pydict()
            offsets, lengths = [], []
            for k in range(batch.num_rows):
                member = gzip.compress(record(rows["page_id"][k], rows["url"][k], rows["html"][k] or b"", rows["payload_digest"][k], rows["refers_to"][k], f"{name}/{at}"), 6, mtime=0)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            kinds = ["response" if x is None else "revisit" for x in rows["refers_to"]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([name] * batch.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column(3), pa.array(kinds), batch.column(4)],
                names=[x.split()[0] for x in INDEX.split(", ")],
            )
        if out:
            out.close()

    rows = record_roles(pages, least_bytes)
    rows = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"), "payload_digest", F.col("refers_to").cast("long"))
    return written(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[dict], gap: int, most: int) -> Iterator[list[dict]]:
    """Index rows in order of file and offset, in groups to read at once: gaps of at most ``gap``, ``most`` bytes."""
    group: list[dict] = []
    for r in rows:
        if group and (r["file"] != group[0]["file"] or not 0 <= r["offset"] - group[-1]["offset"] - group[-1]["length"] <= gap or r["offset"] + r["length"] - group[0]["offset"] > most):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def read_records(index: DataFrame, path: str, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """The records that ``index`` (all, or a selection of its rows) points to, with their payloads.

    Ranges at most ``gap`` bytes apart are read at once, up to ``most`` bytes; a longer record is read whole.
    A revisit has no payload of its own (null) but the size and digest of the one that it refers to.
    """
    small_batches(index.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = files(path)
        opened, name = None, None
        for batch in batches:
            for group in ranges(batch.to_pylist(), gap, most):
                if name != group[0]["file"]:
                    name = group[0]["file"]
                    opened = fs.open_input_file(f"{folder}/{name}")
                start = group[0]["offset"]
                raw = opened.read_at(group[-1]["offset"] + group[-1]["length"] - start, start)
                found = [parse(zlib.decompress(raw[r["offset"] - start : r["offset"] - start + r["length"]], 31)) for r in group]
                kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in kinds], names=[k for k, _ in kinds])

    rows = index.select("file", "offset", "length")
    dealt = rows.repartitionByRange(parallel(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: archives every page, then reads all records back."""
    path = new_folder(spark, "archives")
    index = write_archives(table(spark, sf_dir, "pages"), path)
    return read_records(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
top AS (SELECT digest, max(page_id) AS chosen FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM chosen AND chosen IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM chosen THEN chosen END AS refers_to
FROM p LEFT JOIN top USING (digest)
"""
