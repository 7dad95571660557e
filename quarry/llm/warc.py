"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each task writes one archive of gzip members, a record each, and returns the index of it: per record the file, offset,
length, URL and payload digest. The index is a table; reading selects from it, sorts by file and offset, joins ranges that lie
close together into one read, and parses the records out of that. Equal payloads are stored once: the
record that keeps the payload is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_folder, shuffle_partitions, split_batches, written
from .files import create, opened

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
#: Ranges of a file with at most so many bytes between them are read at once, up to so many bytes.
GAP, MOST_READ = 64 << 10, 8 << 20


def _record(page: dict, payload: bytes) -> bytes:
    """One record. The page's own number is kept in the record's URN, its HTTP header tells the full payload's length."""
    response = page["refers_to"] is None
    digest = "sha1:" + base64.b32encode(bytes.fromhex(page["payload_digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    url = "".join(c if " " < c else f"%{ord(c):02X}" for c in page["url"] or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:quarry:page:{page['page_id']}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: {digest}"]
    if not response:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:quarry:page:{page['refers_to']}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record's bytes, names in lower case."""

    def fields(part: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest): of the html in UTF-8, null as empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "utf-8")).alias("payload_digest"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000, level: int = 1) -> DataFrame:
    """Write ``pages(page_id, url, html, ...)`` as WARC files below ``folder`` and return their index.

    The index has a row for each page: page_id, url, payload_digest, file, offset, length. Of pages with equal payloads of
    at least ``min_bytes`` bytes the largest page_id keeps the payload; with repeated page ids every row of that id does.
    Null html is an empty payload, a null url an empty one; rows with a null page_id are left out. A payload may be as long as a row can
    be; an empty table has an empty index; other columns are not read, whatever their names.
    """
    digested = with_digests(pages.where("page_id IS NOT NULL"))
    # what pages with one payload have in common is a maximum: partial sums leave a row for each payload and task
    kept = digested.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "keeper")
    refers = F.when(F.col("keeper") != F.col("page_id"), F.col("keeper"))
    kept = written(kept, f"{folder}/kept")
    # a shuffle by digest would carry the html, a hot payload's to one task
    planned = digested.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "payload_digest", "left").select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, at = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in split_batches(batches, "html"):
            file = file or create(name)
            offsets, lengths = [], []
            html = batch.column(2).to_pylist()
            for page, text in zip(batch.select(["page_id", "url", "payload_digest", "refers_to"]).to_pylist(), html, strict=True):
                data = _member(_record(page, text.encode()), level)
                file.write(data)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            n = batch.num_rows
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array([name] * n), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "url", "payload_digest", "file", "offset", "length"])
        if file is not None:
            file.close()

    return written(planned.mapInArrow(run, "page_id long, url string, payload_digest string, file string, offset long, length long"), f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> Iterator[tuple[int, int, list[int]]]:
    """(offset, length, numbers of the ranges inside) of the reads that fetch ``ranges``, which ascend by offset."""
    start = end = 0
    inside: list[int] = []
    for i, (offset, length) in enumerate(ranges):
        if inside and (offset - end > gap or max(end, offset + length) - start > most):
            yield start, end - start, inside
            inside = []
        if not inside:
            start, end = offset, offset
        end = max(end, offset + length)
        inside.append(i)
    if inside:
        yield start, end - start, inside


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the rows of ``index`` select: (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    A response's length and digest are measured on the payload as read; one whose header says otherwise raises
    ``ValueError``. A revisit has those that its header tells and a null ``payload``; :func:`resolved` checks them. Work is dealt out by
    file and range of offsets, so that a large archive is read by many tasks.
    """
    spark = index.sparkSession
    by = [F.col("file"), F.col("offset")]
    chosen = index.select("file", "offset", "length").repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str) -> int:
        return int(urn.strip("<>").rpartition(":")[2])

    def record(raw: bytes) -> tuple:
        warc, http, payload = parse_record(raw)
        page, url = number(warc["warc-record-id"]), warc["warc-target-uri"]
        told = int(http["content-length"]), base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
        if warc["warc-type"] != "response":
            return page, url, *told, warc["warc-type"], number(warc["warc-refers-to"]), None
        own = len(payload), hashlib.sha1(payload).hexdigest()
        if own != told:
            raise ValueError(f"the payload of page {page} is not what its header says")
        return page, url, *own, "response", None, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            first = 0
            while first < len(rows):
                last = first
                while last < len(rows) and rows[last]["file"] == rows[first]["file"]:
                    last += 1
                with opened(rows[first]["file"]) as file:
                    ranges = [(r["offset"], r["length"]) for r in rows[first:last]]
                    for start, length, inside in coalesced(ranges):
                        file.seek(start)
                        data = memoryview(file.read(length))
                        out = [record(zlib.decompress(data[offset - start : offset - start + size], 31)) for offset, size in (ranges[i] for i in inside)]
                        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)][: len(names)], names)
                first = last

    return chosen.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def resolved(records: DataFrame) -> DataFrame:
    """The same rows; a revisit's length and digest are those measured on the response that it refers to. One without such a response fails the query.

    The responses referred to are fewer than the payloads that repeat: they are found by distinct ids and broadcast if they are few.
    """
    revisits = records.where("record_type <> 'response'")
    wanted = revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    found = records.where("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes").join(wanted, ["page_id", "payload_digest"], "left_semi")
    found = found.distinct().select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("measured"))
    joined = records.join(F.broadcast(found) if wanted.count() <= BROADCAST_ROWS else found, ["refers_to", "payload_digest"], "left")
    same = (F.col("record_type") == "response") | F.col("measured").eqNullSafe(F.col("payload_bytes"))
    fault = F.raise_error(F.concat(F.lit("no response with that payload for the revisit of page "), F.col("page_id").cast("string"))).cast("long")
    return joined.withColumn("payload_bytes", F.when(same, F.col("payload_bytes")).otherwise(fault)).select(*records.columns)


def round_trip(pages: DataFrame, min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Write the archives (in a new shared folder unless one is named) and read every record back, revisits by the responses they refer to.

    A row for each row of ``pages`` with a page_id, repeated ids included; null html is an empty payload; nothing for an empty table.
    Other columns are not read, whatever their names.
    """
    return resolved(written(read_records(write_archives(pages, folder or shared_folder(pages.sparkSession), min_bytes))))
