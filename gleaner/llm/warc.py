"""WARC archives with an index first: write, index, and read selected records in coalesced byte ranges.

Writing yields one index row per record (file, offset, length, url, digest); each record is a gzip member of its own, so
a byte range is readable alone. Equal payloads are stored once: the record with the largest page_id holds the payload,
the others are revisits that carry its HTTP headers. Reading sorts the selected index rows by file and offset, joins
neighbouring ranges and parses the records out of them. A task writes to a file name of its own, and only the index that
was written to the shared folder names files, so files of failed attempts are never read.

Defined results: a null payload is empty; a null url has no target header; rows with a null page_id are always responses
and never referred to; of rows that share the largest page_id of a payload all are responses; other columns are ignored;
an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, fresh_path, materialize, table

DATE = "2000-01-01T00:00:00Z"
ROLL, GAP, RANGE = 1 << 30, 1 << 16, 1 << 23
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ID = "urn:gleaner:page:"


def open_path(path: str, mode: str):
    """A file of the shared folder: local and mounted ones directly, other stores through pyarrow."""
    local = re.sub(r"^file:(//)?", "", path) if path.startswith(("file:", "/")) else None
    if local is not None:
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name) if "w" in mode else store.open_input_file(name)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str) -> bytes:
    """One WARC record; refers_to makes it a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{page_id if page_id is not None else 'none:' + uuid.uuid4().hex}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; a digest that doesn't fit the stored bytes is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(rf"<{_ID}(-?\d+)>", x)) else None
    response = fields["WARC-Type"] == "response"
    found = digest(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (len(payload) != size or fields["WARC-Payload-Digest"] != "sha1:" + found):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": found, "payload": payload if response else None}


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, key, refers_to of the rows whose payload a larger page_id holds. Payloads are compared by SHA-256 and length, and never shuffled here."""
    slim = pages.select("page_id", F.sha2("payload", 256).alias("key"), F.length("payload").alias("size")).filter(F.col("size") >= min_bytes)
    groups = slim.groupBy("key", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1")
    return slim.join(groups, ["key", "size"]).filter("page_id < holder").select("page_id", "key", F.col("holder").alias("refers_to")).distinct()


def write_archive(df: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row below folder; returns the index, written to the shared folder."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = pages.withColumn("key", F.sha2("payload", 256)).join(revisits(pages, min_bytes), ["page_id", "key"], "left").drop("key")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        out, path, at = None, "", 0
        try:
            for b in batches:
                index: dict = {k: [] for k in ("offset", "length", "digest", "record_type", "file")}
                for page_id, url, payload, refers_to in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], strict=True):
                    if out is None or at > ROLL:
                        if out is not None:
                            out.close()
                        path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = open_path(path, "wb")
                    found = digest(payload)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, payload, refers_to, found)) + packer.flush()
                    out.write(raw)
                    for k, v in zip(index, (at, len(raw), found, "response" if refers_to is None else "revisit", path), strict=True):
                        index[k].append(v)
                    at += len(raw)
                yield {"page_id": b["page_id"], "url": b["url"], **index}
        finally:
            if out is not None:
                out.close()

    return materialize(arrow_rows(rows.select("page_id", "url", "payload", "refers_to"), run, INDEX), "warc-index")


def coalesce(ranges: list[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) joined into reads (file, offset, length, [(offset, length)]) with at most gap unused bytes between records."""
    out: list = []
    for file, offset, length in ranges:
        if out and out[-1][0] == file and offset - (out[-1][1] + out[-1][2]) <= gap and offset + length - out[-1][1] <= most:
            f, o, _, own = out[-1]
            out[-1] = (f, o, offset + length - o, [*own, (offset, length)])
        else:
            out.append((file, offset, length, [(offset, length)]))
    return out


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, parsed and checked against their digests."""
    chosen = index.select("file", "offset", "length").withColumn("chunk", F.floor(F.col("offset") / (4 * RANGE)))
    spread = chosen.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "chunk").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for file, offset, length, own in coalesce(list(zip(b["file"], b["offset"], b["length"], strict=True))):
                with open_path(file, "rb") as f:
                    f.seek(offset)
                    raw = f.read(length)
                rows = [parse(zlib.decompress(raw[o - offset : o - offset + n], 31)) for o, n in own]
                out = {k: [r[k] for r in rows] for k in rows[0]}
                if not payloads:
                    out["payload"] = [None] * len(rows)
                yield out

    return arrow_rows(spread.drop("chunk"), run, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archive(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
ORACLE: dict[str, str] = {}
