"""WARC archives: a writer that deduplicates payloads by revisit records, and a splittable reader.

Archives are files of gzip members, a member for each record.  A reading task gets a range of bytes, looks for the gzip
magic from the range's start, takes the first place whose member decodes to a WARC header, and from there follows
members one after another; it owns the records that start inside its range, however far they reach.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.llm.shared import scratch, written

MAGIC = b"\x1f\x8b\x08"
_EPOCH = "1970-01-01T00:00:00Z"
MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "path string, start long, record_type string, record_id string, target_uri string, refers_to_id string, "
    "payload_digest string, payload_length long, payload binary"
)


def file_system(path: str):
    """The file system of a path and the path inside it; a path without a scheme is local."""
    from pyarrow import fs

    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None, level: int = 6) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP head, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {_EPOCH}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri),
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


def write(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes records (kind, record_id, uri, payload, refers_to_id) as archives in folder; returns the manifest.

    A file for each partition; it appears under its final name, which depends on the partition alone, once it is whole,
    so a task that runs again after a lost executor replaces it.
    """

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        final = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft = f"{final}.{uuid.uuid4().hex}.tmp"
        size = n = 0
        with files.open_output_stream(draft, compression=None) as out:
            for pdf in batches:
                for kind, rid, uri, payload, ref in zip(pdf.kind, pdf.record_id, pdf.uri, pdf.payload, pdf.refers_to_id):
                    data = record_bytes(kind, rid, uri or "", bytes(payload or b""), None if pd.isna(ref) else ref, level)
                    out.write(data)
                    size, n = size + len(data), n + 1
        if n:
            files.move(draft, final)
            yield pd.DataFrame({"path": [final], "bytes": [size], "records": [n]})
        else:
            files.delete_file(draft)

    rows = records.select("kind", "record_id", "uri", "payload", "refers_to_id")
    return written(rows.mapInPandas(archive, MANIFEST), "warc-manifest")


def parse_record(whole: bytes) -> dict:
    """The named parts of a decoded record."""
    head, _, block = whole.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    block = block[: int(fields.get("content-length", "0"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = len(payload)
    if fields.get("warc-type") == "revisit" and (m := re.search(rb"(?im)^content-length:\s*(\d+)", http)):
        length, payload = int(m[1]), b""
    bare = lambda x: x.strip("<>") if x else None
    return {
        "record_type": fields.get("warc-type"),
        "record_id": bare(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": bare(fields.get("warc-refers-to")),
        "payload_digest": (fields.get("warc-payload-digest") or "").partition(":")[2] or None,
        "payload_length": length,
        "payload": payload,
    }


def records_in(source, size: int, start: int, end: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of each record that starts in [start, end) of a file opened as source."""

    def decode(at: int) -> tuple[bytes, int] | None:
        """The member at an offset and the offset after it; None if there is no whole member with a WARC header."""
        source.seek(at)
        d, parts, pos, known = zlib.decompressobj(31), [], at, False
        while not d.eof:
            data = source.read(chunk if known else 4096)
            if not data:
                return None
            pos += len(data)
            try:
                parts.append(d.decompress(data))
            except zlib.error:
                return None
            if not known and sum(map(len, parts)) >= 5:
                if not b"".join(parts).startswith(b"WARC/"):
                    return None
                known = True
        return (b"".join(parts), pos - len(d.unused_data)) if known else None

    at, window = start, b""
    base = start
    while at < end:
        if found := decode(at):
            yield at, found[0]
            at = base = found[1]
            window = b""
            continue
        # no record starts here: on to the next magic
        at += 1
        while at < end:
            if at - base < 0 or at - base + len(MAGIC) > len(window):
                source.seek(at)
                base, window = at, source.read(chunk)
                if len(window) < len(MAGIC):
                    return
            k = window.find(MAGIC, at - base)
            if k >= 0:
                at = base + k
                break
            at = base + max(len(window) - len(MAGIC) + 1, at - base + 1)


def splits(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Byte ranges (path, start, stop) of about split_bytes, made where the manifest is, not on the driver."""
    return manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / split_bytes))).alias("k")
    ).select("path", (F.col("k") * split_bytes).alias("start"), F.least(F.col("bytes"), (F.col("k") + 1) * split_bytes).alias("stop"), F.col("bytes").alias("size"))


def read(spark: SparkSession, manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the archives that a manifest (path, bytes) lists, read by ranges of bytes in parallel.

    An empty archive has no records; one whose bytes hold no valid member has none either.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start, stop, size in zip(pdf.path, pdf.start, pdf.stop, pdf["size"]):
                files, inner = file_system(path)
                rows, held = [], 0
                with files.open_input_file(inner) as source:
                    for at, whole in records_in(source, int(size), int(start), int(stop)):
                        rows.append({"path": path, "start": at} | parse_record(whole))
                        held += len(whole)
                        if held > 16 << 20:
                            yield pd.DataFrame(rows)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    ranges = splits(manifest, split_bytes)
    # a task reads a range after another, 16 at the most; fewer where there are cores for more tasks
    n, wide = ranges.count(), 4 * spark.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(n, max(wide, n // 16))), "path", "start").mapInPandas(scan, RECORDS)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Records of pages (page_id, url, html): of equal payloads of `least` bytes or more, the page with the largest id is
    the response and the others revisit it; smaller payloads are all responses.

    A null html is an empty payload and a null url an empty one.  A row without an id counts below every id.  Of rows that
    repeat the largest id, the one with the last url is the response; of rows that agree in id, url and payload one is,
    and the others revisit it.  Rows are counted by digest, id and url, so no group of equal payloads meets in one task.
    """
    p = pages.select(
        F.col("page_id"), F.col("url").alias("uri"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    )
    p = p.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    each = p.where(F.col("bytes") >= least).groupBy("digest", "bytes", "page_id", "uri").agg(F.count("*").alias("rows"))
    large = each.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "uri", "rows")).alias("k"), F.sum("rows").alias("n")).where("n > 1")
    shared = written(large.select(F.col("digest").alias("_d"), F.col("bytes").alias("_b"), *[F.col(f"k.{c}").alias(f"_{c}") for c in ("page_id", "uri", "rows")]), "shared-payloads")
    p = p.join(shared, (F.col("digest") == F.col("_d")) & (F.col("bytes") == F.col("_b")), "left")
    keeper = F.col("page_id").eqNullSafe(F.col("_page_id")) & F.col("uri").eqNullSafe(F.col("_uri"))
    p = p.withColumn("own", F.col("_d").isNull() | keeper)
    if not shared.where("_rows > 1").isEmpty():
        again = F.col("_d").isNotNull() & F.col("own") & (F.col("_rows") > 1)
        one = p.where(again).groupBy("digest", "bytes", "page_id", "uri", "_page_id", "_rows").agg(F.first("payload").alias("payload"))
        one = one.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("copy")).withColumn("own", F.col("copy") == 1)
        names = ["page_id", "uri", "payload", "own", "_page_id"]
        p = p.where(~again).select(*names).unionByName(one.select(*names))
    ident = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return p.select(
        F.when(F.col("own"), "response").otherwise("revisit").alias("kind"),
        ident(F.col("page_id")).alias("record_id"),
        "uri",
        "payload",
        F.when(~F.col("own"), ident(F.col("_page_id"))).alias("refers_to_id"),
    )


def round_trip(pages: DataFrame, least: int = 1000, split_bytes: int = 8 << 20) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: page_id, url and the record's parts."""
    spark = pages.sparkSession
    manifest = write(with_revisits(pages, least), scratch(spark, "warc"))
    number = lambda c: F.when(F.col(c).rlike("^urn:page:-?[0-9]+$"), F.substring(c, 10, 20).cast("long"))
    back = read(spark, manifest, split_bytes)
    return back.withColumn("page_id", number("record_id")).withColumn("refers_to", number("refers_to_id"))
