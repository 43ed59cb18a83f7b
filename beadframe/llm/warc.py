"""WARC archives: a deduplicating writer and a salvage reader.

The writer makes one record a page with Spark's text writer: the line separator is the
record's end, so files are plain WARC/1.1. Payloads that were stored before become
``revisit`` records that keep the HTTP headers only.

The reader takes plain and gzip-member archives. Where a check fails (version line,
headers, length, record end, member checksum, payload digest) it searches for the next
place that reads as a valid member or record, goes on from there, and logs the bytes in
between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, materialise, scratch_path

LEAST_BYTES, SALTS, FILE_BYTES, MEMBER_BYTES = 100, 16, 1 << 28, 1 << 30
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOUND = "path string, offset long, length long, kind string, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def records(pages: DataFrame, html: str = "html", id: str = "page_id", url: str = "url", date: str = "1970-01-01T00:00:00Z", least: int = LEAST_BYTES) -> DataFrame:
    """Columns ``value``, each page's record without its end, and ``n``, its payload's bytes.

    Of pages with equal payloads of ``least`` bytes or more, the one with the smallest id
    is the response (rows that share that id all are) and the others refer to it. Null
    html is an empty payload, a null id or url leaves its header out; pages without id
    never are referred to. Payloads and urls of any length are written whole; other
    columns are not read, whatever their names.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "n": F.octet_length("payload")})
    first = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min("id").alias("low"), F.count("*").alias("c"))
    first = materialise(first.where("c > 1 AND low IS NOT NULL").select("digest", "n", "low"), "warc-copies")
    # Only payloads that may have copies are shuffled; the bitmap says which may.
    may = in_bitmap(F.col("digest"), bitmap_of(first, "digest"))
    # A payload may be a third of all rows: each one's pages are dealt over SALTS tasks.
    salts = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.where(may).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    alone = rows.where(~may).withColumn("low", F.lit(None).cast("long"))
    joined = salted.join(salts, ["digest", "n", "salt"], "left").drop("salt").unionByName(alone)
    again = F.col("low").isNotNull() & ~F.col("low").eqNullSafe(F.col("id"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(END))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))
    value = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Profile", F.when(again, PROFILE)),
        line("WARC-Refers-To", F.when(again, urn(F.col("low")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(again, F.lit("")).otherwise(F.col("payload")),
    )
    return joined.select(value.alias("value"), "n")


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, html: str = "html", **options) -> None:
    """Writes the archives' folder; a file holds ``file_bytes`` of payload at most, or one record.

    Spark bounds a file by its records, so pages are written by classes of payload size,
    each with as many records a file as its largest ones allow. Most tables have one class
    or two; there are 16 at most, and only those that have pages are written.
    """
    every = records(pages, html=html, **options)
    size_class = lambda n: F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 4)
    found = pages.select(size_class(F.octet_length(F.coalesce(F.col(html).cast("string"), F.lit("")))).alias("c")).groupBy("c").count()
    small = 3  # below 64 kB pages share files
    classes = sorted({max(int(r["c"]), small) for r in found.collect()})  # at most 16
    for c in classes or [small]:
        rows = every.where(F.greatest(size_class(F.col("n")), F.lit(small)) == c).select("value")
        limit = max(1, file_bytes >> 4 * (c + 1))
        rows.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", limit).text(path)


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[int, dict, bytes]:
    """(end, headers, block) of the record at ``at``; Damaged with the reason if a check fails."""
    version = re.compile(rb"WARC/\d\.\d\r\n")
    if not version.match(data, at):
        raise Damaged("no version line")
    following = version.search(data, at + 1)  # headers of any length, but none reach over another version line
    head = data.find(b"\r\n\r\n", at, following.start() if following else len(data))
    if head < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    start, end = head + 4, head + 4 + int(length)
    if end + 4 > len(data):
        raise Damaged("record is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[start:end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha256:"):
        if hashlib.sha256(payload_of(block)[1]).hexdigest() != digest[7:].lower():
            raise Damaged("payload does not match its digest")
    return end + 4, headers, block


def payload_of(block: bytes) -> tuple[int, bytes]:
    """(payload length that the HTTP headers state, payload held)."""
    head, _, body = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
    return int(stated[1]) if stated else len(body), body


def parse_member(data: bytes, at: int, most: int = MEMBER_BYTES) -> tuple[int, dict, bytes]:
    """As :func:`parse_record`, for a gzip member that holds one record, of ``most`` bytes at most.

    It is fed in pieces, so what follows the member is not copied.
    """
    inflate, parts, size, end = zlib.decompressobj(31), [], 0, at
    try:
        while not inflate.eof and end < len(data):
            piece = data[end : end + 65536]
            parts.append(inflate.decompress(piece))
            size, end = size + len(parts[-1]), end + len(piece)
            if size > most:
                raise Damaged("gzip member is too large")
    except zlib.error as e:
        raise Damaged(f"gzip member: {e}") from None
    if not inflate.eof:
        raise Damaged("gzip member is cut off")
    plain = b"".join(parts)
    stop, headers, block = parse_record(plain, 0)
    if stop != len(plain):
        raise Damaged("gzip member holds more than a record")
    return end - len(inflate.unused_data), headers, block


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, end, headers, block) and ("gap", offset, end, reason), in order, without overlap."""
    at, gap, reason = 0, None, ""
    starts = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
    while at < len(data):
        try:
            end, headers, block = (parse_member if data.startswith(b"\x1f\x8b", at) else parse_record)(data, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            found = starts.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, headers, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row a record (kind ``record``) and a row a quarantined gap (kind ``gap``)."""

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def run(batches):
        kinds = [f.type for f in pa.schema([("s", pa.string()), ("l", pa.int64()), ("b", pa.binary())])]
        order = "sllsslsslls b".replace(" ", "")
        types = [kinds["slb".index(c)] for c in order]
        names = [f.split()[0] for f in FOUND.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                for kind, at, end, *rest in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append([file, at, end - at, kind, rest[0], *[None] * 7])
                    else:
                        h, (size, body) = rest[0], payload_of(rest[1])
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2] or hashlib.sha256(body).hexdigest()
                        rows.append([file, at, end - at, kind, None, number(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), number(h.get("warc-refers-to")), size, digest, body if with_payload else None])
                        held += len(body)
                    if len(rows) >= 2000 or held > 1 << 24:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, FOUND)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to new archives and returns what the reader finds in them.

    Repeated rows have a record each; of equal payloads with equal ids all are responses.
    An empty table gives an empty result.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path, with_payload=False)
