"""WARC archives with revisits instead of repeated payloads.

Headers, without payloads, are shuffled by payload digest; of records with equal payloads of at least min_bytes bytes
that with the smallest id is the response, the others become revisit records that refer to it. Only revisits are
joined to the pages again, by id and digest, so that a payload moves at most once, by a key that isn't skewed. Where an
id comes again with another payload (a recrawl), each payload has its own response or revisit.

Archives are written with Spark's text writer: a row is a record, the line separator the two line ends that close it.
So they go to any store that Spark writes to, and failed tasks leave nothing behind. Reading goes by Content-Length.

Archives are rolled by bytes: records of alike size go to files of so many records that a file, which is read as one
cell, stays small (SIZES). Sizes that no record has are not written.

Null payloads count as empty. Rows that repeat the smallest id of a payload are responses too; a null id never is
referred to, and its rows are responses. Other columns than those named are left out, whatever their names. An empty
table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.llm.common import materialize

EOL, CLOSE = "\r\n", "\r\n\r\n"
#: (payload bytes up to, records a file): a file holds about 64 MB at most, or one larger record.
SIZES = ((1 << 15, 2000), (1 << 20, 64), (None, 1))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits at a time, as four digits of base 32 in the RFC 4648 alphabet."""
    sha = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, digest: Column, kind: str) -> Column:
    """An id for each page, payload and kind of record: a page that comes again with another payload has another one."""
    h = F.md5(F.concat_ws(" ", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, refers_to, refers_to_url, payload_digest of the revisits, from page_id, url, payload_bytes, payload_digest
    of all records. Of rows that repeat a response's id, the least url counts."""
    long = headers.where(F.col("payload_bytes") >= min_bytes)
    least = F.min(F.struct("page_id", "url")).alias("least")
    first = long.where("page_id is not null").groupBy("payload_digest").agg(least, F.count("*").alias("n")).where("n > 1")
    first = first.select("payload_digest", F.col("least.page_id").alias("refers_to"), F.col("least.url").alias("refers_to_url"))
    return long.join(first, "payload_digest").where("page_id > refers_to").select("page_id", "refers_to", "refers_to_url", "payload_digest").distinct()


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))


def _record(date: str) -> Column:
    """A row's record without the line ends that close it."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("about:blank")), r"[\r\n]", "%0A")
    digest = F.col("payload_digest")
    page_id = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CLOSE))
    common = lambda kind: F.concat(
        _line("WARC-Record-ID", record_id(page_id, digest, kind)), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", clean("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _line("X-Page-ID", page_id), _line("X-Payload-Length", F.col("payload_bytes")),
    )
    revisit = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: revisit{EOL}"), common("revisit"), _line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", record_id(F.col("refers_to"), digest, "response")),
        _line("WARC-Refers-To-Target-URI", clean("refers_to_url")), _line("WARC-Refers-To-Date", F.lit(date)), _line("X-Refers-To-Page-ID", F.col("refers_to")), F.lit(f"Content-Length: 0{CLOSE}"),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: response{EOL}"), common("response"), F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
        _line("Content-Length", F.octet_length(http) + F.col("payload_bytes")), F.lit(EOL), http,
    )
    response = F.concat(head.cast("binary"), F.col("payload"))
    return F.when(F.col("refers_to").isNotNull(), revisit.cast("binary")).otherwise(response).cast("string")


def write(pages: DataFrame, path: str, min_bytes: int = 0, payload_col: str = "html", date: str | None = None, sizes: tuple = SIZES) -> None:
    """Write the pages (page_id, url, payload) as deduplicated archives below the new folder path, one folder a size.
    date: of all records, by default the time of writing."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    size = F.coalesce(F.octet_length(payload_col), F.lit(0)).cast("long")
    least = [0, *(most + 1 for most, _ in sizes[:-1])]
    tier = sum(((size >= x).cast("int") for x in least[1:]), F.lit(0))
    headed = pages.select("page_id", "url", payload.alias("payload"), size.alias("payload_bytes"), tier.alias("tier")).withColumn("payload_digest", payload_digest(F.col("payload")))
    used = {r[0] for r in pages.select(tier.alias("tier")).distinct().collect()} or {0}
    revisits = materialize(resolve(headed.select("page_id", "url", "payload_bytes", "payload_digest"), min_bytes), "warc-revisits")
    for i in sorted(used):
        rows = headed.where(F.col("tier") == i).join(revisits, ["page_id", "payload_digest"], "left")
        rows.select(_record(date).alias("value")).write.option("lineSep", CLOSE).option("maxRecordsPerFile", sizes[i][1]).text(f"{path}/size-{i}")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(EOL)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't closed")
        yield headers, data[end + 4 : stop]
        at = stop + 4


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null for revisits, or if
    payloads is false) of all records below path. A response's digest is worked out again and must be the one given."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for h, block in records(data.as_py()):
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} has another digest")
                    number = lambda k, h=h: int(h[k]) if h.get(k) else None
                    rows.append((number("X-Page-ID"), number("X-Payload-Length") if payload is None else len(payload), digest, kind, number("X-Refers-To-Page-ID"), h["WARC-Target-URI"], payload if payloads else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def restore(archive: DataFrame) -> DataFrame:
    """The archive's records with the payloads of revisits taken from the responses they refer to."""
    originals = archive.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("_original")).dropDuplicates(["refers_to", "payload_digest"])
    return archive.join(originals, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "_original")).drop("_original")
