"""WARC archives written and read as a chunked record table.

Writing is native: each row is one WARC record whose bytes the text writer puts out with the separator CR LF CR LF, which
is the end of a WARC record, into gzipped files on any file system Spark knows.  A payload above `chunk_bytes` becomes a
first segment and `continuation` records (WARC-Segment-Number), one row per record identifier and chunk number.

Reading streams: the text reader hands out the decompressed bytes between separators, and a state machine per partition
consumes them by Content-Length.  It carries the SHA-1 and the length of a payload from chunk to chunk (and from segment to
segment), so neither a file nor a record is ever held whole.

Of records with equal payloads of `min_revisit_bytes` or more, the one with the smallest id is the response; all others are
`revisit` records that refer to it and hold no payload.

Defined results: a null payload is empty; equal ids with equal payloads that are the smallest are all responses; a record
without an id refers to the smallest id like others, and is a response where no equal payload has an id; line ends in a URL
are percent-encoded; extra columns are not read; an empty table gives an archive without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import few, new_path, written

SEP = "\r\n\r\n"
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + SEP
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Base 32 of the SHA-1, from five hexadecimal digits (20 bits) to four letters at a time."""
    digest = F.sha1(data)
    four = [F.translate(F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32) for i in range(8)]
    return F.concat(*four)


def records(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int, chunk_bytes: int) -> DataFrame:
    """The chunked record table: record_id, chunk_no and the record's bytes without the separator that ends it."""
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    same = own.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    same = written(same.where("n > 1 and first is not null").select(F.col("digest").alias("its_digest"), F.col("bytes").alias("its_bytes"), "first"), "equal-payloads")
    index = few(same)
    own = own.join(index, (F.col("digest") == F.col("its_digest")) & (F.col("bytes") == F.col("its_bytes")), "left")
    own = own.withColumn("refers", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    revisit = F.col("refers").isNotNull()
    chunks = F.when(revisit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk_bytes))).cast("int")
    own = own.withColumn("chunks", chunks).withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.col("chunks"))))

    crlf = F.lit("\r\n")
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    uri = lambda n: F.concat(F.lit("<urn:page:"), name, F.lit(":"), n, F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value.cast("string"), crlf)
    only = lambda when, value: F.when(when, value).otherwise(F.lit(""))
    first, parts = F.col("chunk_no") == 1, F.col("chunks") > 1
    body = F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", (F.col("chunk_no") - 1) * chunk_bytes + 1, F.lit(chunk_bytes)))
    block = F.when(first, F.concat(F.lit(_HTTP.encode()), body)).otherwise(body)
    kind = F.when(revisit, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", uri(F.col("chunk_no"))),
        line("WARC-Date", F.lit(DATE)),
        only(first, line("WARC-Target-URI", clean)),
        only(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))),
        only(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(":1>"))), line("X-Payload-Length", F.col("bytes")))),
        only(parts, line("WARC-Segment-Number", F.col("chunk_no"))),
        only(parts & ~first, line("WARC-Segment-Origin-ID", uri(F.lit("1")))),
        only(parts & (F.col("chunk_no") == F.col("chunks")), line("WARC-Segment-Total-Length", F.col("bytes") + len(_HTTP))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(SEP),
    )
    own = own.withColumn("block", F.coalesce(block, F.lit(b"")))
    return own.select(uri(F.lit("1")).alias("record_id"), "chunk_no", F.concat(header.cast("binary"), F.col("block")).alias("record"))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK) -> None:
    """Archives of all rows under `path`; the segments of a record stand together in one file."""
    rows = records(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_revisit_bytes=min_revisit_bytes, chunk_bytes=chunk_bytes)
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEP).option("compression", "gzip").text(path)


class _Reader:
    """Consumes archive bytes in pieces of any size; gives ('data', header, bytes) for payload bytes and ('end', header, None)."""

    def __init__(self) -> None:
        self.buffer = b""
        self.header: dict[str, str] | None = None
        self.left = 0
        self.http = False  # still in the HTTP header of the block

    def feed(self, data: bytes) -> Iterator[tuple[str, dict[str, str], bytes | None]]:
        data = self.buffer + data if self.buffer else data
        self.buffer = b""
        at = 0
        while True:
            if self.header is None:
                while at < len(data) and data[at] in b"\r\n":
                    at += 1
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    self.buffer = data[at:]
                    return
                lines = data[at:end].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record here: {lines[0][:80]!r}")
                self.header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.left = int(self.header["content-length"])
                self.http = self.header["warc-type"] != "continuation"
                at = end + 4
            if self.http:
                end = data.find(b"\r\n\r\n", at, at + self.left)
                if end < 0 and len(data) - at < self.left:
                    self.buffer = data[at:]
                    return
                skip = (end + 4 if end >= 0 else at + self.left) - at
                at, self.left, self.http = at + skip, self.left - skip, False
            take = min(self.left, len(data) - at)
            if take:
                yield "data", self.header, data[at : at + take]
                at, self.left = at + take, self.left - take
            if self.left:
                return
            yield "end", self.header, None
            self.header = None


_CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk_no long, payload_offset long, data binary, sha1_so_far string, last boolean, payload_bytes long, payload_digest string"


def _stream(batches: Iterator[pa.RecordBatch], keep_data: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, _CHUNKS.split(", "), strict=True)])
    reader, sha, size, chunk, origin = _Reader(), hashlib.sha1(), 0, 0, {}
    rows: list[tuple] = []
    held = 0
    number = lambda x: int(x.split(":")[2]) if x and x.split(":")[2] != "null" else None
    b32 = lambda h: base64.b32encode(h.digest()).decode()
    for batch in batches:
        for piece in batch.column(0):
            for what, header, data in reader.feed(piece.as_py() + b"\r\n\r\n"):
                kind = header["warc-type"]
                if what == "data":
                    if keep_data:
                        if chunk == 0 and not origin:
                            origin = header
                        chunk += 1
                        sha.update(data)
                        rows.append((origin["warc-record-id"], number(origin["warc-record-id"]), "response", None, chunk, size, data, b32(sha.copy()), False, None, None))
                        held += len(data)
                    else:
                        sha.update(data)
                    size += len(data)
                    continue
                if kind != "continuation":
                    origin = header
                if header.get("warc-segment-number") and "warc-segment-total-length" not in header:
                    continue  # more segments follow
                if kind == "revisit":
                    total, digest = int(header["x-payload-length"]), header["warc-payload-digest"].removeprefix("sha1:")
                else:
                    total, digest = size, b32(sha)
                    if digest != origin["warc-payload-digest"].removeprefix("sha1:"):
                        raise ValueError(f"payload of {origin['warc-record-id']} doesn't match its digest")
                rows.append((origin["warc-record-id"], number(origin["warc-record-id"]), "revisit" if kind == "revisit" else "response", number(header.get("warc-refers-to")), chunk + 1, size, b"", digest, True, total, digest))
                sha, size, chunk, origin = hashlib.sha1(), 0, 0, {}
            if len(rows) >= 4096 or held >= 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, held = [], 0
    if reader.buffer.strip(b"\r\n") or reader.header is not None:
        raise ValueError("the archive ends within a record")
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str, *, keep_data: bool = True) -> DataFrame:
    """The chunk table of the archives under `path`: one row per record and chunk, with the digest carried so far; the row
    marked `last` closes a record with the length and digest of its whole payload.  Without `keep_data` only those rows."""
    raw = spark.read.option("lineSep", SEP).option("pathGlobFilter", "*.gz").schema("value string").text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(lambda rows: _stream(rows, keep_data), _CHUNKS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_warc(spark, path, keep_data=False).where("last")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(x: str) -> str:
    """Base 32 of 40 hexadecimal digits: 20 bits at a time, four letters each."""
    value = [f"CAST('0x' || substr({x}, {5 * i + 1}, 5) AS BIGINT)" for i in range(8)]
    return " || ".join(f"substr('{_BASE32}', CAST(({v} >> {5 * k}) & 31 AS BIGINT) + 1, 1)" for v in value for k in (3, 2, 1, 0))


ORACLE_SQL = f"""
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, payload_bytes, {_base32_sql("x")} AS payload_digest, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
