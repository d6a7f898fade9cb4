"""WARC archives: writing captures, reading records back, assembling transactions (operator 10).

A capture is a request, a response (or a revisit of an earlier one) and a
metadata record.  Request and metadata name their response through
``WARC-Concurrent-To``; assembly joins on that identifier and emits one
nested row per capture.  Archives are written and read through Spark, so any
file system that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import SALTS, materialise

#: Fixed values of the format.
CRLF = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads below this many bytes are always stored as responses.
LEAST_REVISIT = 100
#: Captures per archive file, so that a file stays small enough for one task.
FILE_CAPTURES = 20_000
DATE = "2024-01-01T00:00:00Z"

RECORD = ("type string, record_id string, concurrent_to string, refers_to string, target string, "
          "payload_digest string, payload_bytes long, fields string")


def _record(kind: str, rid: Column, uri: Column, headers: list[tuple[str, Column]], block: Column, mime: str) -> Column:
    """One record without its closing blank lines; NULL headers are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), rid, F.lit(">")),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines += [F.lit(f"Content-Type: {mime}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), block)


def _urn(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"urn:capture:{kind}:"), key)


def plan_captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with ``key, digest, bytes, first_key``.

    ``key`` tells rows apart: the page id, and for repeated ids a hash of the
    content.  ``first_key`` is the key of the smallest page id among equal
    payloads of at least ``least`` bytes; such a row is the response and the
    others revisit it.  Only digests are grouped and joined.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", "html").withColumns({
        "digest": F.sha2(body, 256), "bytes": F.octet_length(body).cast("long")}).withColumn(
        "key", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
                           F.hex(F.xxhash64("digest", "url"))))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write one capture per row of ``pages`` as gzipped WARC files under ``path``; return the capture plan.

    A NULL html is an empty payload, a NULL url an empty target.  The URL is
    one header line: control characters in it are percent-encoded.
    """
    planned = plan_captures(pages, least)
    small = materialise(planned.select("page_id", "key", "digest", "bytes"), "warc-plan")
    order = F.struct(F.col("page_id").isNull(), "page_id", "key")
    groups = small.filter(F.col("bytes") >= least).groupBy("digest").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A digest shared by a third of the pages meets SALTS copies of its group row, one per slice of page ids.
    spread = groups.select("digest", F.col("first.key").alias("first_key"),
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = materialise(
        small.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"])
        .filter("key <> first_key").select("key", "first_key").distinct(), "warc-revisits")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1F\x7F]", "%20")
    full = planned.join(revisits, "key", "left")
    kind = F.when(F.col("first_key").isNull(), "response").otherwise("revisit")
    rid = F.concat(F.lit("urn:capture:"), kind, F.lit(":"), F.col("key"))
    sha = F.concat(F.lit("sha256:"), F.col("digest"))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    request = _record("request", _urn("request", F.col("key")), uri, [("WARC-Concurrent-To", angle(rid))],
                      F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}")), "application/http; msgtype=request")
    response = _record("response", rid, uri, [("WARC-Payload-Digest", sha)],
                       F.concat(F.lit(HTTP_HEAD), F.coalesce("html", F.lit(""))), "application/http; msgtype=response")
    revisit = _record("revisit", rid, uri, [
        ("WARC-Payload-Digest", sha), ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", angle(_urn("response", F.col("first_key"))))],
        F.lit(HTTP_HEAD), "application/http; msgtype=response")
    meta = _record("metadata", _urn("metadata", F.col("key")), uri, [("WARC-Concurrent-To", angle(rid))],
                   F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF),
                            F.lit("payload-length: "), F.col("bytes").cast("string"), F.lit(CRLF)),
                   "application/warc-fields")
    capture = F.array(request, F.when(F.col("first_key").isNull(), response).otherwise(revisit), meta)
    # A record ends with two line ends, so they serve as the writer's line separator.
    full.select(F.explode(capture).alias("value")).write.option("lineSep", END).option("compression", "gzip") \
        .option("maxRecordsPerFile", 3 * FILE_CAPTURES).text(path)
    return small


def _parse(blocks: Iterator[bytes]) -> Iterator[tuple]:
    """Records of one archive, from its bytes; holds one record at a time."""
    buffer = b""
    for chunk in blocks:
        buffer += chunk
        at = 0
        while True:
            head = buffer.find(b"\r\n\r\n", at)
            if head < 0:
                break
            lines = buffer[at:head].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            start, size = head + 4, int(fields["content-length"])
            if len(buffer) < start + size + 4:
                break
            yield fields, buffer[start:start + size]
            at = start + size + 4
        buffer = buffer[at:]
    if buffer:
        raise ValueError(f"{len(buffer)} bytes after the last whole record")


def _chunks(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The archive's bytes; gzip members are decompressed piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        z, at = zlib.decompressobj(31), 0
        while at < len(content) and not z.eof:
            yield z.decompress(content[at:at + piece])
            at += piece
        yield z.flush()
        content = z.unused_data + content[at:]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; payloads stay in the tasks, their digests leave."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bare = re.compile(r"^<|>$")
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for f, block in _parse(_chunks(content)):
                    payload = block.partition(b"\r\n\r\n")[2] if f["warc-type"] == "response" else None
                    rows.append((
                        f["warc-type"], bare.sub("", f["warc-record-id"]),
                        bare.sub("", f["warc-concurrent-to"]) if "warc-concurrent-to" in f else None,
                        bare.sub("", f["warc-refers-to"]) if "warc-refers-to" in f else None,
                        f.get("warc-target-uri", ""),
                        hashlib.sha256(payload).hexdigest() if payload is not None
                        else f.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                        len(payload) if payload is not None else None,
                        block.decode("utf-8") if f["warc-type"] == "metadata" else None))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=NAMES)
                        rows = []
                yield pd.DataFrame(rows, columns=NAMES)
    # One archive per batch: a task holds one file's compressed bytes at a time.
    files = spark.read.format("binaryFile").load(path).select("content")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        return materialise(files.mapInPandas(parse, RECORD), "warc-records")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


NAMES = [x.split()[0] for x in RECORD.split(", ")]


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, request, metadata, origin``.

    Request and metadata are joined to their response or revisit by
    concurrent-to; ``origin`` is the response that a revisit refers to.  A
    capture without a request or metadata has NULL there, and records that
    name no capture are left out.  Captures that share an id (repeated pages)
    keep their rows; as origin they count once.  Every join key is unique per
    id except ``refers_to``, whose hot values are spread over salted copies.
    """
    got = records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "refers_to",
        F.struct("type", "target", "payload_digest", "payload_bytes").alias("response"))
    def concurrent(kind: str) -> DataFrame:
        return records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("capture_id")).agg(
            F.min(F.struct("record_id", "target", "fields")).alias(kind))
    named = got.join(concurrent("request"), "capture_id", "left").join(concurrent("metadata"), "capture_id", "left")
    page = F.nullif(F.regexp_extract(F.col("metadata.fields"), r"page-id: (\S*)", 1), F.lit("")).cast("long")
    named = materialise(named.withColumn("page_id", page), "warc-captures")
    wanted = named.filter(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("capture_id")).distinct()
    once = named.join(wanted, "capture_id").groupBy("capture_id").agg(F.min(F.struct("page_id", "response")).alias("origin"))
    origin = once.select(
        F.col("capture_id").alias("refers_to"), "origin",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return named.withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")) \
        .join(origin, ["refers_to", "salt"], "left").drop("salt")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` as archives under ``path``, read them back, one row per page (see ``assemble``)."""
    write_archives(pages, path)
    captures = assemble(read_records(pages.sparkSession, path))
    first = F.col("origin.response")
    return captures.select(
        "page_id", F.coalesce("response.payload_bytes", first["payload_bytes"]).alias("payload_bytes"),
        F.coalesce(F.when(F.col("response.type") == "revisit", first["payload_digest"]),
                   F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("origin.page_id").alias("refers_to"),
        F.col("response.target").alias("url"))
