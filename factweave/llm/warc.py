"""WARC archives: write, read back, reassemble segments.

A record is the header, a blank line and the block; records end in two line breaks, which is the line separator of
Spark's text writer and reader here, so archives go through the cluster's own file system and no file is held whole.
Blocks are HTTP responses in chunked transfer framing. A block above SEGMENT bytes is split: the first segment keeps
the record's id, continuation records name it as origin and carry their number, the last one the total length.

Reading: Spark's text reader hands over each file in pieces, cut where a separator stands; the pieces are joined again
and records are framed by Content-Length alone, so a payload may hold separators and beginnings of records anywhere
(gzip files are read by one task, in order). Records without continuation are decoded where they are read. Segments are grouped by origin, ordered by number, checked for gaps and against the total
length, joined, and only then unchunked. A record that fails a check is returned with complete = false, never dropped.

Every record has an id of its own: <urn:page:ID> where one page has the id, else <urn:page:ID:PAYLOAD:ROW> with the
beginning of the payload's SHA-256 and a key of the row (task and row in it). A revisit of a payload whose page id is
shared names <urn:page:ID:PAYLOAD>, the common beginning of the ids of all equal responses.

Pages with equal payloads (SHA-256) of at least `least` bytes: the largest id is the response, the others revisit it.

Edge cases: null html is an empty payload; empty payloads are equal to each other if `least` is 0; a null url is left out
of the header; line breaks in a url are percent-coded; repeated rows are revisits or responses of their own; a null id
is written as an empty one and read back as null; an empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, table

SEGMENT = 32 * 1024
CHUNK = 8 * 1024
SEPARATOR = "\r\n\r\n"
MARK = b"WARC/1.1\r\n"
CUT = SEPARATOR + "WARC/1.1\r\n"


def base32(data: bytes) -> str:
    return base64.b32encode(data).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing. Chunk borders split what would look like the start of a record."""
    parts, at, cut = [], 0, CUT.encode()
    while at < len(payload):
        end = min(len(payload), at + size)
        found = payload.find(cut, at, end + len(cut))
        if found >= 0:
            end = min(end, found + len(SEPARATOR))
        parts += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """Undo chunked transfer framing; None if it is broken. Chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            size = int(body[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts)
        at = line + 2
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", len(block))] if v is not None)
    return MARK + head.encode() + b"\r\n" + block


def page_records(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, segment: int = SEGMENT, row: str = ""):
    """The records of one page, in order. row: what tells the page from others with its id, after a colon."""
    own = f"<urn:page:{'' if page_id is None else page_id}{row}>"
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        fields = [("WARC-Record-ID", own), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Payload-Length", len(payload))]
        yield _record("revisit", [*fields, ("Content-Type", "application/http;msgtype=response")], http)
        return
    block = http + chunked(payload)
    first = [("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        yield _record("response", first, block)
        return
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record("response", [*first, ("WARC-Segment-Number", 1)], pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        total = len(block) if number == len(pieces) else None
        yield _record("continuation", [("WARC-Record-ID", f"{own[:-1]}:{number}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], piece)


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, sha (the payload's) of pages that are revisits or share their id: refers_to (null for responses), shared,
    refers_shared (whether several pages have the id); from digests alone, hot payloads pre-aggregated."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select(F.col("page_id").cast("long"), F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("n"))
    keys = materialize(keys.groupBy("page_id", "sha", "n").agg(F.count("*").alias("rows")), "warc-digests")
    ids = keys.groupBy("page_id").agg(F.sum("rows").alias("m")).where("m > 1")
    ids = materialize(ids.select(F.col("page_id").alias("id_"), F.lit(True).alias("many_")), "warc-ids")
    equal = keys.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("keep"), F.sum("rows").alias("m")).where("m > 1")
    equal = equal.join(ids, F.col("keep") == F.col("id_"), "left").select(F.col("sha").alias("sha_"), "keep", F.col("many_").isNotNull().alias("refers_shared"))
    equal = materialize(equal, "warc-equal")
    mine = keys.join(equal, (F.col("sha") == F.col("sha_")) & (F.col("n") >= least), "left").join(ids, F.col("page_id").eqNullSafe(F.col("id_")), "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    mine = mine.select("page_id", "sha", refers_to.alias("refers_to"), F.col("many_").isNotNull().alias("shared"), F.coalesce("refers_shared", F.lit(False)).alias("refers_shared"))
    return mine.where("refers_to IS NOT NULL OR shared")


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Write a record per page (segments: several) as gzip text files of whole records."""
    found = decide(pages, least).withColumnsRenamed({"page_id": "id_", "sha": "sha_"})
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    rows = rows.join(found, rows["page_id"].eqNullSafe(found["id_"]) & (F.col("sha") == F.col("sha_")), "left")
    begin = F.concat(F.lit(":"), F.substring("sha", 1, 16))
    target = F.concat(F.col("refers_to").cast("string"), F.when(F.col("refers_shared"), begin).otherwise(""))
    rows = rows.select("page_id", "url", "payload", target.alias("refers_to"), F.col("refers_to").isNotNull().alias("revisit"), F.when(F.col("shared"), begin).alias("begin"))

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page_id, url, payload, refers_to, revisit, begin in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                digest = base32(hashlib.sha1(payload).digest())
                at += 1
                row = "" if begin is None else f"{begin}:{task}-{at}"
                for record in page_records(page_id, url, payload, digest, refers_to, revisit, segment, row):
                    out.append(record)
                    held += len(record)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def whole_records(fragments):
    """(fields, block) of each record of one file, from its pieces between separators, in order.

    The last record of a file that breaks off has what there is of its block; without a length, a record ends with its piece.
    """
    held, need, fields, at = bytearray(), None, {}, 0
    for k, fragment in enumerate(fragments):
        held += CUT.encode() + fragment if k else fragment
        while held:
            if need is None:
                if held.startswith(SEPARATOR.encode()):  # the end of the record before
                    del held[: len(SEPARATOR)]
                    continue
                gap = held.find(SEPARATOR.encode())
                if gap < 0:
                    break  # a block begins like a record: the header's blank line went with the separator
                fields, at = _fields(bytes(held[:gap]).removeprefix(MARK)), gap + len(SEPARATOR)
                length = fields.get("content-length", "")
                need = at + int(length) if length.isdigit() else len(held)
            if len(held) < need:
                break
            yield fields, bytes(held[at:need])
            del held[:need]
            need = None
    if held.strip():
        if need is None:
            fields, at = _fields(bytes(held).removeprefix(MARK)), len(held)
        yield fields, bytes(held[at:])


SEGMENTS = "origin string, number long, total long, type string, digest string, refers_to string, length long, block binary, payload_bytes long, payload_digest string, complete boolean"


def _read(path_df: DataFrame) -> DataFrame:
    """One row per record; records that are whole are decoded here and their block is dropped."""

    def run(batches):
        def row(fields, block):
            number = fields.get("warc-segment-number")
            base = [fields.get("warc-segment-origin-id") or fields.get("warc-record-id"), int(number) if number else None, int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, fields.get("warc-type"), fields.get("warc-payload-digest"), fields.get("warc-refers-to"), int(fields.get("warc-payload-length", -1))]
            if number:
                return [*base, block, None, None, None]
            return [*base, None, *decoded(base[3], base[4], base[6], block)]

        rows, held = [], 0
        pieces = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, file in groupby(pieces, key=lambda x: x[0]):
            for fields, block in whole_records(x for _, x in file):
                rows.append(row(fields, block))
                held += len(block)
                if held > 8_000_000:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    def packed(rows):
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return path_df.mapInArrow(run, SEGMENTS)


def decoded(kind, digest, length, block: bytes):
    """payload_bytes, payload_digest, complete of a whole block."""
    if kind == "revisit":
        return length, (digest or "").removeprefix("sha1:"), True
    head, _, body = block.partition(SEPARATOR.encode())
    payload = unchunked(body) if b"chunked" in head.lower() else body
    found = base32(hashlib.sha1(payload or b"").digest())
    return len(payload or b""), found, payload is not None and digest in (None, f"sha1:{found}")


def read(spark, path: str) -> DataFrame:
    """record_id, record_type, payload_bytes, payload_digest, refers_to, complete for every record of the archives."""
    fragments = spark.read.option("lineSep", CUT).text(path).select("_metadata.file_path", F.col("value").cast("binary"))
    rows = materialize(_read(fragments), "warc-records")
    whole = rows.where("number IS NULL").select("origin", "type", "refers_to", "payload_bytes", "payload_digest", "complete")

    def join(key, group):
        group = group.sort_values("number")
        block = b"".join(group["block"])
        first, total = group.iloc[0], group["total"].dropna()
        good = list(group["number"]) == list(range(1, len(group) + 1)) and len(total) == 1 and int(total.iloc[0]) == len(block)
        n, found, complete = decoded("response", first["digest"], None, block)
        return group.iloc[:1].assign(payload_bytes=n, payload_digest=found, complete=bool(good and complete))[["origin", "type", "refers_to", "payload_bytes", "payload_digest", "complete"]]

    parts = rows.where("number IS NOT NULL")
    joined = parts.groupBy("origin").applyInPandas(join, "origin string, type string, refers_to string, payload_bytes long, payload_digest string, complete boolean")
    return whole.unionByName(joined).withColumnsRenamed({"origin": "record_id", "type": "record_type"})


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)(?::[^>]*)?>$", 1).try_cast("long")
    return read(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "complete")


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * i}) & 31 AS INT) + 1, 1)" for g in range(4) for i in range(8))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
k AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS complete
FROM p JOIN k ON p.h = k.h
"""
