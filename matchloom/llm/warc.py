"""WARC archives: pages written as records in segments, and read back by reassembly.

Method.  A response record holds the page as an HTTP message in chunked transfer framing.  Blocks longer than ``segment`` bytes are cut: the
first piece keeps the record's headers, the rest follow as continuation records that name it as their origin, are numbered, and end with the total
length.  Reading parses every archive into records, groups continuation records with their origin by its identifier, orders them by
segment number, verifies that numbers have no gap and lengths add up to the total, decodes the chunks and compares the payload's digest.
Of records with equal payloads of at least ``LEAST`` bytes the one with the largest page id is a response and the others are revisits without
payload, which are resolved by digest when read back.

Scale.  Writing shuffles digests alone (pre-aggregated), not pages: the table of repeated digests is measured, then broadcast up to ``BROADCAST_BYTES``; beyond that
pages move once, those of the (at most ``HOT``) most repeated digests apart from the shuffle.  An archive file holds at most ``RECORDS`` records, so
that reading it takes RECORDS * segment bytes and their headers at most; more data make more files.  Reading shuffles only records that are in pieces.
A group is one page's pieces.  Spark's text writer commits the files, so lost executors leave no half archives.

Edge cases.  Null html is an empty page, a null or repeated url or page id is kept as it is (a null id is smaller than all others).  Rows that repeat the largest page id of
equal payloads are all responses.  Blanks, controls and characters beyond ASCII in a url are percent-encoded in the archive.  Other columns are ignored.  An empty
table gives no records.  Reading never fails on a damaged record: ``problem`` names what is wrong ("segments", "total length", "chunks", "digest",
"truncated"), and the payload is what could be read; a revisit without its response has null length and referrer.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Payloads below this many bytes are never told by reference.
LEAST = 1000
SEGMENT, CHUNK, RECORDS = 4096, 2048, 4096
BROADCAST_BYTES, HOT = 8 << 20, 1000
#: Fixed names of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD = "record_id string, origin string, number int, total long, record_type string, page_id string, uri string, digest string, block binary, problem string"
PAGE = "record_id string, record_type string, page_id string, uri string, digest string, payload_bytes long, payload_digest string, payload binary, problem string"


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "utf-8")


def framed(content: bytes, chunk: int = CHUNK) -> bytes:
    """The bytes in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (content[k : k + chunk] for k in range(0, len(content), chunk))]
    return b"".join(out) + b"0\r\n\r\n"


def unframed(block: bytes) -> tuple[bytes, bool]:
    """The bytes of a message in chunked framing, and whether the framing was whole; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while (end := block.find(b"\r\n", at)) >= 0:
        size = block[at:end].split(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            break
        n, start = int(size, 16), end + 2
        if not n:
            return b"".join(out), block.endswith(_END) or block.startswith(b"\r\n", start)
        out.append(block[start : start + n])
        at = start + n + 2
        if block[at - 2 : at] != b"\r\n":
            break
    return b"".join(out), False


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records(page: object, url: str | None, content: bytes, digest: str, refers: bool, date: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end them."""
    name = uuid.uuid4().urn
    fields = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", PROFILE if refers else None), ("X-Page-Id", page), ("Content-Type", "application/http;msgtype=response"),
    ]
    block = _HTTP + b"\r\n" if refers else _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + framed(content, chunk)
    pieces = [block[k : k + segment] for k in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", 1)], pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        total = len(block) if number == len(pieces) else None
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{name}>")]
        yield _record([*own, ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], piece)


def looked_up(rows: DataFrame, table: DataFrame, path: str, key: str, count: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows with what the table at ``path`` tells of their key, if anything; ``count`` is how many rows a key has."""
    if shared.size(rows.sparkSession, path) <= broadcast_bytes:
        return rows.join(F.broadcast(table.drop(count)), key, "left")
    names = [c for c in table.columns if c not in (key, count)]
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total  # so many keys at most
    near = table.where(hot).select(F.col(key), F.struct(*names).alias("__near"))
    rows = rows.join(F.broadcast(near), key, "left")
    # rows of hot keys are spread by values that no key has
    spread = F.concat(F.lit("-"), F.xxhash64(*[c for c in rows.columns if c != "__near"]).cast("string"))
    far = table.where(~hot).select(F.col(key).alias("__far_key"), F.struct(*names).alias("__far"))
    rows = rows.withColumn("__far_key", F.when(F.col("__near").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key))).join(far, "__far_key", "left")
    return rows.select(*[c for c in rows.columns if c not in ("__near", "__far_key")], *(F.coalesce(F.col("__near")[c], F.col("__far")[c]).alias(c) for c in names))


def write(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Writes the pages (page_id, url, html) as gzipped archives into a new folder."""
    content = payload(F.col("html"))
    rows = pages.select(F.col("page_id").alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("digest", F.sha1(content))
    leaders = rows.where(F.octet_length(content) >= LEAST).groupBy("digest").agg(F.max("page").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders, where = shared.written(leaders, "leaders")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, url, html, digest, refers = (c.to_pylist() for c in batch.columns)
            out, held = [], 0
            for row in zip(page, url, html, digest, refers):
                for one in records(row[0], row[1], row[2] or b"", row[3], row[4], date, segment, chunk):
                    out.append(one)
                    held += len(one)
                    if held > shared.BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    refers = F.coalesce(F.col("leader").isNotNull() & ~F.col("page").eqNullSafe(F.col("leader")), F.lit(False))
    rows = looked_up(rows, leaders, where, "digest", "n", broadcast_bytes).select(F.col("page").cast("string"), "url", F.when(~refers, F.encode("html", "utf-8")).alias("html"), "digest", refers.alias("refers"))
    made = shared.bounded(rows).mapInArrow(run, "record binary")
    # the line end of the text writer is the end of a record; bytes pass through it as they are
    made.select(F.col("record").cast("string")).write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    shared.drop(pages.sparkSession, where)


def inflated(content: bytes) -> bytes:
    """An archive's bytes, as they are or from one or many gzip members; a damaged end is left out."""
    out = []
    while content[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(47)
        try:
            out.append(stream.decompress(content) + stream.flush())
        except zlib.error:
            break
        content = stream.unused_data
    return b"".join(out) if out else content


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.strip().isdecimal() else None


def parse(content: bytes) -> Iterator[tuple]:
    """The records of an archive, as rows of ``RECORD``; types other than response, revisit, resource and continuation are passed over."""
    at, size = content.find(b"WARC/"), len(content)
    while 0 <= at < size:
        end = content.find(_END, at)
        fields = {}
        for line in content[at : end if end >= 0 else size].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        length = _number(fields.get("content-length"))
        start = end + 4
        whole = end >= 0 and length is not None and start + length <= size
        block = content[start : start + (length or 0)] if end >= 0 else b""
        kind, name = fields.get("warc-type"), fields.get("warc-record-id")
        digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
        if kind in ("response", "revisit", "resource", "continuation"):
            problem = None if whole else "truncated"
            yield name, fields.get("warc-segment-origin-id", name), _number(fields.get("warc-segment-number")), _number(fields.get("warc-segment-total-length")), kind, fields.get("x-page-id"), fields.get("warc-target-uri"), digest, block, problem
        at = content.find(b"WARC/", start + length) if whole else -1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)


_STRING, _LONG = pa.string(), pa.int64()
_RECORD = pa.schema([("record_id", _STRING), ("origin", _STRING), ("number", pa.int32()), ("total", _LONG), ("record_type", _STRING), ("page_id", _STRING), ("uri", _STRING), ("digest", _STRING), ("block", pa.binary()), ("problem", _STRING)])


def _finished(row: tuple, wanted: bool) -> tuple:
    """A row of ``PAGE`` from a record whose block is whole."""
    name, _, _, _, kind, page, uri, digest, block, problem = row
    if kind == "revisit":
        return name, kind, page, uri, digest, None, digest, None, problem
    head, _, body = (b"", b"", block) if kind == "resource" else block.partition(_END)
    whole = True
    if any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")):
        body, whole = unframed(body)
    found = hashlib.sha1(body).hexdigest()
    problem = problem or (None if whole else "chunks") or (None if digest is None or digest.lower() == found else "digest")
    return name, kind, page, uri, digest, len(body), found, body if wanted else None, problem


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("record_id", _STRING), ("record_type", _STRING), ("page_id", _STRING), ("uri", _STRING), ("digest", _STRING), ("payload_bytes", _LONG), ("payload_digest", _STRING), ("payload", pa.binary()), ("problem", _STRING)]
    return _table(rows, pa.schema(kinds))


def read(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """A row for each response, resource and revisit record of the archives in a folder, as ``PAGE`` tells; ``content`` False leaves the payloads out."""
    archives = spark.read.format("binaryFile").load(path).select("content")

    def scanned(pieces: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for archive in batch.column(0):
                    rows, held = [], 0
                    for row in parse(inflated(archive.as_py())):
                        if (row[2] is not None) == pieces:
                            rows.append(row if pieces else _finished(row, content))
                            held += len(row[8])
                            if held > shared.BATCH_BYTES:
                                yield _table(rows, _RECORD) if pieces else _pages(rows)
                                rows, held = [], 0
                    yield _table(rows, _RECORD) if pieces else _pages(rows)

        return run

    def reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, first, parts in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = [p["number"] for p in parts]
                block = b"".join(p["block"] for p in parts)
                problem = next((p["problem"] for p in parts if p["problem"]), None)
                if first is None or numbers != list(range(1, len(parts) + 1)):
                    problem = problem or "segments"
                if parts[-1]["total"] != len(block):
                    problem = problem or "total length"
                first = first or dict.fromkeys(("record_type", "page_id", "uri", "digest"))
                rows.append(_finished((origin, origin, 1, None, first["record_type"], first["page_id"], first["uri"], first["digest"], block, problem), content))
            yield _pages(rows)

    whole = shared.bounded(archives).mapInArrow(scanned(False), PAGE)
    pieces = archives.mapInArrow(scanned(True), RECORD)
    head = F.struct("record_type", "page_id", "uri", "digest")
    grouped = pieces.groupBy("origin").agg(
        F.max(F.when((F.col("number") == 1) & (F.col("record_type") != "continuation"), head)).alias("first"), F.sort_array(F.collect_list(F.struct("number", "total", "problem", "block"))).alias("parts")
    )
    return whole.union(grouped.mapInArrow(reassembled, PAGE))


def resolved(facts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``read`` with revisits filled in from the response of their digest: payload_bytes and refers_to, its page id."""
    spark = facts.sparkSession
    again = facts.where("record_type = 'revisit'").groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"))
    page = F.struct(F.length("page_id"), "page_id", "payload_bytes")  # numbers as text: the longer is the larger
    told = facts.where(f"record_type = 'response' AND payload_bytes >= {LEAST}").join(again, "payload_digest").groupBy("payload_digest").agg(F.max("n").alias("n"), F.max(page).alias("r"))
    told, path = shared.written(told.select("payload_digest", "n", F.col("r.page_id").alias("refers_to"), F.col("r.payload_bytes").alias("there")), "responses")
    found = looked_up(facts, told, path, "payload_digest", "n", broadcast_bytes)
    revisit = F.col("record_type") == "revisit"
    return found.withColumn("payload_bytes", F.when(revisit, F.col("there")).otherwise(F.col("payload_bytes"))).withColumn("refers_to", F.when(revisit, F.col("refers_to"))).drop("there")


def round_trip(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and problem of every page, as read back from its archive."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = shared.reserved(spark, "archives")
    write(pages, path, segment, chunk, broadcast_bytes)
    facts, _ = shared.written(read(spark, path, content=False).drop("payload"), "facts")
    shared.drop(spark, path)
    out = resolved(facts, broadcast_bytes)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "problem")


#: The same over ``pages``, for DuckDB.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= {LEAST} THEN max(page_id) OVER (PARTITION BY digest) END AS leader FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN leader IS NULL OR leader IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN leader IS DISTINCT FROM page_id THEN leader END AS refers_to, NULL::VARCHAR AS problem
FROM m
"""
