"""WARC archives of pages: written with revisits, segments and chunked bodies, and read back.

Writing: a page whose payload stands in another page of a smaller id becomes a revisit of it. The block of a
response is an HTTP message whose body has chunked transfer framing; a block longer than a segment is cut into
a first record and continuations, which name the first one's id as their origin. Spark's text sink writes the
records, one a row: the line separator is the blank lines that end a record, so any bytes can be written.

Reading: archives are gzip files, which Spark reads whole and in order, cut at the version line that starts a
record. A payload may hold that line too, so pieces are put together until they have the length that the
record's head names. Continuations are grouped by their origin, put in order of their segment numbers, held
against the total length, and joined to the first segment; then the chunks are decoded. A record that lacks
segments, bytes or a sound framing, or whose digest differs, is told in ``fault``, not dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisect.llm.common import HOT_KEYS, if_small, over_texts, scratch_dir, stored, table

VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
#: Bytes of a block in one record, bytes of a chunk of a body, and the least payload that is worth a revisit.
SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES = 1 << 14, 1 << 12, 100
DATE = "2020-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, payload) with ``digest`` (hex SHA-256 of the payload) and ``refers_to``: for payloads
    of at least ``least`` bytes the smallest page_id that has the same one, if it isn't the row's own.

    Rows that repeat the smallest id are the same page: none is a revisit. A null id is the smallest of none.
    Only digests that occur more than once are joined; those that many rows have are joined by broadcast.
    """
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    found = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    found = stored(found.filter("n > 1"))
    total = found.agg(F.sum("n")).first()[0] or 0
    hot, cold = found.filter(F.col("n") * HOT_KEYS > total), found.filter(F.col("n") * HOT_KEYS <= total)
    out = rows.join(F.broadcast(hot.select("digest", F.col("first").alias("hot"))), "digest", "left")
    out = out.join(if_small(cold.select("digest", F.col("first").alias("cold"))), "digest", "left")
    first = F.coalesce("hot", "cold")
    return out.withColumn("refers_to", F.when(~first.eqNullSafe(F.col("page_id")), first)).drop("hot", "cold")


def _id(page: int | None, digest: str) -> str:
    """The id of a page's record: records of one id hold one payload."""
    return f"<urn:page:{'none' if page is None else page}:{digest}>"


def _chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(kind: str, id_: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", id_), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return (VERSION + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n").encode() + block


def records(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a page, without the blank lines at their ends."""
    fields = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        fields.append(("WARC-Target-URI", safe))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _id(refers_to, digest))]
        yield _record("revisit", f"<urn:revisit:{'none' if page is None else page}:{digest}>", fields, head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk)
    own, count = _id(page, digest), -(-len(block) // segment)
    if count > 1:
        fields.append(("WARC-Segment-Number", "1"))
    yield _record("response", own, fields, block[:segment])
    for k in range(1, count):
        more = [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k + 1))]
        if k + 1 == count:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record("continuation", f"<urn:segment:{k + 1}:{own[1:-1]}>", more, block[k * segment : (k + 1) * segment])


#: Bytes of records or payloads that a task hands on at once.
BATCH_BYTES = 8 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES or len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def write_archives(pages: DataFrame, path: str, html: str = "html", segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, least: int = REVISIT_BYTES) -> None:
    """Writes a record (or several segments) for each row of pages (page_id, url, and the column of the payload:
    text or bytes, null is empty) to gzip files in a folder. Null ids and urls have no header; control
    characters and spaces of a url are escaped; an empty table gives an empty folder; other columns don't count."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = roles(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")), least)
    schema = pa.schema([("record", pa.binary())])

    def run(batches):
        def made():
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    for record in records(*row, segment, chunk):
                        yield (record,)

        yield from _batches(made(), schema, lambda r: len(r[0]))

    made = over_texts(rows.select("page_id", "url", "payload", "digest", "refers_to"), run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def payload_of(block: bytes) -> tuple[bytes | None, str | None]:
    """The body of an HTTP message without its transfer framing, or what is wrong with it."""
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        return None, "no HTTP header"
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in block[:cut].split(b"\r\n")[1:])}
    at = cut + 4
    if head.get(b"transfer-encoding", b"").lower() != b"chunked":
        size = head.get(b"content-length")
        if size is not None and (not size.isdigit() or int(size) > len(block) - at):
            return None, "body shorter than its length"
        return block[at : at + int(size)] if size is not None else block[at:], None
    parts = []
    while True:
        line = block.find(b"\r\n", at)
        text = block[at:line].partition(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", text):
            return None, "no chunk size"
        size, at = int(text, 16), line + 2
        if size == 0:
            return b"".join(parts), None
        if block[at + size : at + size + 2] != b"\r\n":
            return None, "chunk without its end"
        parts.append(block[at : at + size])
        at += size + 2


_RAW = "type string, id string, origin string, segment int, total long, page_id long, uri string, digest string, refers_to string, block binary, fault string"
_RAW_ARROW = pa.schema([("type", pa.string()), ("id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary()), ("fault", pa.string())])


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _parsed(record: bytes, fault: str | None) -> tuple:
    """The row of a record, without the version line."""
    cut = record.find(b"\r\n\r\n")
    lines = record[: max(cut, 0)].decode("utf-8", "replace").split("\r\n")
    f = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = _number(f.get("content-length")) or 0
    digest = (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None
    fields = (f.get("warc-type"), f.get("warc-record-id"), f.get("warc-segment-origin-id"), _number(f.get("warc-segment-number")), _number(f.get("warc-segment-total-length")), _number(f.get("x-page-id")), f.get("warc-target-uri"), digest, f.get("warc-refers-to"))
    return (*fields, record[cut + 4 : cut + 4 + size], fault)


def _needs(record: bytes) -> int | None:
    """How many bytes a record must have, as its head says; None if there is no whole head yet."""
    cut = record.find(b"\r\n\r\n")
    if cut < 0:
        return None
    size = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", record[: cut + 2])
    return cut + 4 + (int(size[1]) if size else 0)


def whole_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[bytes, str | None]]:
    """Records from pieces (file, bytes between version lines), in order; (record, fault)."""
    file, held, need = None, None, None
    mark = VERSION.encode()
    for name, piece in pieces:
        if name != file:
            if held is not None:
                yield b"".join(held), "cut off"
            file, held = name, None
            continue  # what stands before a file's first record
        if held is None:
            held, size = [piece], len(piece)
            need = _needs(piece)
        else:  # the last piece ended within a payload
            held += [mark, piece]
            size += len(mark) + len(piece)
            need = need if need is not None else _needs(b"".join(held))
        if need is not None and size >= need:
            yield b"".join(held), None
            held = None
    if held is not None:
        yield b"".join(held), "cut off"


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all gzip archives in a folder, as they stand; a damaged one has a fault."""
    text = spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches):
        pieces = (p for b in batches for p in zip(b.column("file").to_pylist(), b.column("piece").to_pylist(), strict=True))
        yield from _batches((_parsed(r, fault) for r, fault in whole_records(pieces)), _RAW_ARROW, lambda r: len(r[9]))

    return over_texts(text, run, _RAW)


def reassembled(raw: DataFrame) -> DataFrame:
    """Records without continuations: a segmented one has the blocks of all its segments, in order. The total
    length is that of the last segment's head. Repeats of a segment count once (records of one id are copies);
    a continuation whose first segment isn't there is a row of its own with a fault."""
    sound = raw.filter("fault is null")
    first, more = (sound.filter(F.coalesce(F.col("type") == "continuation", F.lit(False)) == is_) for is_ in (False, True))
    once = more.groupBy("origin", "segment").agg(F.any_value("block").alias("block"), F.max("total").alias("total"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))  # the segments of one record
    tails = once.groupBy("origin").agg(parts.alias("parts"), F.max("total").alias("all_bytes"), F.max("segment").alias("last")).withColumnRenamed("origin", "of")
    alone, cut = first.filter("segment is null"), first.filter("segment is not null")
    joined = cut.join(tails, cut["id"] == tails["of"], "full")
    rest = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    whole = F.concat("block", rest)
    lacking = F.coalesce(F.size("parts") + 1 != F.col("last"), F.lit(True)) | (F.col("segment") != 1)
    fault = F.when(F.col("id").isNull(), "no first segment").when(F.coalesce(lacking, F.lit(True)), "segments are missing").when(F.col("all_bytes").isNull() | (F.octet_length(whole) != F.col("all_bytes")), "other than the total length")
    put = joined.select("type", F.coalesce("id", "of").alias("id"), "page_id", "uri", "digest", "refers_to", whole.alias("block"), fault.alias("fault"))
    names = put.columns
    return alone.select(names).unionByName(put).unionByName(raw.filter("fault is not null").select(names))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that isn't a continuation: type, page_id, uri, digest (hex, as its head says),
    refers_to (the id of another record), id, payload (null for revisits), fault (null if it is sound)."""
    whole = reassembled(raw_records(spark, path))
    schema = pa.schema([("type", pa.string()), ("id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("fault", pa.string())])

    def decoded(kind, id_, page, uri, digest, refers, block, fault):
        payload = None
        if fault is None and kind != "revisit":
            payload, fault = payload_of(block)
            if fault is None and digest and hashlib.sha256(payload).hexdigest() != digest:
                fault = "another digest"
        return kind, id_, page, uri, digest, refers, payload, fault

    def run(batches):
        rows = (decoded(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(rows, schema, lambda r: len(r[6] or b""))

    return over_texts(whole, run, "type string, id string, page_id long, uri string, digest string, refers_to string, payload binary, fault string")


def resolved(read: DataFrame) -> DataFrame:
    """The records of read_archives with the size and digest of what they stand for: page_id, uri, payload_bytes,
    payload_digest, record_type, refers_to (page_id of the response, for revisits) and fault. A revisit takes
    them from the response that it names; if there is none, that is its fault."""
    size = F.octet_length("payload").cast("long")
    slim = stored(read.select("type", "id", "page_id", "uri", "refers_to", F.col("digest").alias("said"), size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "fault"))
    asked = slim.filter("type = 'revisit'").groupBy("refers_to").agg(F.count("*").alias("n"))
    sources = slim.filter("type = 'response' and fault is null").groupBy("id").agg(*(F.any_value(c).alias(f"r_{c}") for c in ("page_id", "payload_bytes", "payload_digest")))
    found = stored(asked.join(sources, asked["refers_to"] == sources["id"]).drop("id"))
    total = found.agg(F.sum("n")).first()[0] or 0
    hot, cold = (found.filter((F.col("n") * HOT_KEYS > total) == is_).select("refers_to", *(F.col(f"r_{c}").alias(f"{p}_{c}") for c in ("page_id", "payload_bytes", "payload_digest"))) for p, is_ in (("hot", True), ("cold", False)))
    joined = slim.filter("type = 'revisit'").join(F.broadcast(hot), "refers_to", "left").join(if_small(cold), "refers_to", "left")
    of = lambda c: F.coalesce(f"hot_{c}", f"cold_{c}")
    wrong = F.when(of("payload_digest").isNull(), "its response isn't there").when(of("payload_digest") != F.col("said"), "another digest than its response")
    revisits = joined.select("page_id", "uri", of("payload_bytes").alias("payload_bytes"), of("payload_digest").alias("payload_digest"), F.col("type").alias("record_type"), of("page_id").alias("refers_to"), F.coalesce("fault", wrong).alias("fault"))
    rest = slim.filter(F.coalesce(F.col("type") != "revisit", F.lit(True))).select("page_id", "uri", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "fault")
    return rest.unionByName(revisits)


def checked(value: Column | str, fault: Column | str = "fault") -> Column:
    """The value, but the query fails where there is a fault."""
    fault = F.col(fault) if isinstance(fault, str) else fault
    return F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("archive record: "), fault)).cast("long")).otherwise(F.col(value) if isinstance(value, str) else value)


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Query: all pages written to archives in the shared folder, read back and resolved."""
    path = scratch_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    found = resolved(read_archives(spark, path))
    return found.select(checked("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
with payloads as (
  select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as bytes from pages
), firsts as (
  select *, case when bytes >= 100 then min(page_id) over (partition by payload) else page_id end as first from payloads
)
select page_id, bytes::bigint as payload_bytes, sha256(payload) as payload_digest,
  case when first is not distinct from page_id then 'response' else 'revisit' end as record_type,
  case when first is distinct from page_id then first end as refers_to
from firsts
"""
