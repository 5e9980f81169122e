"""WARC archives: writing records in segments with chunked framing, and putting them together again.

Writing
-------
A page's record is an HTTP response in chunked transfer framing.  A record longer than ``segment_bytes`` is cut: the first
part stays a ``response`` with segment number 1, the others are ``continuation`` records that name it as their origin; the
last one states the total length.  Every record is a gzip member of its own.  Of pages with equal payloads of at least
``REVISIT_BYTES``, the one with the largest id is written in full and the others are ``revisit`` records referring to it.
Archives get a new name in each attempt and only those in the written manifest are read, so lost or doubled tasks do no harm.

Reading
-------
Archives are read record by record.  Whole records are decoded where they are read.  Segments are grouped by the origin's
identifier (they can lie in any archive), ordered by number, checked for gaps and against the total length, and then
decoded.  A record that can't be completed has a null payload and says why in ``problem``.

Nulls and ties: a null html is an empty payload; null page ids are kept (a page with a null id is never the one referred to
unless all have a null id, then each is a response).  Rows with the largest id and the same payload, but another url, are
responses too; rows that are alike in all of id, url and payload have one identifier and come back as often as written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.sources import blobs
from partmill.sources.storage import materialize, shared_path

#: Payloads below are never revisits; bytes of one segment, of one HTTP chunk and of one archive.
REVISIT_BYTES, SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 1000, 32 << 10, 8 << 10, 256 << 20
#: The crawl date that is written; the tables have none.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_READ_BYTES = 1 << 20


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for lo in range(0, len(payload), size):
        piece = payload[lo : lo + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped.  ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : max(end, at)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("no chunk size")
        at, n = end + 2, int(size, 16)
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("short chunk")
        parts.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP head")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def record_id(*parts: object) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}"


def _record(fields: dict[str, object], block: bytes) -> bytes:
    fields = {**fields, "WARC-Date": DATE, "Content-Length": len(block)}
    clean = lambda v: re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", str(v))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gzip.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + gzip.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page.  ``refers_to``: (page id, url) of the response that it revisits, else None."""
    own = record_id(page_id, url, digest)
    fields: dict[str, object] = {
        "WARC-Type": "response", "WARC-Record-ID": f"<{own}>", "Page-ID": page_id, "WARC-Target-URI": url,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type": "application/http; msgtype=response",
    }
    if refers_to:
        yield _record({**fields, "WARC-Type": "revisit", "WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{record_id(*refers_to, digest)}>"}, _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for k, lo in enumerate(cuts, 1):
        more: dict[str, object] = {"WARC-Segment-Number": k}
        if k > 1:
            more |= {"WARC-Type": "continuation", "WARC-Record-ID": f"<{record_id(own, k)}>", "WARC-Segment-Origin-ID": f"<{own}>", "Content-Type": None}
        if k == len(cuts):
            more["WARC-Segment-Total-Length"] = len(block)
        yield _record({**fields, **more}, block[lo : lo + segment_bytes])


def _writer(folder: str, segment_bytes: int, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, uri, size = None, "", 0
        done = lambda: pa.RecordBatch.from_pydict({"path": [uri], "bytes": [size]})
        for batch in batches:
            for page_id, url, payload, digest, refers, to_id, to_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers", "to_id", "to_url")), strict=True):
                for record in page_records(page_id, url, payload, digest, (to_id, to_url) if refers else None, segment_bytes):
                    if file is None:
                        uri, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        file = blobs.create(uri)
                    file.write(record)
                    size += len(record)
                    if size >= archive_bytes:
                        file.close()
                        yield done()
                        file = None
        if file is not None:
            file.close()
            yield done()

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives of ``pages``; the manifest: (path, bytes)."""
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    alike = given.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    alike = materialize(alike.where("n > 1 and top.page_id is not null").select("digest", "top"), "warc-alike")
    refers = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    marked = given.join(alike, "digest", "left").withColumn("refers", refers)
    marked = marked.select("page_id", "url", F.when(F.col("refers"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "refers", F.col("top.page_id").alias("to_id"), F.col("top.url").alias("to_url"))
    written = marked.mapInArrow(_writer(shared_path(spark, "warc"), segment_bytes, archive_bytes), "path string, bytes long")
    return materialize(written, "warc-manifest")


def records_of(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of the records of an archive, one in memory at a time."""
    with blobs.open_random(uri) as file:
        held = b""
        while True:
            gzip, out = zlib.decompressobj(31), []
            while not gzip.eof:
                held = held or file.read(_READ_BYTES)
                if not held:
                    break
                out.append(gzip.decompress(held))
                held = gzip.unused_data
            if not out:
                return
            if not gzip.eof:
                raise ValueError(f"{uri} ends inside a record")
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            yield fields, rest[: int(fields["content-length"])]


_SCHEMA = "record_id string, page_id long, url string, type string, refers_record string, digest string, origin string, number long, total long, block binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in _SCHEMA.split(", "))])


def _reader(segments: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for f, block in records_of(path):
                    if ("warc-segment-number" in f) != segments:
                        continue
                    bare = lambda k, f=f: f[k].strip("<>") if k in f else None
                    integer = lambda k, f=f: int(f[k]) if k in f else None
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in f else None
                    origin = bare("warc-segment-origin-id") or bare("warc-record-id")
                    rows.append((bare("warc-record-id"), integer("page-id"), f.get("warc-target-uri"), f["warc-type"], bare("warc-refers-to"), digest, origin, integer("warc-segment-number"), integer("warc-segment-total-length"), block))
                    size += len(block)
                    if size > _READ_BYTES * 4 or len(rows) >= 2000:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    return read


def assemble(parts: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """(block, problem) of the segments ``(number, total length or None, block)`` of one record, in any order."""
    by_number = {n: b for n, _, b in parts}
    totals = {t for _, t, _ in parts if t is not None and not pd.isna(t)}
    if len(totals) != 1:
        return None, "no last segment" if not totals else "several total lengths"
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        return None, "missing segment"
    block = b"".join(by_number[n] for n in sorted(by_number))
    return (block, None) if len(block) == totals.pop() else (None, "wrong total length")


def _decode(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for kinds, digests, segments in batches:
        rows: list[tuple[bytes | None, str | None]] = []
        for kind, digest, parts in zip(kinds, digests, segments, strict=True):
            block, problem = assemble([(p["number"], p["total"], p["block"]) for p in parts])
            payload = None
            if block is not None and kind != "revisit":
                try:
                    payload = http_payload(block)
                    problem = None if digest is None or hashlib.sha1(payload).hexdigest() == digest else "wrong digest"
                except ValueError as e:
                    problem = str(e)
            rows.append((payload, problem))
        yield pd.DataFrame(rows, columns=["payload", "problem"], dtype=object)


_HEAD = ("page_id", "url", "type", "refers_record", "digest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(record_id, page_id, url, type, refers_record, digest, payload, problem) of every response and revisit record of the
    archives in ``manifest`` (column ``path``); revisits have a null payload.

    Records that are alike in all have one identifier: of each of its segments one copy is kept and counted, so that no more
    than one record's segments ever come together, and the record comes back as often as its rarest segment was written."""
    archives = manifest.select("path").repartition(max(1, min(manifest.count(), 20_000)))
    part = F.struct(F.coalesce("number", F.lit(1).cast("long")).alias("number"), F.coalesce("total", F.when(F.col("number").isNull(), F.length("block"))).cast("long").alias("total"), "block")
    single = archives.mapInArrow(_reader(segments=False), _SCHEMA).select("record_id", *_HEAD, F.array(part).alias("parts"), F.lit(1).cast("long").alias("times"))
    cut = archives.mapInArrow(_reader(segments=True), _SCHEMA)
    once = cut.groupBy("origin", "number").agg(F.first(part).alias("part"), F.min(F.struct(*_HEAD)).alias("head"), F.count("*").alias("times"))
    joined = once.groupBy("origin").agg(F.min(F.struct("number", "head")).alias("f"), F.collect_list("part").alias("parts"), F.min("times").alias("times"))
    joined = joined.select(F.col("origin").alias("record_id"), "f.head.*", "parts", "times")
    decoded = F.pandas_udf(_decode, "payload binary, problem string").asNondeterministic()("type", "digest", "parts")
    each = single.unionByName(joined).select("record_id", *_HEAD, "times", decoded.alias("d")).select("record_id", *_HEAD, "d.*", "times")
    return each.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def describe_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem): lengths and digests of full payloads, those
    of revisits from the response that they refer to."""
    light = records.select("record_id", "page_id", "type", "refers_record", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "problem")
    light = materialize(light, "warc-records")
    told = light.where("type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("to_page"), F.first("payload_bytes").alias("to_bytes"), F.first("payload_digest").alias("to_digest"))
    told = materialize(told, "warc-responses")
    responses = light.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    revisits = light.where("type = 'revisit'").drop("payload_bytes", "payload_digest", "record_id")
    revisits = revisits.join(told, revisits["refers_record"] == told["record_id"], "left")
    lost = F.when(F.col("record_id").isNull(), "no such response")
    revisits = revisits.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"), F.coalesce("problem", lost).alias("problem"))
    return responses.unionByName(revisits)
