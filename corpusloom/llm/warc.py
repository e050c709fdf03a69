"""WARC archives: writing with revisits and segments, and reassembly of segments on reading (operator 1).

Writing: of equal payloads of at least 100 bytes, the record with the least page_id holds the payload and the
others refer to it, by record, address and date. A response is an HTTP message in chunked framing; a block above the
segment size of 8 KB continues in continuation records, so an archive of at most 2000 records is bounded in bytes too.
Archives are gzip files.

Reading: segments are grouped by origin identifier and ordered by segment number, the total length is verified
and the chunked framing decoded. Origins whose segments share an archive are finished where they are read; only
those that span archives are shuffled. Revisits are looked up in the records that they refer to: their length, digest and
page are those of the payload found there, and they are verified if it is whole and has the digest that they name.

Pages are read twice in writing, so the input should be a stored table.

Defined cases: a null payload is empty; null keys and urls are carried as null; rows with the same page_id and
payload as the first are responses too; an empty table gives no archive and an empty table; further columns of
the input are passed over. A broken record (missing segment, wrong length or framing) has a null payload and
verified false, and so have revisits of it, or of a record that is missing.
"""

from __future__ import annotations

import gzip
import hashlib
from datetime import datetime, timezone
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table
from corpusloom.llm.files import read_blocks, write_blocks

LEAST_SHARED = 100
SEGMENT, CHUNK, RECORDS = 8192, 3000, 2000
SALTS = 16
BREAK, CONTENT = "\r\n", "application/http; msgtype=response"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


#: What a revisit says of itself (fixed value of the standard).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record (32 hexadecimal digits of its own), and of the record it refers to first_record
    and first_url (null for responses)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    rows = rows.withColumn("record", F.md5(F.concat_ws("-", F.col("page_id").cast("string"), "payload_digest", F.monotonically_increasing_id().cast("string"))))
    first = F.min_by(F.struct("page_id", "record", "url"), "page_id")
    shared = rows.where(F.length("payload") >= LEAST_SHARED).groupBy("payload_digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1").select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(shared, ["payload_digest", "salt"], "left")
    other = F.col("first.page_id") != F.col("page_id")
    return joined.select("page_id", "url", "payload", "payload_digest", "record", F.when(other, F.col("first.record")).alias("first_record"), F.when(other, F.col("first.url")).alias("first_url"))


def chunked(body: bytes) -> bytes:
    parts = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes | None:
    """The body, or None if the framing is broken."""
    at, parts = 0, []
    while (end := framed.find(b"\r\n", at)) >= 0:
        try:
            size = int(framed[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if not size:
            return b"".join(parts)
        part = framed[end + 2 : end + 2 + size]
        if len(part) < size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        parts.append(part)
        at = end + 4 + size
    return None


def head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in fields if v is not None]
    return BREAK.join(["WARC/1.1", *lines, BREAK]).encode()


def urn(digits: str) -> str:
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}>"


def records(page: dict, date: str) -> Iterator[bytes]:
    """A page's records, each without the two line breaks that end it."""
    name = urn(page["record"])
    about = [("WARC-Date", date), ("WARC-Target-URI", page["url"]), ("WARC-Payload-Digest", f"sha256:{page['payload_digest']}"), ("X-Page-Id", page["page_id"])]
    if page["first_record"] is not None:
        there = [("WARC-Refers-To", urn(page["first_record"])), ("WARC-Refers-To-Target-URI", page["first_url"]), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE)]
        yield head([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *about, *there, ("Content-Type", CONTENT), ("Content-Length", 0)])
        return
    block = HTTP + chunked(page["payload"])
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    several = len(parts) > 1
    for k, part in enumerate(parts):
        segment = [("WARC-Segment-Number", k + 1 if several else None), ("WARC-Segment-Total-Length", len(block) if k and k + 1 == len(parts) else None)]
        if k:
            own = urn(hashlib.md5(f"{page['record']}-{k}".encode()).hexdigest())
            yield head([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", page["url"]), ("WARC-Segment-Origin-ID", name), *segment, ("Content-Length", len(part))]) + part
        else:
            yield head([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, *segment, ("Content-Type", CONTENT), ("Content-Length", len(part))]) + part


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write every page to gzip archives under the path; date: when the pages were fetched (YYYY-MM-DDThh:mm:ssZ), else now."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)):
                made = [x for r in part.to_pylist() for x in records(r, date)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    write_blocks(with_revisits(pages).mapInArrow(run, "record binary"), "record", path, BREAK * 2, "gzip", RECORDS)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record."""
    at = 0
    while (end := archive.find(b"\r\n\r\n", at)) >= 0:
        lines = archive[at:end].decode().split(BREAK)
        fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        size = int(fields["Content-Length"])
        yield fields, archive[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


FINISHED = "origin string, page_id string, url string, record_type string, refers_to_record string, payload_bytes long, payload_digest string, verified boolean, payload binary"
FRAGMENT = "number int, total long, fields map<string,string>, block binary"
SCHEMA = pa.schema([("origin", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())])
PARTS = pa.schema([("number", pa.int32()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def finish(origin: str, segments: list[tuple[int, int | None, dict, bytes]]) -> dict:
    """The record of an origin from its segments: (number, total length of the last one, fields of the first one, block).

    A revisit has the digest that it names; what it refers to is not known here.
    """
    segments = sorted(segments, key=lambda s: s[0])
    fields = next((s[2] for s in segments if s[0] == 1 and s[2]), {})
    block = b"".join(s[3] for s in segments)
    kind = fields.get("WARC-Type", "response")
    out = {"origin": origin, "page_id": fields.get("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to_record": fields.get("WARC-Refers-To")}
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if kind == "revisit":
        return out | {"payload_bytes": None, "payload_digest": digest, "verified": False, "payload": None}
    whole = [s[0] for s in segments] == list(range(1, len(segments) + 1)) and (len(segments) == 1 or segments[-1][1] == len(block))
    payload = unchunked(block[block.find(b"\r\n\r\n") + 4 :]) if whole else None
    found = None if payload is None else hashlib.sha256(payload).hexdigest()
    return out | {"payload_bytes": None if payload is None else len(payload), "payload_digest": found, "verified": found is not None and found == digest, "payload": payload}


def segments_of(archive: bytes) -> tuple[dict[str, list], dict[str, list]]:
    """Segments by origin: of origins that are whole in this archive, and of the others."""
    found: dict[str, list] = {}
    for fields, block in parse(archive):
        number = int(fields.get("WARC-Segment-Number", 0))
        total = fields.get("WARC-Segment-Total-Length")
        first = number < 2
        origin = fields["WARC-Record-ID"] if first else fields["WARC-Segment-Origin-ID"]
        found.setdefault(origin, []).append((max(number, 1), total and int(total), fields if first else {}, block, number))
    whole, spread = {}, {}
    for origin, parts in found.items():
        alone = len(parts) == 1 and parts[0][4] == 0
        last = next((p for p in parts if p[1]), None)
        (whole if alone or last and {p[0] for p in parts} == set(range(1, last[0] + 1)) else spread)[origin] = [p[:4] for p in parts]
    return whole, spread


def opened(batches) -> Iterator[bytes]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield gzip.decompress(batch.column("content")[k].as_buffer())


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every response and revisit of the archives: page_id, url, record_type, refers_to (page_id), payload_bytes,
    payload_digest, verified and, if asked for, payload (of responses)."""

    def batch(rows: list[dict]):
        return pa.RecordBatch.from_pylist(rows if payloads else [r | {"payload": None} for r in rows], SCHEMA)

    def read(batches):
        for archive in opened(batches):
            whole, spread = segments_of(archive)
            items = list(whole.items())
            for i in range(0, len(items), 200):
                done = batch([finish(o, parts) for o, parts in items[i : i + 200]])
                yield pa.RecordBatch.from_arrays([*done.columns, *(pa.nulls(done.num_rows, f.type) for f in PARTS)], names=[*SCHEMA.names, *PARTS.names])
            rows = [{"origin": o, "number": n, "total": t, "fields": list(f.items()), "block": b} for o, parts in spread.items() for n, t, f, b in parts]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([*SCHEMA, *PARTS]))

    def together(batches):
        for held in batches:
            yield batch([finish(r["origin"], [(s["number"], s["total"], dict(s["fields"]), s["block"]) for s in r["parts"]]) for r in held.to_pylist()])

    found = write_table(read_blocks(spark, path).mapInArrow(read, f"{FINISHED}, {FRAGMENT}"), "records")
    parts = found.where("number is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "fields", "block")).alias("parts"))
    rows = found.where("number is null").select(*SCHEMA.names).unionByName(parts.mapInArrow(together, FINISHED))
    return looked_up(rows)


def looked_up(rows: DataFrame) -> DataFrame:
    """Records with the revisits' length, page and verdict from the records that they refer to. Salted: many may refer to one."""
    revisits, responses = rows.where("record_type = 'revisit'"), rows.where("record_type = 'response'")
    needed = revisits.select(F.col("refers_to_record").alias("origin")).where("origin is not null").distinct()
    there = responses.select("origin", "page_id", "payload_bytes", "payload_digest", "verified").join(needed, "origin", "left_semi")
    there = there.select(F.col("origin").alias("refers_to_record"), F.struct("page_id", "payload_bytes", "payload_digest", "verified").alias("there"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = revisits.withColumn("salt", F.pmod(F.xxhash64("origin"), F.lit(SALTS)).cast("int")).join(there, ["refers_to_record", "salt"], "left")
    verified = F.coalesce(F.col("there.verified") & (F.col("there.payload_digest") == F.col("payload_digest")), F.lit(False))
    shown = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "verified", "payload"]
    found = salted.select("page_id", "url", "record_type", F.col("there.page_id").alias("refers_to"), F.col("there.payload_bytes").alias("payload_bytes"), "payload_digest", verified.alias("verified"), "payload")
    return responses.withColumn("refers_to", F.lit(None).cast("string")).select(*shown).unionByName(found)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
         CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, true AS verified
FROM q
"""
