"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each of which holds some whole WARC records, followed by a seek
table in a skippable frame: compressed size, size and checksum of each frame, then the number of frames, a flag byte and
a magic number. So any tool for Zstandard reads a bundle as one WARC file, and a reader that has a record's frame and
offset decompresses that frame only. The index maps record identifiers to (bundle, frame, offset in the frame, length).

Bundles are rows (bundle, body, index) of a table in the shared folder: files of a cluster's store are then written and
committed by Spark alone, also when executors are lost.

Of records with equal payloads of at least `least` bytes the one with the largest id is the response, the others are
revisits that refer to it and have no payload of their own. Rows that repeat that id are responses too. Null html is an
empty payload, a null url an empty one, and a null id never is the response others refer to while there is another; line
breaks in a url are percent-encoded. An empty table gives no bundles. page_id is an integer. Columns other than page_id,
url and html, whatever their names, are not looked at. A payload of any length is one record in one frame, and in memory as a whole; of equal payloads it makes no
difference which rows come first, as only the largest id counts.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import materialize

# Fixed values of the formats.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "array<struct<page_id: bigint, frame: int, offset: bigint, length: bigint>>"
BUNDLES = f"bundle string, body binary, index {INDEX}"


# --- records -------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record. size and digest (SHA-1, hex) are of the full payload, which a revisit doesn't store."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place in data and the place after it; its payload's length and digest are checked."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in (y if ": " in y else y + " " for y in lines[1:]))
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[: cut - 4].decode().split("\r\n")[1:])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda v: int(v) if (v := v.removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"].strip(), "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To", "")), "payload": None}
    if out["record_type"] == "response":
        out["payload"] = block[cut:]
        if len(out["payload"]) != out["payload_bytes"] or hashlib.sha1(out["payload"]).hexdigest() != digest:
            raise ValueError(f"record {out['page_id']} is damaged")
    return out, end + 4 + int(head["Content-Length"]) + 4


# --- bundles -------------------------------------------------------------------------------------------------------


def build(frames: list[list[tuple[int | None, bytes]]], level: int = 3) -> tuple[bytes, list[dict]]:
    """A bundle of frames of (id, record) pairs, and its index."""
    squeeze, body, table, index = zstandard.ZstdCompressor(level=level, write_content_size=True), [], b"", []
    for k, frame in enumerate(frames):
        offset = 0
        for page_id, rec in frame:
            index.append({"page_id": page_id, "frame": k, "offset": offset, "length": len(rec)})
            offset += len(rec)
        raw = b"".join(r for _, r in frame)
        body.append(squeeze.compress(raw))
        table += struct.pack("<III", len(body[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
    table += struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return b"".join(body) + struct.pack("<II", SKIPPABLE, len(table)) + table, index


def seek_table(body: bytes) -> list[tuple[int, int, int, int]]:
    """Per frame: place, compressed size, size, checksum."""
    number, flags, magic = struct.unpack("<IBI", body[-9:])
    if magic != SEEKABLE or not flags & CHECKSUMS:
        raise ValueError("no seek table")
    at, out = 0, []
    for packed, size, check in struct.iter_unpack("<III", body[-9 - 12 * number : -9]):
        out.append((at, packed, size, check))
        at += packed
    return out


def frame(body: bytes, entry: tuple[int, int, int, int]) -> bytes:
    """The content of one frame, checked."""
    at, packed, size, check = entry
    raw = zstandard.ZstdDecompressor().decompress(body[at : at + packed], max_output_size=size)
    if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("a frame is damaged")
    return raw


def write_bundles(pages: DataFrame, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20, least: int = 1000) -> DataFrame:
    """Bundles of a record per row of pages (page_id, url, html)."""
    text = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", text.alias("html"), F.sha1(F.encode(text, "utf-8")).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    groups = known.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    groups = groups.filter("n > 1").select("digest", "size", "original")
    records = known.join(groups, ["digest", "size"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frames, rows, filled, total, made = [], [], 0, 0, 0
        schema = pa.schema([("bundle", pa.string()), ("body", pa.binary()), ("index", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])

        def flush():
            nonlocal frames, made, total
            body, index = build(frames)
            name = f"part-{TaskContext.get().partitionId():06d}-{made:05d}.warc.zst"
            frames, made, total = [], made + 1, 0
            return pa.RecordBatch.from_pydict({"bundle": [name], "body": [body], "index": [index]}, schema)

        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                rows.append((row["page_id"], record(row["page_id"], row["url"], payload, row["size"], row["digest"], row["refers_to"])))
                filled += len(rows[-1][1])
                total += len(rows[-1][1])
                if filled >= frame_bytes:
                    frames.append(rows)
                    rows, filled = [], 0
                if total >= bundle_bytes and frames and not rows:
                    yield flush()
        if rows:
            frames.append(rows)
        if frames:
            yield flush()

    return records.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(run, BUNDLES)


_READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_bundles(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the bundles, with their payloads (null for revisits) if wanted."""
    schema = _READ + ", payload binary" * payloads

    def run(batches):
        for batch in batches:
            for body in batch.column("body"):
                body = body.as_py()
                for entry in seek_table(body):
                    raw, at, rows = frame(body, entry), 0, []
                    while at < len(raw):
                        rec, at = parse(raw, at)
                        if not payloads:
                            del rec["payload"]
                        rows.append(rec)
                    yield pa.RecordBatch.from_pylist(rows, _arrow(payloads))

    return bundles.select("body").mapInArrow(run, schema)


def _arrow(payloads: bool) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _READ.split(", "))] + [("payload", pa.binary())] * payloads)


def fetch(bundles: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the given ids (page_id), by the index: only the frames that hold them are decompressed."""
    places = bundles.select("bundle", F.explode("index").alias("i")).select("bundle", "i.*").join(ids.select("page_id").distinct(), "page_id")
    wanted = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))

    def run(batches):
        for batch in batches:
            for body, places in zip(batch.column("body").to_pylist(), batch.column("places").to_pylist(), strict=True):
                table, raws, rows = seek_table(body), {}, []
                for p in places:
                    k = p["frame"]
                    raws[k] = raws.get(k) or frame(body, table[k])
                    rows.append(parse(raws[k][p["offset"] : p["offset"] + p["length"]])[0])
                yield pa.RecordBatch.from_pylist(rows, _arrow(True))

    return bundles.join(wanted, "bundle").select("body", "places").mapInArrow(run, _READ + ", payload binary")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to bundles and read back."""
    bundles = materialize(write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet")), "bundles")
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to FROM g
"""
