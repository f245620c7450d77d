"""MPEG audio columns: payloads stored in audio frames, and a parser that resynchronises, checks and indexes them.

`encode` stores bytes losslessly in a playable file: an ID3v2 tag with the number of bytes, a frame with a table for
variable bit rates (frames, bytes, 100 seek points), frames of MPEG 1 layer III, 48 kHz, mono, with checksums, and an
ID3v1 tag. The frames are silent (their side information asks for no main data); the bytes stand in the ancillary data
behind it, the format's unit being the frame. The last frame takes the smallest bit rate that fits.

`probe` reads any MPEG 1, 2 or 2.5 stream of layers I to III: it parses tags at both ends, looks for a header that
another header or the end follows, resynchronises after damage, verifies the checksums of frames of all three
layers, and gives exact durations (samples per sampling rate) and the byte offset of every frame. Free-format frames
are not taken for frames.

Null text is empty text, whose payload is 192 blanks. Equal texts give equal values, so rows that repeat do too. Ids are integers; a null one stays null. Other
columns, whatever their names, are not looked at. A text is in memory as a whole with its media. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: kbit/s by (MPEG 1?, layer), Hz by version bits, samples per frame by (MPEG 1?, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
#: Bits of a band's allocation in layer II, by table: a to d, and the one of MPEG 2.
ALLOCATION = {"a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10, "low": (4,) * 4 + (3,) * 7 + (2,) * 19}
BLOCK = 192


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    kbps: int
    rate: int
    padding: int
    mono: bool

    @property
    def first(self) -> bool:
        return self.version == 3

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.rate + self.padding) * 4
        return SAMPLES[self.first, self.layer] // 8 * self.kbps * 1000 // self.rate + self.padding

    @property
    def samples(self) -> int:
        return SAMPLES[self.first, self.layer]

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return (17 if self.mono else 32) if self.first else (9 if self.mono else 17)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, if they are one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, index = four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15) or four[3] & 3 == 2:
        return None
    return Header(version, layer, not four[1] & 1, BITRATES[version == 3, layer][index], RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3)


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The format's checksum of data, or of its first bits: polynomial 0x8005, start 0xFFFF."""
    value = 0xFFFF
    for i in range(8 * len(data) if bits is None else bits):
        high = value >> 15 ^ data[i >> 3] >> (7 - (i & 7)) & 1
        value = value << 1 & 0xFFFF ^ (0x8005 if high else 0)
    return value


def allocation(h: Header) -> tuple[int, ...]:
    """The bits of the bands' allocations in a layer II frame: the table follows from the bit rate of a channel and the sampling rate."""
    if not h.first:
        return ALLOCATION["low"]
    each = h.kbps if h.mono else h.kbps // 2
    if each <= 48:
        return ALLOCATION["d" if h.rate == 32000 else "c"]
    return ALLOCATION["a" if each <= 80 or h.rate == 48000 else "b"]


def checked_bits(h: Header, mode: int, body: bytes) -> int | None:
    """How many bits of body, what follows the checksum, the checksum is of; None if body is too short. mode: the header's last byte."""
    if h.layer == 3:
        need = 8 * h.side
    elif h.layer == 1:
        need = 128 if h.mono else 256  # at least 4 bits for each of 32 bands; with joint bands, one for both channels
        if mode >> 6 == 1:
            need = 4 * (32 + 4 + 4 * (mode >> 4 & 3))
    else:
        # Allocations, then two bits for each band and channel that has one, which say how scale factors are shared.
        table, channels, bits = allocation(h), 1 if h.mono else 2, int.from_bytes(body, "big")
        joint = 4 + 4 * (mode >> 4 & 3) if mode >> 6 == 1 else len(table)
        need = shared = 0
        for band, width in enumerate(table):
            for _ in range(channels if band < joint else 1):
                need += width
                if need > 8 * len(body):
                    return None
                if bits >> (8 * len(body) - need) & (1 << width) - 1:
                    shared += 2 * (1 if band < joint else channels)
        need += shared
    return need if need <= 8 * len(body) else None


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _prefixes() -> list[tuple[int, bytes]]:
    """(room, bytes before the ancillary data) of a checked, silent 48 kHz mono frame by bit rate, the smallest first."""
    out = []
    for index in range(1, 15):
        head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
        side = bytes(17)
        out.append((header(head).length - 23, head + struct.pack(">H", crc16(head[2:] + side)) + side))
    return out


_PREFIXES = _prefixes()


def encode(payload: bytes) -> bytes:
    """payload in an MPEG audio file."""
    room, prefix = _PREFIXES[-1]
    frames = [prefix + payload[i : i + room] for i in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(frames) * room :]:
        fit, prefix = next(x for x in _PREFIXES if x[0] >= len(rest))
        frames.append(prefix + rest + bytes(fit - len(rest)))
    note = b"TXXX" + struct.pack(">IH", len(text := b"\0payload_bytes\0" + str(len(payload)).encode()), 0) + text
    tag = b"ID3\3\0\0" + _syncsafe(len(note)) + note
    first = bytes([0xFF, 0xFB, 0x54, 0xC0])  # 64 kbit/s, 192 bytes, without a checksum
    audio = sum(map(len, frames)) + BLOCK
    points, at, k = [], BLOCK, 0
    for i in range(100):
        while k < len(frames) and k * 100 < i * len(frames):
            at += len(frames[k])
            k += 1
        points.append(min(255, at * 256 // audio))
    table = b"Xing" + struct.pack(">III", 7, len(frames), audio) + bytes(points)
    last = b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"
    return tag + (first + bytes(17) + table).ljust(BLOCK, b"\0") + b"".join(frames) + last


@dataclass
class Stream:
    """What probe() finds. frames: (offset, header, checksum good / bad / None)."""

    tags: dict = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    frames: list = field(default_factory=list)
    skipped: int = 0

    @property
    def duration(self) -> Fraction:
        total: dict[int, int] = {}
        for _, h, _ in self.frames:
            total[h.rate] = total.get(h.rate, 0) + h.samples
        return sum((Fraction(n, r) for r, n in total.items()), Fraction(0))


def _tags(data: bytes) -> tuple[dict, int, int]:
    """Tags, and where the audio begins and ends."""
    tags, begin, end = {}, 0, len(data)
    while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[begin + 6 : begin + 10], (21, 14, 7, 0), strict=True))
        major, at, stop = data[begin + 3], begin + 10, min(begin + 10 + size, len(data))
        while major in (3, 4) and at + 10 <= stop and data[at : at + 4].strip(b"\0"):
            raw = data[at + 4 : at + 8]
            n = int.from_bytes(raw, "big") if major == 3 else sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))
            body = data[at + 10 : min(at + 10 + n, stop)]
            name = data[at : at + 4].decode("latin-1")
            if name == "TXXX" and b"\0" in body[1:]:
                key, value = body[1:].split(b"\0", 1)
                tags[key.decode("latin-1")] = value.decode("latin-1")
            elif name[0] == "T":
                tags[name] = body[1:].decode("latin-1").rstrip("\0")
            at += 10 + n
        begin = begin + 10 + size + (10 if data[begin + 5] & 0x10 else 0)
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["title"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    return tags, min(begin, end), end


def _vbr(data: bytes, at: int, h: Header) -> dict:
    """The table for variable bit rates in a frame, if it has one."""
    x = at + 4 + (2 if h.checked else 0) + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, y, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"kind": data[x : x + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[y : y + 4], "big")
                y += 4
        if flags & 4:
            out["points"] = list(data[y : y + 100])
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        size, frames, entries, scale, width = (int.from_bytes(data[x + a : x + b], "big") for a, b in ((10, 14), (14, 18), (18, 20), (20, 22), (22, 24)))
        points = [int.from_bytes(data[x + 26 + i * width : x + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "points": points}
    return {}


#: No checksum is of more bytes behind it than this.
_CHECKED = 48


def probe(data: bytes) -> Stream:
    """The stream's tags, table, frames and skipped bytes."""
    out = Stream()
    out.tags, at, end = _tags(data)
    known = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        # In step, a whole frame is enough; out of step, a frame counts if another or the end follows it.
        if h is None or at + h.length > end or not (known or at + h.length == end or header(data[at + h.length : at + h.length + 4])):
            nearest = data.find(b"\xff", at + 1, end)
            nearest = end if nearest < 0 else nearest
            out.skipped += nearest - at
            at, known = nearest, False
            continue
        good = None
        if h.checked:
            body = data[at + 6 : min(at + h.length, at + 6 + _CHECKED)]
            need = checked_bits(h, data[at + 3], body)
            good = need is not None and crc16(data[at + 2 : at + 4] + body[: (need + 7) // 8], 16 + need) == int.from_bytes(data[at + 4 : at + 6], "big")
        if not out.frames and not out.vbr and h.layer == 3 and (table := _vbr(data, at, h)):
            out.vbr = table
        else:
            out.frames.append((at, h, good))
        at, known = at + h.length, True
    out.skipped += max(0, end - at)
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that encode() has stored."""
    parts = [data[at + 6 + h.side : at + h.length] for at, h, _ in stream.frames]
    return b"".join(parts)[: int(stream.tags["payload_bytes"])]


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the text's payload as MPEG audio."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, batch.num_rows, 256):
                raw = [(t or "").encode() for t in texts[i : i + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i : i + 256].cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([encode(padded(t)) for t in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


_INDEXED = "doc_id bigint, n_bytes bigint, payload binary, media_bytes bigint, media_sha256 string, samples bigint, rate int, duration_us bigint, crc_good int, crc_bad int, skipped bigint, vbr_frames bigint, offsets array<bigint>"


def index(media: DataFrame) -> DataFrame:
    """Payload, sizes, exact duration (samples at rate; microseconds rounded down), checksums and frame offsets of media."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("samples", pa.int64()), ("rate", pa.int32()), ("duration_us", pa.int64()), ("crc_good", pa.int32()), ("crc_bad", pa.int32()), ("skipped", pa.int64()), ("vbr_frames", pa.int64()), ("offsets", pa.list_(pa.int64()))])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(i, 256)
                for doc_id, n, body in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    s = probe(body)
                    rows.append({"doc_id": doc_id, "n_bytes": n, "payload": payload_of(body, s), "media_bytes": len(body), "media_sha256": hashlib.sha256(body).hexdigest(), "samples": sum(h.samples for _, h, _ in s.frames), "rate": s.frames[0][1].rate if s.frames else None, "duration_us": int(s.duration * 1_000_000), "crc_good": sum(g is True for *_, g in s.frames), "crc_bad": sum(g is False for *_, g in s.frames), "skipped": s.skipped, "vbr_frames": s.vbr.get("frames"), "offsets": [at for at, *_ in s.frames]})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _INDEXED)


def digests(indexed: DataFrame) -> DataFrame:
    """The columns of op10, from index()."""

    def run(batches):
        for batch in batches:
            for r in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                cols = r.to_pydict()
                payloads = cols["payload"]
                seek = [zlib.crc32(struct.pack(f"<{len(o)}q", *o)) for o in cols["offsets"]]
                feature = [f"frames={len(o)};vbr_frames={v};samples={s};rate={q};duration_us={d};crc_good={g};crc_bad={b};skipped={k};seek_crc32={c}" for o, v, s, q, d, g, b, k, c in zip(*(cols[c] for c in ("offsets", "vbr_frames", "samples", "rate", "duration_us", "crc_good", "crc_bad", "skipped")), seek, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [r.column("doc_id"), r.column("n_bytes"), pa.array(map(len, payloads), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), r.column("media_bytes"), r.column("media_sha256"), pa.array(feature)],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return indexed.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Every text stored as MPEG audio, read back and indexed."""
    return digests(index(store(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
