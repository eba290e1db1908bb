"""Media columns: MPEG audio.

Reading resynchronises on frame headers (a header counts if the next frame, the end or a tag follows it),
skips ID3v2 and ID3v1 tags, reads Xing, Info and VBRI tables, verifies the 16-bit checksum of protected Layer
III frames, and stores the exact duration (samples over rate) and the byte offset of every frame for seeking.
Writing puts a payload into silent MPEG-2 Layer III frames as ancillary data, UNIT bytes a frame, behind an
ID3v2 tag and a Xing table with seek points.

Defined results: null counts as empty bytes; bytes without any frame give no frames, a duration of 0/1 and no
payload; damaged parts are skipped and counted; equal inputs give equal outputs; extra columns stay, and those
named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plus, saved, table

UNIT = 576
# Fixed values of the format: kbit/s by (MPEG-1?, layer) and sample rates by version.
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes, if it is one."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate_bits, bit_index = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate_bits == 3 or bit_index in (0, 15):
        return None
    first = version == 3
    kbits, rate, pad, mono = RATES[first, layer][bit_index], SAMPLING[version][rate_bits], word[2] >> 1 & 1, word[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * kbits * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + pad
    side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else 0
    return Header(version, layer, not word[1] & 1, kbits, rate, mono, size, samples, side)


@lru_cache(maxsize=65536)
def checksum(data: bytes) -> int:
    """CRC-16 of the frame: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Audio:
    frames: int = 0
    samples: int = 0
    rate: int = 1
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    variable: str = ""
    declared_frames: int = -1
    declared_bytes: int = -1
    toc: bytes = b""
    tags: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)
    payload: bytes = b""


def _tag_size(b: bytes, at: int) -> int:
    """Bytes of an ID3v2 tag at a place; 0 if there is none."""
    if b[at : at + 3] != b"ID3" or len(b) < at + 10:
        return 0
    n = 0
    for x in b[at + 6 : at + 10]:
        n = n << 7 | x & 0x7F
    return 10 + n + (10 if b[at + 5] & 0x10 else 0)


def _tags(b: bytes, at: int, end: int) -> dict:
    out, at = {}, at + 10
    while at + 10 <= end and b[at : at + 4].isalnum():
        n = int.from_bytes(b[at + 4 : at + 8], "big")
        out[b[at : at + 4].decode("latin-1")] = b[at + 11 : at + 10 + n].decode("latin-1")
        at += 10 + n
    return out


def parse(b: bytes) -> Audio:
    out, at, end, parts, same = Audio(), 0, len(b), [], None
    if b[-128:-125] == b"TAG":
        end -= 128
        out.tags["TIT1"] = b[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    while at < end:
        if n := _tag_size(b, at):
            out.tags |= _tags(b, at, min(end, at + n))
            at += n
            continue
        h = header(b[at : at + 4])
        after = at + h.size if h else 0
        good = h is not None and after <= end and (same in (None, (h.version, h.layer, h.rate))) and (after == end or b[after : after + 3] == b"ID3" or (x := header(b[after : after + 4])) is not None and (x.version, x.layer, x.rate) == (h.version, h.layer, h.rate))
        if not good:
            nxt = b.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        same, body = (h.version, h.layer, h.rate), at + 4 + 2 * h.protected
        if h.protected and h.layer == 3:
            out.checked += 1
            out.bad_checksums += checksum(b[at + 2 : at + 4] + b[body : body + h.side]) != int.from_bytes(b[at + 4 : at + 6], "big")
        data = body + h.side
        if not out.variable and not out.frames and b[data : data + 4] in (b"Xing", b"Info"):
            out.variable, flags, q = b[data : data + 4].decode(), int.from_bytes(b[data + 4 : data + 8], "big"), data + 8
            if flags & 1:
                out.declared_frames, q = int.from_bytes(b[q : q + 4], "big"), q + 4
            if flags & 2:
                out.declared_bytes, q = int.from_bytes(b[q : q + 4], "big"), q + 4
            if flags & 4:
                out.toc = b[q : q + 100]
        elif not out.variable and not out.frames and b[at + 36 : at + 40] == b"VBRI":
            out.variable = "VBRI"
            out.declared_bytes, out.declared_frames = int.from_bytes(b[at + 46 : at + 50], "big"), int.from_bytes(b[at + 50 : at + 54], "big")
        else:
            out.frames += 1
            out.samples += h.samples
            out.rate = h.rate
            out.offsets.append(at)
            parts.append(b[data : min(data + UNIT, after)])
        at = after
    out.payload = b"".join(parts)
    return out


def _frame(kbits_index: int, data: bytes) -> bytes:
    """A protected mono frame at 16 kHz with silent side information and data as ancillary bytes."""
    head = bytes([0xFF, 0xF2, kbits_index << 4 | 2 << 2, 0xC0])
    h, side = header(head), bytes(9)
    return (head + checksum(head[2:] + side).to_bytes(2, "big") + side + data).ljust(h.size, b"\0")


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of UNIT."""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def write(payload: bytes) -> bytes:
    """An MPEG audio stream that holds the payload, a multiple of UNIT bytes; its last frame has a higher rate."""
    units = [payload[k : k + UNIT] for k in range(0, len(payload), UNIT)]
    frames = [_frame(13, u) for u in units[:-1]] + [_frame(14, u) for u in units[-1:]]
    size = sum(map(len, frames))
    starts = [0]
    for f in frames:
        starts.append(starts[-1] + len(f))
    toc = bytes(min(255, starts[len(frames) * p // 100] * 256 // max(1, size)) for p in range(100))
    xing = _frame(13, b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + size.to_bytes(4, "big") + toc)
    text = b"\0payload\0%d" % len(payload)
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(tag)
    return b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag + xing + b"".join(frames)


def stored(documents: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """documents with the text's padded UTF-8 bytes as an MPEG audio column, and n_bytes before padding."""
    base = documents.drop(media, "n_bytes")

    def run(batches):
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                raw = [(t or "").encode() for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(r) for r in raw], pa.int64()), pa.array([write(padded(r)) for r in raw], pa.binary())], names=[*part.schema.names, "n_bytes", media])

    return base.mapInArrow(run, plus(base, n_bytes="long", **{media: "binary"}))


RESULT = "frames: long, samples: long, rate: int, checked: long, bad_checksums: long, skipped: long, variable: string, declared_frames: long, declared_bytes: long, seek: array<long>, payload_bytes: long, payload_sha256: string, tail_crc32: long, media_bytes: long, media_sha256: string"
_NAMES = [x.split(":")[0].strip() for x in RESULT.split(", ")]


def read(media_rows: DataFrame, media: str = "media", into: str = "audio") -> DataFrame:
    """media_rows with a struct of what each stored stream holds, instead of its bytes."""
    base = media_rows.drop(into)
    out_type = plus(base.drop(media), **{into: f"struct<{RESULT}>"})

    def run(batches):
        for b in batches:
            rows = []
            for m in b.column(media):
                raw = m.as_py() or b""
                a = parse(raw)
                values = (a.frames, a.samples, a.rate, a.checked, a.bad_checksums, a.skipped, a.variable, a.declared_frames, a.declared_bytes, a.offsets, len(a.payload), hashlib.sha256(a.payload).hexdigest(), zlib.crc32(a.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest())
                rows.append(dict(zip(_NAMES, values, strict=True)))
            kind = pa.struct([(n, {"rate": pa.int32(), "variable": pa.string(), "payload_sha256": pa.string(), "media_sha256": pa.string(), "seek": pa.list_(pa.int64())}.get(n, pa.int64())) for n in _NAMES])
            keep = [c for c in b.schema.names if c != media]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, kind)], names=[*keep, into])

    return base.mapInArrow(run, out_type)


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = saved(stored(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    a = read(media)
    x = F.col("audio")
    seek = F.concat_ws(",", *(x["seek"][F.greatest(F.lit(0), F.least(F.size(x["seek"]) - 1, F.floor(F.size(x["seek"]) * k / 4).cast("int")))] for k in range(5)))
    feature = F.format_string("frames=%d;duration=%d/%d;checked=%d;bad=%d;skipped=%d;table=%s:%d;seek=%s", x["frames"], x["samples"], x["rate"], x["checked"], x["bad_checksums"], x["skipped"], x["variable"], x["declared_frames"], seek)
    return a.select("doc_id", "n_bytes", "audio.payload_bytes", "audio.payload_sha256", "audio.tail_crc32", "audio.media_bytes", "audio.media_sha256", feature.alias("feature"))
