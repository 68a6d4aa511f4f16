"""MPEG audio as a media column: a frame parser, and payload storage in Layer III frames.

parse() reads any byte string: it skips ID3v2 tags and recognises ID3v1, APE and Lyrics3 ends behind the frames that a leading
table counts (audio may hold their marks), resynchronises on frame headers
(a header counts only if another consistent one, or the end of the audio, follows it), reads Xing, Info and VBRI
tables, verifies checksums of protected frames, and gives exact durations in samples, with the byte offset of each frame
for seeking. Broken bytes are skipped and counted; nothing raises.

store() carries a payload losslessly in the ancillary bytes of valid MPEG-1 Layer III frames: 192 bytes a frame at 32 kHz,
mono, 48 kbit/s (216 bytes), checksummed, silent to a decoder, after an ID3v2 tag and an Info frame.

Defined cases: null text is empty; empty payloads are padded to one frame; equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._common import table

UNIT = 192
#: Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (low sampling rates, layer), Hz by version.
BITRATES = {
    (False, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (False, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (False, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (True, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (True, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (True, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Of Layer II: allocation bits and how many subbands have them, of MPEG-1 at 56 kbit/s a channel or more, below, and of the low sampling rates.
ALLOCATION = {"high": ((4, 11), (3, 12), (2, 7)), "low": ((4, 2), (3, 10)), "half": ((4, 4), (3, 7), (2, 19))}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    length: int
    samples: int
    mono: bool
    mode_extension: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_headers: dict[int, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The header in four bytes, or None; free-format frames are not taken."""
    key = int.from_bytes(four, "big") & 0xFFFFFFF0 if len(four) == 4 else 0
    if key in _headers:
        return _headers[key]
    found = None
    version, layer = key >> 19 & 3, 4 - (key >> 17 & 3)
    rate_at, kbps_at, pad = key >> 10 & 3, key >> 12 & 15, key >> 9 & 1
    if key >> 21 == 0x7FF and version != 1 and layer != 4 and 0 < kbps_at < 15 and rate_at != 3:
        low = version != 3
        kbps, rate = BITRATES[low, layer][kbps_at], RATES[version][rate_at]
        if layer == 1:
            length, samples = (12000 * kbps // rate + pad) * 4, 384
        else:
            samples = 576 if low and layer == 3 else 1152
            length = samples // 8 * 1000 * kbps // rate + pad
        found = Header(version, layer, not key >> 16 & 1, kbps, rate, length, samples, key >> 6 & 3 == 3, key >> 4 & 3)
    if len(_headers) < 4096:
        _headers[key] = found
    return found


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (0x8005 if value & 0x8000 else 0)
        out.append(value & 0xFFFF)
    return out


CRC = _crc_table()


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    for byte in data:
        value = (value << 8 & 0xFF00) ^ CRC[value >> 8 ^ byte]
    return value


def _crc_bits(data: bytes, bits: int, value: int) -> int:
    value = crc16(data[: bits // 8], value)
    for i in range(bits // 8 * 8, bits):
        bit = data[i // 8] >> (7 - i % 8) & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ bit else 0)
    return value


def _layer2_bits(frame: bytes, h: Header) -> int:
    """How many bits behind the checksum it covers in Layer II: all allocations, and two for each channel of a subband that has samples."""
    each = h.kbps // (1 if h.mono else 2)
    if h.version != 3:
        table_, limit = "half", 30
    elif each < 56:
        table_, limit = "low", 12 if h.rate == 32000 else 8
    else:
        table_, limit = "high", 30 if each >= 96 and h.rate != 48000 else 27
    widths = [bits for bits, n in ALLOCATION[table_] for _ in range(n)][:limit]
    bound = 0 if h.mono else limit if frame[3] >> 6 != 1 else min(limit, 4 * (h.mode_extension + 1))
    body, at, selected = int.from_bytes(frame[6:134].ljust(128, b"\0"), "big"), 0, 0
    for band, width in enumerate(widths):
        channels = 2 if band < bound else 1
        for _ in range(channels):
            at += width
            if body >> (1024 - at) & (1 << width) - 1:
                selected += 1 if channels == 2 or h.mono else 2
    return at + 2 * selected


def checksum_ok(frame: bytes, h: Header) -> bool | None:
    """Whether a protected frame's checksum holds; None where it has none, or is too short for what it covers."""
    if not h.protected or len(frame) < 6 + h.side:
        return None
    value = crc16(frame[2:4])
    if h.layer == 3:
        value = crc16(frame[6 : 6 + h.side], value)
    elif h.layer == 2:
        bits = _layer2_bits(frame, h)
        if len(frame) * 8 < 48 + bits:
            return None
        value = _crc_bits(frame[6 : 6 + (bits + 7) // 8], bits, value)
    else:  # four allocation bits a subband and channel; joint subbands share theirs
        bound = 32 if h.mono or frame[3] >> 6 != 1 else 4 * (h.mode_extension + 1)
        value = _crc_bits(frame[6:38], 4 * (32 if h.mono else 2 * bound + 32 - bound), value)
    return value == int.from_bytes(frame[4:6], "big")


@dataclass
class Audio:
    tags: list[tuple[str, int, int]] = field(default_factory=list)  # kind, start, end
    vbr: dict | None = None
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    skipped: int = 0
    checked: int = 0
    bad_checksums: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    def seek(self, sample: int) -> int:
        """Byte offset of the frame that holds a sample."""
        if not self.offsets:
            return 0
        each = self.samples // len(self.offsets)
        return self.offsets[min(sample // max(each, 1), len(self.offsets) - 1)]


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _vbr(frame: bytes, h: Header) -> dict | None:
    at = 4 + 2 * h.protected + h.side
    word = lambda i: int.from_bytes(frame[i : i + 4], "big")
    for start in {at, 4 + h.side}:
        if frame[start : start + 4] in (b"Xing", b"Info"):
            flags, i, out = word(start + 4), start + 8, {"kind": frame[start : start + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], i = word(i), i + 4
            if flags & 4:
                out["toc"] = list(frame[i : i + 100])
            return out
    if frame[36:40] == b"VBRI":
        half = lambda i: int.from_bytes(frame[i : i + 2], "big")
        n, scale, width = half(54), half(56), half(58)
        toc = [int.from_bytes(frame[62 + width * k : 62 + width * (k + 1)], "big") * scale for k in range(n)]
        return {"kind": "VBRI", "bytes": word(46), "frames": word(50), "toc": toc}
    return None


def _counted(data: bytes, at: int, end: int) -> int:
    """Where the frames end that a table in the frame at ``at`` counts; where they are broken, by its byte count; ``at`` without either."""
    h = header(data[at : at + 4])
    found = _vbr(data[at : at + h.length], h) if h and h.layer == 3 and at + h.length <= end else None
    if found is None:
        return at
    stop = at
    for _ in range(found["frames"] + 1 if "frames" in found else 0):
        n = header(data[stop : stop + 4])
        if n is None or (n.version, n.layer, n.rate) != (h.version, h.layer, h.rate) or stop + n.length > end:
            break
        stop += n.length
    else:
        if stop > at:
            return stop
    stop = at + found.get("bytes", 0)
    return stop if stop <= end else at


def parse(data: bytes) -> Audio:
    out, at, end = Audio(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end and not any(x & 0x80 for x in data[at + 6 : at + 10]):
        stop = min(end, at + 10 + _synchsafe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 0x10 else 0))
        out.tags.append(("ID3v2", at, stop))
        at = stop
    floor = _counted(data, at, end)
    while True:
        if end - floor >= 128 and data[end - 128 : end - 125] == b"TAG":
            out.tags.append(("ID3v1", end - 128, end))
            end -= 128
        elif end - floor >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
            n = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
            start = max(floor, end - max(n, 32))
            out.tags.append(("APE", start, end))
            end = start
        elif end - floor >= 15 and data[end - 9 : end] == b"LYRICS200" and data[end - 15 : end - 9].isdigit():
            start = max(floor, end - 15 - int(data[end - 15 : end - 9]))
            out.tags.append(("Lyrics3", start, end))
            end = start
        else:
            break
    like = None  # version, layer, rate: a stream keeps them
    while at + 4 <= end:
        h = header(data[at : at + 4]) if data[at] == 0xFF else None
        if h and at + h.length <= end and (like is None or like == (h.version, h.layer, h.rate)):
            after = at + h.length
            if after + 4 > end or ((n := header(data[after : after + 4])) and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate)) or like:
                frame = data[at:after]
                like = like or (h.version, h.layer, h.rate)
                if (ok := checksum_ok(frame, h)) is not None:
                    out.checked, out.bad_checksums = out.checked + 1, out.bad_checksums + (not ok)
                if not out.offsets and out.vbr is None and h.layer == 3 and (table_ := _vbr(frame, h)):
                    out.vbr, out.rate = table_, h.rate
                else:
                    out.offsets.append(at)
                    out.lengths.append(h.length)
                    out.samples, out.rate = out.samples + h.samples, h.rate
                at = after
                continue
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        out.skipped, at = out.skipped + nxt - at, nxt
    out.skipped += max(0, end - at)
    return out


def _frame_head() -> bytes:
    """MPEG-1 Layer III, protected, 48 kbit/s, 32 kHz, mono; side information all zero: no coded data, no reservoir."""
    four, side = bytes((0xFF, 0xFA, 0x38, 0xC0)), bytes(17)
    return four + crc16(side, crc16(four[2:4])).to_bytes(2, "big") + side


HEAD = _frame_head()
FRAME = 216


def store(payload: bytes) -> bytes:
    """payload, a multiple of 192 bytes, as a file of one silent frame for each 192 bytes."""
    n = len(payload) // UNIT
    if n * UNIT != len(payload) or not n:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    frames = np.zeros((n, FRAME), dtype=np.uint8)
    frames[:, : len(HEAD)] = np.frombuffer(HEAD, dtype=np.uint8)
    frames[:, len(HEAD) : len(HEAD) + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    toc = bytes(int(256 * (k * n // 100) / n) for k in range(100))
    info = HEAD + b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + toc
    body = b"\0cadenza"
    tag_frame = b"TENC" + len(body).to_bytes(4, "big") + bytes(2) + body
    size = len(tag_frame)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag_frame
    return tag + info.ljust(FRAME, b"\0") + frames.tobytes()


def payload_of(data: bytes, audio: Audio) -> bytes:
    """The payload bytes that store() put into the parsed frames."""
    return b"".join(data[at + len(HEAD) : at + len(HEAD) + UNIT] for at in audio.offsets)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def describe(audio: Audio) -> str:
    """Layer, frames, exact duration as samples over rate, checksum results, table and seek offsets (digest and every 1024th frame's)."""
    offsets = np.array(audio.offsets, dtype="<u8")
    seeks = "/".join(map(str, audio.offsets[::1024]))
    vbr = audio.vbr or {}
    return f"frames={len(audio.offsets)};duration={audio.samples}/{audio.rate};checked={audio.checked};bad={audio.bad_checksums};skipped={audio.skipped};tags={','.join(t[0] for t in audio.tags)};vbr={vbr.get('kind')}:{vbr.get('frames')}:{vbr.get('bytes')};seek_crc={zlib.crc32(offsets.tobytes()):08x};seek={seeks}"


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as MPEG audio, parses it back and describes it; with keep_media also the file itself, in column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                payload, n = padded(body.as_py())
                media = store(payload)
                audio = parse(media)
                back = payload_of(media, audio)
                if back != payload:
                    raise ValueError(f"document {doc}: the payload read back differs from the one stored")
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(audio), *[media] * keep_media))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media)
            names = [c.split()[0] for c in STORED.split(", ")] + ["media"] * keep_media
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names)

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, STORED + ", media binary" * keep_media)


def op4_mpeg_audio(spark, sf_dir):
    return media_column(table(spark, sf_dir, "documents"))
