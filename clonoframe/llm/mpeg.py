"""Media columns: MPEG audio.

``parse`` reads any MPEG audio stream (versions 1, 2, 2.5; layers I, II, III): ID3v2 and ID3v1 tags,
Xing/Info and VBRI tables, frame headers with resynchronisation after foreign bytes, and the
checksums of protected frames. Durations are exact fractions; each frame has its offset.

``store`` puts bytes into a stream losslessly: an ID3v2 tag with the payload's length, an Info frame with the
seek table, then one MPEG-2 layer III frame of 576 samples for each 576 bytes. A frame's
side information says that no Huffman bits are used (silence), and the bytes stand in the main data
region as ancillary data; CRC protection is on. ``load`` reads them back through ``parse``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame

from .common import map_rows

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index 1-14, and samples a second by index 0-2.
BITRATES = {
    ("1", 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    ("1", 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    ("1", 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    ("2", 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    ("2", 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    ("2", 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {"1": [44100, 48000, 32000], "2": [22050, 24000, 16000], "2.5": [11025, 12000, 8000]}

UNIT = 576
_TABLE = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1) ^ 0x8005 if _c & 0x8000 else _c << 1
    _TABLE.append(_c & 0xFFFF)


def crc16(data: bytes) -> int:
    """The checksum of protected frames: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ _TABLE[(crc >> 8) ^ b]
    return crc


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    mode: int
    mode_ext: int
    size: int
    samples: int
    side: int


def header(word: int) -> Header | None:
    """The frame header in a 32-bit word; None where it can't be one (free format included)."""
    if word >> 21 != 0x7FF:
        return None
    version = {3: "1", 2: "2", 0: "2.5"}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    rate_i, bit_i = word >> 10 & 3, word >> 12 & 15
    if version is None or layer == 4 or rate_i == 3 or bit_i in (0, 15) or word & 3 == 2:
        return None
    kbps = BITRATES["1" if version == "1" else "2", layer][bit_i - 1]
    rate, pad, mode = RATES[version][rate_i], word >> 9 & 1, word >> 6 & 3
    channels = 1 if mode == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == "1" else 576
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples * 125 * kbps // rate + pad
    side = 0 if layer < 3 else (17 if channels == 1 else 32) if version == "1" else (9 if channels == 1 else 17)
    return Header(version, layer, not word >> 16 & 1, kbps, rate, channels, mode, word >> 4 & 3, size, samples, side)


@dataclass
class Stream:
    tags: dict = field(default_factory=dict)
    table: dict | None = None
    frames: list = field(default_factory=list)  # (offset, Header)
    skipped: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    seconds: Fraction = Fraction(0)

    def seek(self, second: Fraction) -> int | None:
        """Byte offset of the frame that plays at ``second``; None past the end."""
        at = Fraction(0)
        for offset, h in self.frames:
            at += Fraction(h.samples, h.rate)
            if at > second:
                return offset
        return None


def _id3v2(data: bytes, at: int) -> tuple[int, dict] | None:
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return None
    major = data[at + 3]
    size = _syncsafe(data[at + 6 : at + 10])
    end, p, tags = at + 10 + size, at + 10, {}
    if major not in (3, 4):
        return end, tags
    if data[at + 5] & 0x40 and p + 4 <= min(end, len(data)):  # extended header
        n = _syncsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4])
        p += max(4, n)
    while p + 10 <= min(end, len(data)) and data[p]:
        n = _syncsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8])
        tags.setdefault(data[p : p + 4].decode("latin-1"), data[p + 10 : min(end, p + 10 + n)])
        p += 10 + n
    return end + (10 if data[at + 5] & 0x10 and major == 4 else 0), tags


def _syncsafe(b: bytes) -> int:
    n = 0
    for x in b:
        n = n << 7 | x & 0x7F
    return n


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """A variable-bitrate table in a frame that starts at ``at``."""
    if h.layer != 3:
        return None
    for p in dict.fromkeys((at + 4 + h.side, at + 6 + h.side)):
        if data[p : p + 4] in (b"Xing", b"Info") and p + 8 <= len(data):
            out, flags, q = {"kind": data[p : p + 4].decode()}, int.from_bytes(data[p + 4 : p + 8]), p + 8
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit and q + n <= len(data):
                    out[name] = list(data[q : q + n]) if n == 100 else int.from_bytes(data[q : q + n])
                    q += n
            return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= len(data):
        _, delay, quality, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", data[p + 4 : p + 26])
        toc = [int.from_bytes(data[q : q + width]) * scale for q in range(p + 26, min(len(data), p + 26 + entries * width), max(1, width))]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "per_entry": per, "delay": delay, "quality": quality}
    return None


def _same(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _covered(data: bytes, at: int, h: Header) -> int | None:
    """How many bytes after the stored checksum it covers; None where the layer's tables are needed (II)."""
    if h.layer == 3:
        return h.side
    if h.layer == 1:
        bound = (h.mode_ext + 1) * 4 if h.mode == 1 else 32
        bits = 4 * (h.channels * bound + (32 - bound))
        return bits // 8
    return None


def parse(data: bytes) -> Stream:
    """Parse a stream. Bytes that belong to no tag and no frame count as skipped.

    A header is taken as a frame's if a fitting header, a tag or the end of the data follows its frame;
    after foreign bytes the search goes on at the next byte 255. A frame cut off by the end is not one.
    An ID3v1 tag stands in the last 128 bytes, after the last frame: the same letters within a frame are its data.
    """
    out, p, n = Stream(), 0, len(data)
    last: Header | None = None
    tag1 = n - 128 if n >= 128 and data[-128:-125] == b"TAG" else n
    known: dict[int, Header | None] = {}

    def at(q: int) -> Header | None:
        if q + 4 > n:
            return None
        w = int.from_bytes(data[q : q + 4])
        if w not in known:
            known[w] = header(w)
        return known[w]

    crcs: dict[bytes, int] = {}
    while p < n:
        if p == tag1:
            out.tags["id3v1"] = data[p + 3 : p + 33].split(b"\0")[0]
            break
        end = tag1 if p < tag1 else n
        if data[p] == 0x49 and (tag := _id3v2(data, p)):
            out.tags |= {k: v for k, v in tag[1].items() if k not in out.tags}
            p = min(end, tag[0])
            continue
        h = at(p)
        fits = h is not None and p + h.size <= n and (last is None or _same(last, h))
        if fits:
            q = p + h.size
            after = at(q)
            fits = q == n or data[q : q + 3] in (b"ID3", b"TAG") or after is not None and _same(h, after)
        if not fits:
            if h is None and last is not None and data.find(b"\xff", p) < 0:
                out.skipped += end - p
                p = end
                continue
            q = data.find(b"\xff", p + 1)
            i = data.find(b"ID3", p + 1) if not out.frames else -1
            q = min(x for x in (q, i, end) if x >= 0)
            out.skipped += q - p
            p = q
            continue
        if h.protected and (c := _covered(data, p, h)) is not None:
            body = data[p + 2 : p + 4] + data[p + 6 : p + 6 + c]
            if body not in crcs:
                crcs[body] = crc16(body)
                if len(crcs) > 4096:
                    crcs.clear()
                    crcs[body] = crc16(body)
            good = crcs[body] == int.from_bytes(data[p + 4 : p + 6])
            out.crc_ok += good
            out.crc_bad += not good
        if not out.frames and out.table is None and (t := _table(data, p, h)):
            out.table = t | {"offset": p}
        else:
            out.frames.append((p, h))
        last = h
        p += h.size
    by: dict[int, int] = {}
    for _, h in out.frames:
        by[h.rate] = by.get(h.rate, 0) + h.samples
    out.seconds = sum((Fraction(s, r) for r, s in by.items()), Fraction(0))
    return out


# The frame that carries bytes: MPEG-2 layer III, protected, 144 kbit/s, 16 kHz, mono: 648 bytes, 576 samples.
_HEAD = bytes([0xFF, 0xF2, 0xD8, 0xC0])
_SIDE = bytes(9)
_PROLOGUE = _HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2) + _SIDE
_SIZE = 648
_FILL = bytes(_SIZE - len(_PROLOGUE) - UNIT)


def store(payload: bytes) -> bytes:
    """A stream that carries ``payload`` (a multiple of 576 bytes; b"" gives no audio frame)."""
    if len(payload) % UNIT:
        raise ValueError("the payload is not whole units")
    count = len(payload) // UNIT
    body = b"".join([x for i in range(0, len(payload), UNIT) for x in (_PROLOGUE, payload[i : i + UNIT], _FILL)])
    toc = bytes(min(255, 256 * (1 + i * count // 100) // (count + 1)) for i in range(100))
    info = _PROLOGUE + b"Info" + (7).to_bytes(4) + count.to_bytes(4) + (_SIZE * (count + 1)).to_bytes(4) + toc
    text = b"\0payload\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4) + b"\0\0" + text
    tag = b"ID3\x03\0\0" + bytes(len(frame) >> s & 0x7F for s in (21, 14, 7, 0)) + frame
    return tag + info + bytes(_SIZE - len(info)) + body


def load(media: bytes) -> tuple[bytes, Stream]:
    """The payload in a stream that ``store`` made, and the parsed stream."""
    s = parse(media)
    skip = len(_PROLOGUE)
    return b"".join([media[o + skip : o + skip + UNIT] for o, _ in s.frames]), s


def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 255 appended up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def feature(s: Stream) -> str:
    """What the columns store of a stream, as one string: exact duration, checksums, table, seek offsets."""
    third = [s.seek(s.seconds * k / 4) for k in range(4)]
    rates = sorted({h.kbps for _, h in s.frames})
    return ";".join((
        f"frames={len(s.frames)}", f"seconds={s.seconds.numerator}/{s.seconds.denominator}",
        f"kbps={','.join(map(str, rates))}", f"crc={s.crc_ok}/{s.crc_ok + s.crc_bad}", f"skipped={s.skipped}",
        f"table={s.table['kind'] if s.table else ''}:{s.table.get('frames') if s.table else ''}",
        f"seek={','.join(map(str, third))}",
    ))


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every whole text as an MPEG stream, read it back, and give digests and features.

    Null texts count as empty; an empty text has one unit of bytes 255. Equal texts have equal values.
    """

    def row(doc_id, text):
        raw = (text or "").encode()
        payload = pad(raw)
        media = store(payload)
        got, s = load(media)
        if got != payload:
            raise ValueError(f"doc_id {doc_id}: the stream doesn't give its payload back")
        return (
            doc_id, len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(media),
            hashlib.sha256(media).hexdigest(), feature(s), len(s.frames), float(s.seconds), s.crc_bad,
        )

    return map_rows(
        docs, ["doc_id", "text"], row,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, n_frames long, seconds double, crc_bad long",
    )


def parse_column(rows: DataFrame, key: str, media: str) -> DataFrame:
    """General form: parse any binary column of MPEG audio into stored columns; null media gives null results."""

    def row(k, m):
        if m is None:
            return k, None, None, None, None, None, None, None
        s = parse(m)
        return (
            k, len(s.frames), s.seconds.numerator, s.seconds.denominator, s.crc_ok, s.crc_bad, s.skipped,
            [o for o, _ in s.frames],
        )

    kind = dict(rows.dtypes)[key]
    return map_rows(
        rows, [key, media], row,
        f"`{key}` {kind}, n_frames long, seconds_num long, seconds_den long, crc_ok long, crc_bad long, skipped long, "
        "seek_offsets array<long>",
    )
