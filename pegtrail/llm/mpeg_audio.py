"""MPEG audio columns: write and read Layer III streams.

`pack_mpeg` stores bytes losslessly as the ancillary data of silent MPEG-1 Layer III frames. `scan_mpeg` reads any
MPEG-1/2/2.5 Layer I-III stream: it skips and counts tags (ID3v2, ID3v1, APEv2), finds the frames by their headers,
resynchronises after bytes that belong to none, reads a Xing, Info or VBRI table, verifies each frame's CRC-16, and
gives the exact duration as samples over rate, the offset of every frame and the bytes that the frames carry.

Defined cases: a null or empty text is an empty payload, so 64 zero bytes; a null stream has no frames, no rate and a
duration of 0 samples; a stream that is cut gives the frames that are whole. Repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pegtrail.llm.batches import map_slices, strings

# Fixed values of the MPEG audio formats: kbit/s by (MPEG-1?, layer), rates by version bits, samples a frame.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

#: What pack_mpeg writes: mono 32 kHz MPEG-1 Layer III with CRC, so that no frame needs padding.
RATE, SIDE = 32000, 17
UNIT = 64


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ 0x8005 if value & 0x8000 else value << 1
        table.append(value & 0xFFFF)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(protected: bytes) -> int:
    """The CRC-16 of MPEG audio (polynomial 0x8005, first value 0xFFFF)."""
    value = 0xFFFF
    for byte in protected:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    return value


#: Bits of a Layer II allocation by subband, for each of the format's five tables.
_ALLOC = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "lsf": [4] * 4 + [3] * 7 + [2] * 19}


def crc16_bits(frame: bytes, h: dict) -> int:
    """The CRC-16 of a Layer I or II frame: of its header's last two bytes, its allocations and, in Layer II, its selections."""
    mode, bound = frame[3] >> 6, 4 * ((frame[3] >> 4 & 3) + 1)
    channels = 1 if mode == 3 else 2
    if h["layer"] == 1:
        alloc = [4] * 32
    elif h["like"][0] != 3:
        alloc = _ALLOC["lsf"]
    elif (each := h["kbps"] // channels) <= 48:
        alloc = _ALLOC["d" if h["hz"] == 32000 else "c"]
    else:
        alloc = _ALLOC["a" if each <= 80 or h["hz"] == 48000 else "b"]
    bits = "".join(f"{x:08b}" for x in frame[6 : 6 + 64])
    at = selections = 0
    for band, width in enumerate(alloc):
        joint = mode == 1 and band >= bound
        for _ in range(1 if joint else channels):
            if h["layer"] == 2 and "1" in bits[at : at + width]:
                selections += 2 * (channels if joint else 1)
            at += width
    at += selections
    value = 0xFFFF
    for bit in f"{frame[2]:08b}{frame[3]:08b}" + bits[:at]:
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ int(bit) else 0)
    return value


@lru_cache(maxsize=4096)
def header(word: bytes) -> dict | None:
    """The fields of a 4-byte frame header, or None if it isn't one (free-format frames aren't read)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = (word[1] >> 3) & 3, 4 - ((word[1] >> 1) & 3), word[2] >> 4, (word[2] >> 2) & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    first = version == 3
    kbps, hz, padding = BITRATES[first, layer][index], RATES[version][rate], (word[2] >> 1) & 1
    samples, mono = SAMPLES[first, layer], word[3] >> 6 == 3
    size = (12 * kbps * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + padding
    side = 0 if layer != 3 else ((17 if mono else 32) if first else (9 if mono else 17))
    protected = not word[1] & 1
    if size < 4 + 2 * protected + side:
        return None
    return {"size": size, "samples": samples, "hz": hz, "kbps": kbps, "layer": layer, "side": side, "protected": protected, "like": (version, layer, rate)}


def _frame_head(index: int, protected: bool) -> bytes:
    word = bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | 2 << 2, 0xC0])
    if not protected:
        return word + bytes(SIDE)
    return word + struct.pack(">H", crc16(word[2:] + bytes(SIDE))) + bytes(SIDE)


_HEADS = [_frame_head(i, True) if i else b"" for i in range(15)]
_SIZES = [144 * k * 1000 // RATE for k in BITRATES[True, 3]]
_ROOM = [size - len(head) for size, head in zip(_SIZES, _HEADS)]
_VBR_INDEX = 5  # bitrate of the frame that holds the Xing table: 288 bytes


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def pack(payload: bytes) -> bytes:
    """An ID3v2 tag with the payload's length, a Xing frame, then frames of the bitrate that the rest needs."""
    frames, at, offsets = [], 0, []
    position = _SIZES[_VBR_INDEX]
    while at < len(payload):
        left = len(payload) - at
        index = next((i for i in range(1, 15) if _ROOM[i] >= left), 14)
        body = payload[at : at + _ROOM[index]]
        frames.append(_HEADS[index] + body + bytes(_ROOM[index] - len(body)))
        offsets.append(position)
        position += _SIZES[index]
        at += len(body)
    total = position
    toc = bytes(min(255, 256 * offsets[len(offsets) * p // 100] // total) for p in range(100)) if offsets else bytes(100)
    table = b"Xing" + struct.pack(">III", 0x0F, len(frames), total) + toc + struct.pack(">I", 0)
    head = _frame_head(_VBR_INDEX, False)
    vbr = head + table + bytes(_SIZES[_VBR_INDEX] - len(head) - len(table))
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + vbr + b"".join(frames)


def _id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """The size of the ID3v2 tag at `at` and its text frames (versions 2.3 and 2.4)."""
    major, size = data[at + 3], 0
    for byte in data[at + 6 : at + 10]:
        size = size << 7 | byte & 127
    end, texts, pos = min(at + 10 + size, len(data)), {}, at + 10
    while major in (3, 4) and pos + 10 <= end and data[pos] != 0:
        name = data[pos : pos + 4]
        length = int.from_bytes(data[pos + 4 : pos + 8], "big")
        if major == 4:
            length = sum((data[pos + 4 + i] & 127) << (21 - 7 * i) for i in range(4))
        body = data[pos + 10 : min(pos + 10 + length, end)]
        if name[:1] == b"T" and body:
            words = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").split("\x00")
            key = name.decode("latin-1") + (":" + words.pop(0) if name == b"TXXX" and len(words) > 1 else "")
            texts[key] = words[0]
        pos += 10 + length
    return end + 10 * bool(data[at + 5] & 0x10) - at, texts


def _trailing(data: bytes, last: int) -> list[tuple[str, int, int]]:
    """The tags (kind, where it is marked, where it begins) that may end the first `last` bytes, the last one first."""
    found = []
    if last >= 128 and data[last - 128 : last - 125] == b"TAG":
        found.append(("id3v1", last - 128, last - 128))
        last -= 128
    if last >= 32 and data[last - 32 : last - 24] == b"APETAGEX":
        found.append(("ape", last - 32, last - min(last, struct.unpack("<I", data[last - 20 : last - 16])[0] + 32 * (data[last - 9] >> 7))))
    return found


def scan(data: bytes | None) -> dict:
    """All that a stream has: tags, table, frames (offset, header), checks, duration and the bytes carried.

    What looks like a trailing tag is none if a frame covers its mark that the end or another frame follows.
    """
    data = data or b""
    if not (tail := _trailing(data, len(data))):
        return _scan(data, len(data))
    whole = _scan(data, len(data))
    starts = {at for at, _ in whole["frames"]} | {len(data)}
    spans = [(at, at + h["size"]) for at, h in whole["frames"] if at + h["size"] in starts]
    carried = lambda mark: any(a < mark < z for a, z in spans)
    if carried(tail[0][1]):
        tail = [x for x in _trailing(data, len(data)) if x[0] == "ape" and x[1] == len(data) - 32]
    tail = tail[: next((i for i, x in enumerate(tail) if carried(x[1])), len(tail))]
    if not tail:
        return whole
    found = _scan(data, tail[-1][2])
    found["tags"] |= {kind: 1 for kind, _, _ in tail}
    return found


def _scan(data: bytes, last: int) -> dict:
    """The same of the first `last` bytes, without trailing tags."""
    tags, texts, vbr = Counter(), {}, None
    frames: list[tuple[int, dict]] = []
    good = bad = lost = skipped = 0
    bodies, at, like = [], 0, None
    synced, tag_at = True, -1  # the next "ID3" out of step, looked for again only when it is passed
    while at < last:
        if data[at : at + 3] == b"ID3" and at + 10 <= last:
            size, more = _id3v2(data, at)
            tags["id3v2"] += 1
            texts |= more
            at += size
            continue
        h = header(data[at : at + 4])
        if h and at + h["size"] <= last and (like in (None, h["like"])):
            # out of step, or at the start, a header counts only if another frame of its kind, a tag or the end follows
            then = at + h["size"]
            if (synced and like) or then == last or data[then : then + 3] == b"ID3" or ((n := header(data[then : then + 4])) and n["like"] == h["like"]):
                table = at + 4 + h["side"] + 2 * h["protected"]
                if not frames and vbr is None and (data[at + 4 + h["side"] : at + 8 + h["side"]] in (b"Xing", b"Info") or data[at + 36 : at + 40] == b"VBRI"):
                    vbr = _vbr(data, at, h)
                else:
                    if h["protected"]:
                        ok = (crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]]) if h["layer"] == 3 else crc16_bits(data[at:then], h)) == int.from_bytes(data[at + 4 : at + 6], "big")
                        good, bad = good + ok, bad + (not ok)
                    frames.append((at, h))
                    bodies.append(data[table:then])
                at, like, synced = then, h["like"], True
                continue
        if synced:
            lost, synced = lost + 1, False
        if tag_at <= at:
            tag_at = found if (found := data.find(b"ID3", at + 1, last)) >= 0 else last
        here, at = at, min(found if (found := data.find(b"\xff", at + 1, last)) >= 0 else last, tag_at)
        skipped += at - here
    return {"tags": dict(tags), "texts": texts, "vbr": vbr, "frames": frames, "crc_good": good, "crc_bad": bad, "resyncs": lost, "skipped": skipped, "samples": sum(h["samples"] for _, h in frames), "hz": frames[0][1]["hz"] if frames else None, "bodies": bodies}


def _vbr(data: bytes, at: int, h: dict) -> dict:
    """The fields of a Xing or Info table, or of a VBRI one."""
    if data[at + 36 : at + 40] == b"VBRI":
        size, count = struct.unpack(">II", data[at + 46 : at + 54]) if len(data) >= at + 54 else (None, None)
        return {"kind": "VBRI", "frames": count, "bytes": size, "toc": b""}
    pos = at + 4 + h["side"]
    kind, flags = data[pos : pos + 4].decode(), int.from_bytes(data[pos + 4 : pos + 8], "big")
    pos, found = pos + 8, {"kind": kind, "frames": None, "bytes": None, "toc": b""}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            found[name] = int.from_bytes(data[pos : pos + 4], "big")
            pos += 4
    if flags & 4:
        found["toc"] = data[pos : pos + 100]
    return found


def payload_of(found: dict) -> bytes:
    """What pack() stored."""
    size = found["texts"].get("TXXX:payload_bytes", "0")
    return b"".join(found["bodies"])[: int(size) if size.isascii() and size.isdigit() and len(size) < 19 else 0]


def feature(found: dict) -> str:
    """The scan's features as JSON: exact duration as samples over rate, seek offsets by their hash."""
    offsets = np.array([at for at, _ in found["frames"]], "<u8")
    vbr = found["vbr"] or {}
    return json.dumps(
        {
            "frames": len(offsets), "samples": found["samples"], "rate": found["hz"], "duration_us": found["samples"] * 1_000_000 // found["hz"] if found["hz"] else 0,
            "kbps": {str(k): n for k, n in sorted(Counter(h["kbps"] for _, h in found["frames"]).items())}, "table": vbr.get("kind"), "table_frames": vbr.get("frames"), "table_bytes": vbr.get("bytes"),
            "toc": vbr.get("toc", b"").hex()[:32], "tags": found["tags"], "crc_good": found["crc_good"], "crc_bad": found["crc_bad"], "resyncs": found["resyncs"],
            "seek_sha256": hashlib.sha256(offsets.tobytes()).hexdigest()[:16],
        },
        separators=(",", ":"),
    )


def pack_mpeg(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a stream."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        def step(part: pa.RecordBatch) -> dict:
            raw = [x.encode() for x in strings(part.column(1))]
            return {key: part.column(0), "n_bytes": [len(x) for x in raw], "media": [pack(x + bytes(-len(x) % UNIT or UNIT * (not x))) for x in raw]}

        return step

    return map_slices(df, [key, text], text, f"`{key}` {kind}, n_bytes long, media binary", make)


def scan_mpeg(df: DataFrame, key: str = "doc_id", media: str = "media", also: tuple[str, ...] = (), seek: bool = True) -> DataFrame:
    """(key, `also`, payload, samples, rate, n_frames, crc_bad, resyncs, seek_offsets, feature) of each stream.

    Without `seek` the payload and the offsets are left out and their digests returned instead.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *also)}
    common = "samples long, rate long, n_frames long, crc_bad long, resyncs long, feature string"
    more = "payload binary, seek_offsets array<bigint>" if seek else "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"

    def make():
        def step(part: pa.RecordBatch) -> dict:
            data = [x or b"" for x in part.column(len(kinds)).to_pylist()]
            found = [scan(x) for x in data]
            out = {c: part.column(i) for i, c in enumerate(kinds)} | {
                "samples": [x["samples"] for x in found], "rate": [x["hz"] for x in found], "n_frames": [len(x["frames"]) for x in found], "crc_bad": [x["crc_bad"] for x in found],
                "resyncs": [x["resyncs"] for x in found], "feature": [feature(x) for x in found],
            }
            payloads = [payload_of(x) for x in found]
            if seek:
                return out | {"payload": payloads, "seek_offsets": [[at for at, _ in x["frames"]] for x in found]}
            return out | {
                "payload_bytes": [len(x) for x in payloads], "payload_sha256": [hashlib.sha256(x).hexdigest() for x in payloads], "tail_crc32": [zlib.crc32(x[-UNIT:]) for x in payloads],
                "media_bytes": [len(x) for x in data], "media_sha256": [hashlib.sha256(x).hexdigest() for x in data],
            }

        return step

    return map_slices(df, [*kinds, media], media, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", {common}, {more}", make)
