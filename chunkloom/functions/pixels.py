"""Pixels: unpacking, palettes, and images, sounds and colour tables as files. Arrays are numpy's."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from chunkloom.sources.container import looks_packed

DEPTHS = (1, 2, 4, 8, 16, 32)


def row_bytes(width: int, bpp: int) -> int:
    """Bytes of a row if a record has none: whole bytes, an even number."""
    n = -(-width * bpp // 8)
    return n + (n & 1)


def unpacked(data: bytes, size: int) -> bytes:
    """``size`` bytes: a zlib stream (cut, never padded), raw bytes if there are enough, or runs, padded with zeros."""
    if looks_packed(data):
        return zlib.decompress(data)[:size]
    if len(data) >= size:
        return data[:size]
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 0x80:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
    return bytes(out[:size]).ljust(size, b"\0")


def runs(data: bytes) -> bytes:
    """Packs bytes as ``unpacked`` reads them."""
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 129 and data[at + n : at + n + 1] == data[at : at + 1]:
            n += 1
        if n > 1:
            out += bytes((257 - n, data[at]))
            at += n
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and data[end : end + 1] != data[end + 1 : end + 2]:
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def _rows(data: bytes, height: int, pitch: int) -> np.ndarray:
    raw = np.frombuffer(unpacked(data, pitch * height), np.uint8)
    return np.pad(raw, (0, pitch * height - len(raw))).reshape(height, pitch)


def indices(data: bytes, width: int, height: int, bpp: int, pitch: int) -> np.ndarray:
    """One code a pixel, from 1, 2, 4 or 8 bits each; what a row lacks is 0."""
    if bpp not in (1, 2, 4, 8):
        raise ValueError(f"{bpp} bits a pixel")
    rows = _rows(data, height, pitch)
    each = 8 // bpp
    shifts = np.arange(8 - bpp, -1, -bpp, dtype=np.uint8)
    out = (rows[:, :, None] >> shifts & ((1 << bpp) - 1)).reshape(height, pitch * each)
    return np.pad(out, ((0, 0), (0, max(0, width - pitch * each))))[:, :width].astype(np.uint8)


def placed(codes: np.ndarray, bpp: int) -> np.ndarray:
    """Codes of 2 or 4 bits on the 256 slots of a palette."""
    if bpp not in (2, 4):
        return codes
    top = (1 << bpp) - 1
    return ((codes.astype(np.int64) * 255 + top // 2) // top).astype(np.uint8)


def rgba(data: bytes, width: int, height: int, bpp: int, pitch: int, palette: list, version: int = 0) -> np.ndarray:
    """height x width x 4. One bit is black or white whatever the palette; colours without data are opaque black."""
    out = np.zeros((height, width, 4), np.uint8)
    out[:, :, 3] = 255
    if bpp == 1:
        out[:, :, :3] = np.where(indices(data, width, height, 1, pitch)[:, :, None] != 0, 0, 255)
    elif bpp in (2, 4, 8):
        table = np.zeros((256, 3), np.uint8)
        table[: min(256, len(palette))] = np.array(palette[:256], np.uint8).reshape(-1, 3)
        out[:, :, :3] = table[placed(indices(data, width, height, bpp, pitch), bpp)]
    elif bpp == 16:
        _deep16(out, data, width, height, pitch // 2 if pitch else width)
    elif bpp == 32:
        _deep32(out, data, width, height, pitch // 4 if pitch else width, version >= 1000)
    else:
        raise ValueError(f"{bpp} bits a pixel")
    return out


def _deep16(out: np.ndarray, data: bytes, width: int, height: int, scan: int) -> None:
    """5-5-5; rows of packed data hold all high bytes before the low ones."""
    size, split = scan * height * 2, len(data) < scan * height * 2
    raw = unpacked(data, size)
    have = np.arange(size).reshape(height, scan * 2) < len(raw)
    raw = np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(height, scan * 2).astype(np.uint16)
    high, low, ok = (raw[:, :scan], raw[:, scan:], have[:, scan:]) if split else (raw[:, 0::2], raw[:, 1::2], have[:, 1::2])
    value, n = high << 8 | low, min(width, scan)
    for c, shift in enumerate((10, 5, 0)):
        v = value[:, :n] >> shift & 31
        out[:, :n, c] = np.where(ok[:, :n], v << 3 | v >> 2, 0)


def _deep32(out: np.ndarray, data: bytes, width: int, height: int, scan: int, planes: bool) -> None:
    """Alpha, red, green, blue: by pixel, or as four runs in each row."""
    size = scan * height * 4
    raw = unpacked(data, size)
    have = (np.arange(size) < len(raw)).reshape(height, scan * 4)
    raw = np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(height, scan * 4)
    parts = [raw[:, i * scan : (i + 1) * scan] if planes else raw[:, i::4] for i in range(4)]
    ok, n = (have[:, 3 * scan :] if planes else have[:, 3::4]), min(width, scan)
    for c, part in zip((3, 0, 1, 2), parts, strict=True):
        out[:, :n, c] = np.where(ok[:, :n], part[:, :n], 255 if c == 3 else 0)


def png(width: int, height: int, pixels: bytes, palette: list | None = None) -> bytes:
    """RGBA pixels, or indices with a palette."""

    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    wide = width * (1 if palette else 4)
    lines = b"".join(b"\0" + pixels[y * wide : (y + 1) * wide] for y in range(height))
    out = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 3 if palette else 6, 0, 0, 0))
    if palette:
        out += part(b"PLTE", bytes(v for c in palette for v in c))
    return out + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def wav(samples: bytes, rate: int, bits: int, channels: int) -> bytes:
    block = channels * bits // 8
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * block, block, bits)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(samples), b"WAVE") + form + struct.pack("<4sI", b"data", len(samples)) + samples


def frame_start(data: bytes) -> int:
    """The first place of a valid audio frame header, or -1."""
    at = data.find(b"\xff", 0, max(0, len(data) - 4))
    while at >= 0:
        a, b = data[at + 1], data[at + 2]
        # sync bits, a known version and layer, a bit rate and a sample rate with a value
        if a & 0xE0 == 0xE0 and a >> 3 & 3 != 1 and a >> 1 & 3 and 0 < b >> 4 < 15 and b >> 2 & 3 != 3:
            return at
        at = data.find(b"\xff", at + 1, len(data) - 4)
    return -1


def sound_file(tag: bytes, data: bytes, head: dict) -> tuple[str, bytes] | None:
    """(extension, content) of a sound: known containers as they are, audio frames unwrapped, samples as WAV."""
    if not data:
        return None
    if data[:4] == b"FORM":
        return "aiff", data
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "wav", data
    if data[:3] == b"ID3" or len(data) > 2 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0:
        return "mp3", data
    if (at := frame_start(data)) >= 0:
        return "mp3", data[at : at + 4] + data[at + 4 :].rstrip(b"\xff")
    if tag == b"ediM":
        return "bin", data
    samples = data[head.get("start", 0) :]
    return "wav", wav(samples, head.get("sample_rate") or 22050, head.get("sample_size") or 8, head.get("channels") or 1)


def palette_text(colors: list) -> str:
    return "\n".join(["JASC-PAL", "0100", str(len(colors)), *(f"{r} {g} {b}" for r, g, b in colors), ""])
