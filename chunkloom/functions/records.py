"""Decoders of chunk contents, each from bytes to plain values. All numbers are big-endian unless a table says else."""

from __future__ import annotations

import math
import re
import struct
from functools import lru_cache

from chunkloom.functions.bytes import Reader, Truncated, mac_roman, pascal

MOST_ROWS, MOST_ITEMS, MOST_LIBRARIES = 100_000, 10_000, 1_000

#: Kinds of members by code.
KINDS = {1: "bitmap", 2: "filmLoop", 3: "text", 4: "palette", 5: "picture", 6: "sound", 7: "button", 8: "shape", 9: "movie", 10: "digitalVideo", 11: "script", 12: "xtra", 13: "frame", 14: "font"}
#: Tags of parts of members as old files embed them, reversed, and the kind that a part tells.
PARTS = {b"DTIB": "bitmap", b"muhT": "bitmap", b"rcsL": "script", b"tXTS": "text", b"TXTS": "text", b" DNS": "sound", b"TULC": "palette", b"FCRD": None, b"ediM": None, b"fniC": None, b"*SAC": None}
#: What a row of an old member's parts may hold: least and largest tag, and children below a bound (fixed values).
ROW_TAGS, ROW_CHILDREN, ROW_MISSES, LEAST_INLINE = (1000, 15000), 5000, 3, 50
_PART = re.compile(b"(?=" + b"|".join(map(re.escape, PARTS)) + b")")
SHAPES = {1: "rect", 2: "ovalRect", 3: "oval", 8: "line"}
SCRIPTS = {1: "score", 3: "movie", 7: "parent"}


def links(data: bytes) -> tuple[str, list[tuple[int, int, bytes]]]:
    """(layout, rows of child, parent, tag) of a link table: little-endian, big-endian, or without a header."""
    if len(data) < 12:
        raise Truncated("a link table of under 12 bytes")
    for name, order in (("le", "<"), ("be", ">")):
        size, _, total, used = struct.unpack_from(order + "HHII", data)
        if size == 12:
            rows = min(total, used, MOST_ROWS, (len(data) - 12) // 12)
            numbers = struct.iter_unpack(order + "III", data[12 : 12 + 12 * rows])
            return name, [(child, parent, tag.to_bytes(4, "big")) for child, parent, tag in numbers]
    body = data[1:]
    if data[0] == 0 and all(33 <= b < 127 for b in body[:4]) and len(body) % 12 <= 3:
        rows = min(len(body) // 12, MOST_ROWS)
        return "headerless", [(child, parent, tag) for tag, child, parent in struct.iter_unpack("<4sII", body[: 12 * rows])]
    raise ValueError("a link table of no known layout")


def items(data: bytes, at: int) -> list[tuple[int, int]]:
    """(start, end) of the items behind an offset table; an item ends where the next begins, the last with them all."""
    r = Reader(data, at)
    n = r.one("H")
    if not 0 < n <= MOST_ITEMS:
        return []
    offsets = [*r.read(f"{n}i"), r.one("i")]
    return [(r.at + a, r.at + b) for a, b in zip(offsets, offsets[1:], strict=False)]


def member(data: bytes, big: bool = True) -> dict:
    """kind, its code, layout, info and specific bytes, tags of embedded parts; ``old`` if it has no blocks of its own
    for info and specific bytes, so that the whole record is one."""
    if len(data) < 6:
        raise Truncated("a member of under 6 bytes")
    order = ">" if big else "<"
    if len(data) >= 12:
        code, info, spec = struct.unpack_from(order + "III", data)
        if 1 <= code <= 20 and info < len(data) and spec < len(data):
            body = data[12 : 12 + info]
            return {"kind": KINDS.get(code, "unknown"), "kind_code": code, "layout": "d5", "info": body, "spec": data[12 + info : 12 + info + spec], "child_tags": [], "old": not (info and spec)}
    code, tags = data[6] if len(data) > 6 else 0, []
    spec, info = struct.unpack_from(order + "HI", data)
    body, old = data[12 : 12 + info], not (spec and info and len(data) >= 12)
    if len(data) >= 16:
        found = (data[i : i + 4] for i in range(len(data) - 3))
        tags = list(dict.fromkeys(t for t in found if t in PARTS))
        for t in tags:
            if PARTS[t]:
                return {"kind": PARTS[t], "kind_code": None, "layout": "d3", "info": body, "spec": data if old else data[12 + info : 12 + info + spec], "child_tags": [t[::-1].decode() for t in tags], "old": old}
    return {"kind": KINDS.get(code, "unknown"), "kind_code": code, "layout": "d4", "info": body, "spec": data[6:] if old else data[12 + info : 12 + info + spec], "child_tags": [], "old": old}


def entries_end(data: bytes) -> int | None:
    """Where the rows of an old member's parts end, which its pixels follow; None without rows.

    A row has a tag, a child (both little-endian) and a name. The first is that of a known name with a plausible tag
    and child, wherever it lies; behind it rows of any name count, until three in a row are not plausible.
    """

    def likely(at: int) -> bool:
        tag, child = struct.unpack_from("<II", data, at)
        return ROW_TAGS[0] <= tag <= ROW_TAGS[1] and child < ROW_CHILDREN

    if len(data) < 16:
        return None
    end = next((m.start() + 4 for m in _PART.finditer(data, 8) if likely(m.start() - 8)), None)
    misses = 0
    for at in range(end, len(data) - 11, 12) if end else ():
        misses = 0 if likely(at) else misses + 1
        if misses == ROW_MISSES:
            break
        end = at + 12 if not misses else end
    return end


def inline_bitmap(data: bytes) -> tuple[dict, bytes] | None:
    """Record and pixels of an old member, which holds both; None if neither place has a rectangle of a usable size."""
    for at in (2, 8) if len(data) >= 20 else ():
        top, left, bottom, right = struct.unpack_from(">4h", data, at)
        width, height = abs(right - left), abs(bottom - top)
        if 0 < width < 10_000 and 0 < height < 10_000:
            end = entries_end(data)
            body = data[end:] if end is not None and len(data) - end > LEAST_INLINE else data
            return bitmap_info(b"") | {"width": width, "height": height, "bpp": 8}, body
    return None


def member_name(info: bytes) -> str | None:
    """The second item of a member's info block."""
    try:
        at = Reader(info).one("i")
        if len(info) < 20 or not 0 < at < len(info):
            return None
        own = items(info, at)
        if len(own) < 2 or own[1][1] <= own[1][0] or own[1][0] < 0:
            return None
        return pascal(info, own[1][0]).decode("utf-8", "replace") or None
    except Truncated:
        return None


def script_id(info: bytes) -> int | None:
    return struct.unpack_from(">i", info, 16)[0] if len(info) >= 20 else None


def libraries(data: bytes) -> list[dict]:
    """Rows of a library list: each has a stride of items, of which one is the name, one the path, one the range."""
    try:
        at, _, count, stride, _ = Reader(data).read("IHHHH")
        if at >= len(data) or count > MOST_LIBRARIES or not stride:
            return []
        spans = items(data, at)
    except Truncated:
        return []
    cut = [data[a:b] if 0 <= a < b <= len(data) and b - a < 10_000 else b"" for a, b in spans]
    item = lambda i: cut[i] if i < len(cut) else b""
    text = lambda b: "".join(chr(c) if 32 <= c < 127 else "?" for c in pascal(b))
    out = []
    for i in range(count):
        first = i * stride
        low, high, own = struct.unpack_from(">HHi", item(first + 4)) if len(item(first + 4)) >= 8 else (0, 0, i + 1)
        has = len(item(first + 4)) >= 8 and high >= low
        out.append({"id": own, "name": text(item(first + 1)), "path": text(item(first + 2)), "min_member": low, "max_member": high, "member_count": high - low + 1 if has else 0})
    return out


def shape(spec: bytes) -> dict | None:
    if len(spec) < 17:
        return None
    kind, y, x, height, width = struct.unpack_from(">5H", spec)
    color, back, fill, thick, direction = spec[12:17]
    return {"shape": SHAPES.get(kind, "unknown"), "reg_y": y, "reg_x": x, "height": height, "width": width, "color": color, "back": back, "fill": fill, "thickness": thick, "direction": direction, "filled": fill != 0, "outline_invisible": fill == 0 and thick <= 1}


def bitmap_info(spec: bytes) -> dict:
    """Size, depth, pitch, registration point and palette id of a bitmap; zeros where the record is short."""
    out = {"width": 0, "height": 0, "bpp": 1, "pitch": 0, "palette_id": 0, "has_palette": False, "reg_x": 0, "reg_y": 0}
    if len(spec) < 10:
        return out | {"bpp": 0}
    pitch, top, left, bottom, right = struct.unpack_from(">H4h", spec)
    for name, n in (("width", abs(right - left)), ("height", abs(bottom - top))):
        out[name] = n if n < 10_000 else 0
    deep = bool(pitch & 0x8000)
    out["pitch"] = pitch & (0x3FFF if deep else 0x0FFF)
    if len(spec) >= 22:
        out["reg_y"], out["reg_x"] = struct.unpack_from(">hh", spec, 18)
    if deep:
        out["has_palette"] = True
        out["bpp"] = (spec[23] if len(spec) > 23 else 1) or 1
        if len(spec) >= 28:
            out["palette_id"] = struct.unpack_from(">h", spec, 26)[0]
    return out


def palette(data: bytes) -> list[tuple[int, int, int]]:
    """256 colours of a table in one of three layouts, told by its length; slots it hasn't are black."""
    n = len(data)
    if n < 4:
        raise Truncated("a colour table of under 4 bytes")
    if n == 1536 or (n - 4) % 6 and n % 6 == 0:
        first, count, at = 0, n // 6, 0
    elif (n - 4) % 6 == 0:
        first, last = struct.unpack_from(">HH", data)
        count, at = (last - first + 1 if last >= first else 256), 4
    else:
        raise ValueError(f"a colour table of {n} bytes")
    out = [(0, 0, 0)] * 256
    count = min(count, 256, (n - at) // 6)
    for i, rgb in enumerate(struct.iter_unpack(">3H", data[at : at + 6 * count])):
        if first + i < 256:
            out[first + i] = tuple((v + 128) // 257 for v in rgb)
    return out


@lru_cache
def builtin_palette(number: int) -> tuple[tuple[int, int, int], ...] | None:
    """Built-in palettes that follow a rule: -1, a cube of six steps a channel with ramps, and -3, greys.

    The others are data that isn't ours to give, so they are unknown here, as are numbers without a palette.
    """
    if number == -1:
        steps = range(255, -1, -51)
        cube = [(r, g, b) for r in steps for g in steps for b in steps][:-1]  # black comes last
        ramp = [v for v in range(238, 0, -17) if v % 51]
        ramps = [tuple(v if c in on else 0 for c in range(3)) for on in ((0,), (1,), (2,), (0, 1, 2)) for v in ramp]
        return (*cube, *ramps, (0, 0, 0))
    if number == -3:
        return tuple((255 - i,) * 3 for i in range(256))
    return None


def palette_of_id(clut_id: int) -> tuple | None:
    """The built-in palette that a stored id of 0 or less names."""
    return builtin_palette(clut_id - 1) if clut_id <= 0 else None


def tail_filled(colors: list) -> list:
    """Black slots 246 to 254 take the system palette's colours."""
    system = builtin_palette(-1)
    return [system[i] if 246 <= i <= 254 and tuple(c) == (0, 0, 0) else tuple(c) for i, c in enumerate(colors)]


def styled_text(data: bytes, big: bool = True, roman: bool = False) -> dict:
    """Text and its format runs. Bytes are UTF-8 with replacement, or Mac Roman if asked for."""
    if len(data) < 16:
        raise Truncated("a text of under 16 bytes")
    r = Reader(data, 0, big)
    offset, size, _ = r.read("III")
    if offset != 12:
        return {"text": "", "runs": []}
    raw = r.take(size) if r.at + size <= len(data) else b""
    runs = []
    try:
        for _ in range(r.one("H")):
            start, height, ascent, font, slant, _, points, red, green, blue = r.read("IHHHBBHHHH")
            runs.append({"start": start, "height": height, "ascent": ascent, "font_id": font, "slant": slant, "size": points, "r": red, "g": green, "b": blue})
    except Truncated:
        pass
    return {"text": mac_roman(raw) if roman else raw.decode("utf-8", "replace"), "runs": runs}


def sound(tag: bytes, data: bytes, big: bool = True) -> dict:
    """Format and header of a sound; ``start`` is where its samples begin."""
    out = {"format": "unknown", "data_size": len(data), "sample_rate": 0, "sample_size": 0, "channels": 0, "looping": False, "loop_start": 0, "loop_end": 0, "start": 0}
    if tag == b"ediM":
        return out | {"format": {b"FORM": "aiff", b"WAVE": "wav"}.get(data[:4], "unknown")}
    if len(data) < 8:
        raise Truncated("a sound of under 8 bytes")
    r = Reader(data, 0, big)
    kind, n = r.read("HH")
    if kind not in (1, 2):
        return out
    r.at = min(r.at + 4 * n, r.at + 4 * ((len(data) - r.at) // 4))
    out |= {"format": "snd", "sample_rate": 22050, "sample_size": 8, "channels": 1}
    if kind == 2 and r.at + 16 <= len(data):
        rate, start, end, _, _ = r.read("IIIHH")
        out |= {"sample_rate": rate, "looping": end > start, "loop_start": start, "loop_end": end, "start": r.at, "data_size": len(data) - r.at}
    return out


def script_context(data: bytes) -> list[tuple[int, int]]:
    """(section id, flags) of each script."""
    count, at = Reader(data, 8).one("i"), Reader(data, 16).one("H")
    out = []
    for i in range(min(max(count, 0), 1_000_000)):
        if at + 12 * i + 12 > len(data):
            break
        out.append(struct.unpack_from(">4xiH", data, at + 12 * i))
    return out


def script_names(data: bytes) -> list[str]:
    r = Reader(data, 16)
    r.at, count = r.read("HH")
    out = []
    try:
        for _ in range(min(count, MOST_ROWS)):
            out.append(r.take(r.one("B")).decode("utf-8", "replace"))
    except Truncated:
        pass
    return out


def font_map(data: bytes) -> list[tuple[int, int, str]]:
    """(font id, platform, name)."""
    size, _, used = struct.unpack_from(">i4s8xi", data) if len(data) >= 20 else (0, 0, 0)
    out = []
    for i in range(min(max(used, 0), MOST_ITEMS)):
        at = 36 + 8 * i
        if at + 8 > len(data):
            break
        offset, platform, font = struct.unpack_from(">iHH", data, at)
        name = 10 + size + offset
        n = struct.unpack_from(">H", data, name)[0] if 0 <= name <= len(data) - 2 else 0
        out.append((font, platform, mac_roman(data[name + 2 : name + 2 + n])))
    return out


def float80(data: bytes) -> float:
    """An 80-bit extended number."""
    top, mantissa = struct.unpack(">HQ", data[:10])
    sign, power = (-1.0 if top & 0x8000 else 1.0), top & 0x7FFF
    if power == 0x7FFF:
        return float("nan") if mantissa << 1 & 0xFFFFFFFFFFFFFFFF else sign * math.inf
    if not -0x3FE <= power - 0x3FFF < 0x3FF:
        return 0.0 * sign
    return sign * math.ldexp(mantissa >> 11, power - 16446 + 11)
