"""Builds chunks and files of the format from plain values."""

import struct

from chunkloom.sources import container


def pascal(s: bytes) -> bytes:
    return bytes((len(s),)) + s


def item_table(items: list[bytes]) -> bytes:
    ends = [sum(map(len, items[:i])) for i in range(len(items) + 1)]
    return struct.pack(">H", len(items)) + b"".join(struct.pack(">i", e) for e in ends) + b"".join(items)


def info(name: bytes = b"", script_id: int = 0) -> bytes:
    return struct.pack(">5i", 20, 0, 0, 0, script_id) + item_table([b"", pascal(name) if name else b""])


def member(kind: int, spec: bytes = b"", name: bytes = b"", script_id: int = 0) -> bytes:
    own = info(name, script_id)
    return struct.pack(">III", kind, len(own), len(spec)) + own + spec


def links(rows: list[tuple[int, int, bytes]], order: str = ">") -> bytes:
    body = b"".join(struct.pack(order + "III", c, p, int.from_bytes(t, "big")) for c, p, t in rows)
    return struct.pack(order + "HHII", 12, 12, len(rows), len(rows)) + body


def member_list(ids: list[int]) -> bytes:
    return struct.pack(f">{len(ids)}I", *ids)


def bitmap(width: int, height: int, bpp: int, pitch: int, palette: int, reg=(0, 0)) -> bytes:
    deep = struct.pack(">H4h8x", pitch | 0x8000, 0, 0, height, width) + struct.pack(">hhBBxxh", reg[1], reg[0], 0, bpp, palette)
    return deep


def config(version: int = 0x4C7, low: int = 1, high: int = 9) -> bytes:
    out = bytearray(80)
    struct.pack_into(">HH4h", out, 0, 80, 7, 10, 20, 490, 660)
    struct.pack_into(">HH", out, 12, low, high)
    out[18:20], out[26:28] = b"\x22\x33", b"\x01\x11"
    struct.pack_into(">h", out, 28, 255)
    struct.pack_into(">H", out, 36, version)
    struct.pack_into(">HH", out, 54, 15, 1)
    struct.pack_into(">hh", out, 76, -1, -1)
    return bytes(out)


def text(s: bytes) -> bytes:
    run = struct.pack(">IHHHBBHHHH", 0, 14, 10, 3, 1, 0, 12, 65535, 0, 257)
    return struct.pack(">III", 12, len(s), 22) + s + struct.pack(">H", 1) + run


def colours(start: int, rgb: list[tuple[int, int, int]]) -> bytes:
    return struct.pack(">HH", start, start + len(rgb) - 1) + b"".join(struct.pack(">3H", *(v * 257 for v in c)) for c in rgb)


def context(sections: list[int]) -> bytes:
    head = bytearray(44)
    struct.pack_into(">i", head, 8, len(sections))
    struct.pack_into(">H", head, 16, 44)
    return bytes(head) + b"".join(struct.pack(">iiHH", 0, s, 4, 0) for s in sections)


def names(all_: list[bytes]) -> bytes:
    return bytes(16) + struct.pack(">HH", 20, len(all_)) + b"".join(map(pascal, all_))


def code(*ops) -> bytes:
    """Operations (code, argument or None), arguments of one byte, or two from 0x80 on."""
    return b"".join(bytes((op,)) + (b"" if arg is None else struct.pack(">b" if op in (0x41,) else ">B", arg) if op < 0x80 else struct.pack(">H", arg)) for op, arg in ops)


def script(bytecode: bytes, args: list[int] = (), locals_: list[int] = (), literals: list[tuple[int, bytes]] = (), name: int = 0, kind: int = 3) -> bytes:
    head = bytearray(92)
    at = 92
    parts = {}

    def put(key: str, data: bytes) -> None:
        nonlocal at
        parts[key] = (at, data)
        at += len(data) + (len(data) & 1)

    put("code", bytecode)
    put("args", b"".join(struct.pack(">h", i) for i in args))
    put("locals", b"".join(struct.pack(">h", i) for i in locals_))
    row = struct.pack(">hHII", name, 0, len(bytecode), parts["code"][0]) + struct.pack(">HIHIHI", len(args), parts["args"][0], len(locals_), parts["locals"][0], 0, 0)
    put("handlers", row.ljust(46, b"\0"))
    blob, rows = b"", b""
    for k, value in literals:
        rows += struct.pack(">iI", k, int.from_bytes(value, "big") if k == 4 else len(blob))
        if k != 4:
            blob += struct.pack(">i", len(value)) + value
    put("literals", rows)
    put("blob", blob)
    struct.pack_into(">HH", head, 16, 92, 1)
    struct.pack_into(">I", head, 38, kind)
    struct.pack_into(">HIHIHIHI", head, 60, 0, at, 0, at, 1, parts["handlers"][0], len(literals), parts["literals"][0])
    struct.pack_into(">II", head, 84, len(blob), parts["blob"][0])
    return bytes(head) + b"".join(d + b"\0" * (len(d) & 1) for _, d in parts.values())


def movie() -> list[tuple[int, bytes, bytes, bool]]:
    """A file with a member of each kind that is written out."""
    red = [(i, 0, 0) for i in range(256)]
    members = [
        (11, member(1, bitmap(4, 2, 8, 4, 2, (3, 1)), b"pic one")),
        (12, member(4, b"", b"reds")),
        (13, member(3, b"", b"words")),
        (14, member(6, b"", b"beep")),
        (15, member(8, struct.pack(">5H2x5B", 3, 1, 2, 30, 40, 5, 0, 1, 2, 0), b"dot")),
        (16, member(11, b"", b"main", 1)),
        (17, member(1, bitmap(8, 1, 1, 2, 0), b"mask")),
    ]
    sound = struct.pack(">HHI", 2, 1, 5) + struct.pack(">IIIHH", 11025, 0, 0, 0, 60) + b"\x80\x90\x70\x80"
    body = code((0x41, 7), (0x42, 1), (0x57, 1), (0x01, None))
    parts = [
        (21, b"BITD", bytes((5, 6, 7, 8, 250, 251, 252, 0)), False),
        (22, b"CLUT", colours(0, red), False),
        (23, b"STXT", text(b"one\rtwo\r\nthree"), True),
        (24, b"snd ", sound, False),
        (25, b"LctX", context([26]), True),
        (26, b"Lscr", script(body), False),
        (27, b"Lnam", names([b"go", b"put"]), True),
        (28, b"BITD", b"\xa5\x00", False),
        (30, b"KEY*", links([(21, 11, b"BITD"), (22, 12, b"CLUT"), (23, 13, b"STXT"), (24, 14, b"snd "), (28, 17, b"BITD")], "<"), True),
        (31, b"CAS*", member_list([11, 12, 0, 13, 14, 15, 16, 17]), True),
        (32, b"DRCF", config(), True),
    ]
    return [(i, b"CASt", d, True) for i, d in members] + parts


def packed() -> bytes:
    return container.write_packed(movie())
