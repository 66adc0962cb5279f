"""Bytes as numbers: a bounded reader for Python code, and the same as native expressions over BINARY columns."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


class Truncated(ValueError):
    """Fewer bytes than a record needs."""


class Reader:
    """Reads numbers from bytes in one byte order; raises Truncated beyond the end."""

    def __init__(self, data: bytes, at: int = 0, big: bool = True):
        self.data, self.at, self.order = data, at, ">" if big else "<"

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Truncated(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, kinds: str) -> tuple:
        """Numbers by struct's letters."""
        fmt = self.order + kinds
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))

    def one(self, kind: str) -> int:
        return self.read(kind)[0]

    def varint(self) -> int:
        """Base 128, most significant group first, at most five bytes, 32 bits kept."""
        value = 0
        for _ in range(5):
            byte = self.one("B")
            value = (value << 7 | byte & 0x7F) & 0xFFFFFFFF
            if byte < 0x80:
                return value
        return value


def varint(value: int) -> bytes:
    groups = [value & 0x7F]
    while value := value >> 7:
        groups.append(value & 0x7F | 0x80)
    return bytes(reversed(groups))


def pascal(data: bytes, at: int = 0) -> bytes:
    """A string after its length in one byte; empty if it doesn't fit."""
    if at >= len(data) or at + 1 + data[at] > len(data):
        return b""
    return data[at + 1 : at + 1 + data[at]]


def mac_roman(data: bytes) -> str:
    return data.decode("mac_roman")


def tag_text(tag: bytes) -> str:
    """A four-byte tag for display: printable ASCII as it is, other bytes escaped."""
    return "".join(chr(b) if 32 <= b < 127 else f"\\x{b:02x}" for b in tag)


# Native expressions. Offsets count from 0; out of range gives null.


def unsigned(data: Column, at: int, n: int, big: bool = True) -> Column:
    """n bytes as an unsigned number."""
    if not big:
        return sum((F.shiftleft(unsigned(data, at + i, 1), 8 * i) for i in range(1, n)), unsigned(data, at, 1))
    part = F.substring(data, at + 1, n)
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def signed(data: Column, at: int, n: int, big: bool = True) -> Column:
    value = unsigned(data, at, n, big)
    return F.when(value >= 1 << (8 * n - 1), value - (1 << (8 * n))).otherwise(value)


def tag(data: Column, at: int) -> Column:
    return F.decode(F.substring(data, at + 1, 4), "ISO-8859-1")


def numbers(data: Column, n: int) -> Column:
    """All n-byte unsigned big-endian numbers of a blob, as an array."""
    count = F.floor(F.octet_length(data) / n).cast("int")
    each = F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.hex(F.substring(data, (i - 1) * n + 1, F.lit(n))), 16, 10).cast("long"))
    return F.when(count > 0, each).otherwise(F.array().cast("array<bigint>"))
