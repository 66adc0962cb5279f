"""Scalar text functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def member_name(s: Column) -> Column:
    """Keeps ASCII letters, digits, '.', '_' and '-'; all else becomes '_'."""
    return F.regexp_replace(s, "[^A-Za-z0-9._-]", "_")


def file_name(s: Column, default: str = "cast") -> Column:
    """A folder name: known suffix off, no control characters, separators to '_', 64 bytes at most, cut between characters."""
    s = F.regexp_replace(s, r"(?i)\.(dir|cst|dxr|cxt|dcr|cct)$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1F\x7F]", ""), r"[/\\: .]", "_")
    s = F.encode(F.regexp_replace(s, "^_+|_+$", ""), "UTF-8")
    # what is left of a character that is cut becomes the replacement character, which goes
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(s, 1, 64).cast("string")), "\uFFFD+$", "")
    s = F.when(F.length(s) > 64, cut).otherwise(F.decode(s, "UTF-8"))
    return F.when(F.length(s) > 0, s).otherwise(default)


def unix_lines(s: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(s, "\r\n?", "\n")


def padded(n: Column, *rest: Column) -> Column:
    """A number of at least four digits, then the rest, joined by '_'."""
    return F.format_string("_".join(["%04d", *["%s"] * len(rest)]), n, *rest)


def extension(path: Column) -> Column:
    """The lower-cased last segment of a path, without a query."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"^([^?]*)", 1), r"([^/]*)$", 1))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("%06X", (F.shiftleft(r, 16) + F.shiftleft(g, 8) + b).bitwiseAND(F.lit(0xFFFFFF)))


def scaled(code: Column, top: int) -> Column:
    """A code of 0 .. top on 0 .. 255, rounded half up, in integers."""
    return F.floor((code * 255 + top // 2) / top)
