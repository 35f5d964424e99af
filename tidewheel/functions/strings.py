"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_left(s: Column, n: int, pad: str) -> Column:
    """To n characters: cut if longer; empty for n of 0 or less; with an empty pad, short strings stay as they are."""
    return F.lit("") if n <= 0 else F.lpad(s, n, pad)


def pad_right(s: Column, n: int, pad: str) -> Column:
    return F.lit("") if n <= 0 else F.rpad(s, n, pad)


def replace_char(s: Column, old: str, new: str) -> Column:
    return F.translate(s, old, new)


def remove_char(s: Column, char: str) -> Column:
    return F.translate(s, char, "")


def url_encoded(s: Column) -> Column:
    """Per cent encoding, with spaces as %20."""
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def url_decoded(s: Column) -> Column:
    """What url_encoded made, or any form encoding, as text; null for a broken one."""
    return F.try_url_decode(s)


def trim_slashes(s: Column) -> Column:
    return F.btrim(s, F.lit("/"))


def chop(s: Column, most: int) -> Column:
    """The longest prefix of whole characters with most bytes of UTF-8 at most."""
    raw = F.encode(s, "UTF-8")
    follows = lambda n: F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80
    cut = F.substring(raw, 1, 0)
    for n in range(max(0, most - 3), most + 1):  # a character has four bytes at most
        cut = F.when(F.coalesce(follows(n), F.lit(False)), cut).otherwise(F.substring(raw, 1, n))
    return F.when(F.octet_length(s) <= most, s).otherwise(F.decode(cut, "UTF-8"))


def chop_loosely(s: Column, most: int) -> Column:
    """The first most characters."""
    return F.left(s, F.lit(most))
