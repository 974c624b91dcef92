"""Scalar text functions as column expressions; lengths are code points unless they say bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space words are split on.
WORD_SPACE = "[\\p{Z}\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85]"


def words(text: Column) -> Column:
    """The non-empty pieces between white space."""
    return F.filter(F.split(text, WORD_SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WORD_SPACE}+|{WORD_SPACE}+$", "")


def utf8_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of 0..255; empty for empty text."""
    code = F.hex(F.encode(text, "UTF-8"))
    pairs = F.regexp_extract_all(code, F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def from_bytes(values: Column) -> Column:
    """The text of an array of UTF-8 bytes; null if they are not valid."""
    return F.try_validate_utf8(F.decode(F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8"))


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is a visible Latin-1 character, else the next free code point from
    U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def byte_level(text: Column) -> Column:
    """The text with each UTF-8 byte as its printable letter."""
    letters = F.array(*(F.lit(x) for x in byte_letters()))
    return F.array_join(F.transform(utf8_bytes(text), lambda b: F.get(letters, b)), "")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))
