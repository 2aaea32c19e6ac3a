"""Codes of names and elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 40 characters of the name code, in order of their numbers.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ/?: "


def to_base40(text: Column, width: int = 8) -> Column:
    """Text of up to width characters as a number; a character outside the alphabet counts as /."""
    padded = F.rpad(F.upper(text), width, " ")
    total = F.lit(0).cast("long")
    for i in range(width):
        place = F.position(F.substring(padded, i + 1, 1), F.lit(ALPHABET))
        digit = F.when(place > 0, place - 1).otherwise(ALPHABET.index("/"))
        total = total * 40 + digit
    return total


def from_base40(number: Column, width: int = 8) -> Column:
    digits = [F.floor(number / (40**k)).cast("long") % 40 for k in reversed(range(width))]
    return F.rtrim(F.concat(*[F.substring(F.lit(ALPHABET), (d + 1).cast("int"), F.lit(1)) for d in digits]))


def element_code(decimal: Column) -> Column:
    """FXXYYY as 2, 6 and 8 bits."""
    f, x, y = F.floor(decimal / 100_000), F.floor(decimal / 1000) % 100, decimal % 1000
    return (f * 16_384 + x * 256 + y).cast("long")


def element_decimal(code: Column) -> Column:
    f, x, y = F.shiftright(code, 14), F.shiftright(code, 8).bitwiseAND(F.lit(63)), code.bitwiseAND(F.lit(255))
    return (f * 100_000 + x * 1000 + y).cast("long")


def block_type(nature: Column, kind: Column, step: Column) -> Column:
    """4, 7 and 4 bits."""
    return (nature * 2048 + kind * 16 + step).cast("long")


def block_parts(code: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(code, 11).bitwiseAND(F.lit(15)), F.shiftright(code, 4).bitwiseAND(F.lit(127)), code.bitwiseAND(F.lit(15))


def file_name(prefix: Column, at: Column, hour: Column) -> Column:
    """prefix, date and hour of the run, underscore and three digits of forecast hour."""
    return F.concat(prefix, F.date_format(at, "yyyyMMddHH"), F.lit("_"), F.lpad(hour.cast("string"), 3, "0"))


# Text as callers of both languages hold it.


def trimmed_length(text: Column) -> Column:
    """Length without blanks at the end."""
    return F.length(F.rtrim(text))


def padded(text: Column, width: int) -> Column:
    """Exactly so many characters: cut off, or blanks at the end."""
    return F.rpad(F.substring(text, 1, width), width, " ")


def same_name(name: Column, wanted: Column, whole: bool = True) -> Column:
    """Whether names agree in either case and without blanks at the end, or start so."""
    a, b = F.upper(F.rtrim(name)), F.upper(F.rtrim(wanted))
    return a == b if whole else a.startswith(b)


def all_letters(text: Column) -> Column:
    return text.rlike("^[A-Za-z]+$")


def last_part(path: Column) -> Column:
    """What follows the last slash of a path that does not end in one."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def word_of(text: Column) -> Column:
    """Four characters as a 32-bit word, the first highest; blanks fill shorter ones."""
    codes = [F.ascii(F.substring(F.rpad(text, 4, " "), k, 1)).cast("long") for k in range(1, 5)]
    return codes[0] * (1 << 24) + codes[1] * (1 << 16) + codes[2] * (1 << 8) + codes[3]


def text_of_word(word: Column) -> Column:
    return F.concat(*[F.char(F.shiftright(word, s).bitwiseAND(F.lit(255))) for s in (24, 16, 8, 0)])
