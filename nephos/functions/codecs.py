"""Bit fields, missing values, quantised packing and run lengths."""

from __future__ import annotations

import hashlib
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from nephos.functions.columns import once

#: The part of a field's range above its maximum that stands for missing, by bits a value, above 8 bits 0.01.
PLUG = (2.0, 1.1, 0.55, 0.28, 0.14, 0.07, 0.035, 0.017, 0.01)


def get_bits(word: Column, right: int, count: int) -> Column:
    """count bits that end right places from the word's right end."""
    return F.shiftright(word, right).bitwiseAND(F.lit((1 << count) - 1))


def put_bits(word: Column, value: Column, right: int, count: int) -> Column:
    mask = (1 << count) - 1
    cleared = word.bitwiseAND(F.lit(~(mask << right)))
    return cleared.bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit(mask)), right))


def recut(parts: list[Column], widths: list[int], into: list[int]) -> list[Column]:
    """The bits of parts of these widths, side by side, cut into parts of other widths (each at most 62 bits)."""
    if sum(widths) != sum(into):
        raise ValueError(f"{sum(widths)} bits cannot be cut into {sum(into)}")
    made, start = [], 0
    for stop in accumulate(into):
        piece = F.lit(0).cast("long")
        for part, width, end in zip(parts, widths, accumulate(widths), strict=True):
            low, high = max(start, end - width), min(stop, end)
            if low < high:
                piece = piece.bitwiseOR(F.shiftleft(get_bits(part.cast("long"), end - high, high - low), stop - high))
        made.append(piece)
        start = stop
    return made


def plug(least: Column, most: Column, bits: int) -> Column:
    """The number that stands for missing in a field of reals of these extremes."""
    part = PLUG[bits] if bits <= 8 else 0.01
    value = most + (most - least) * part
    return F.when(value != most, value).when(most == 0, 1.0).otherwise(most * 2.0)


def plug_integer(most: Column, bits: int, signed: bool) -> Column:
    """The number that stands for missing in a field of integers: one above its maximum while the bits have room, else the
    greatest that they hold, which values may have, too."""
    top = (1 << bits - signed) - 1
    return F.when(most < top, most + 1).otherwise(F.lit(top)).cast("long")


def crc16(data: Column, seed: Column, stride: int = 1) -> Column:
    """16-bit checksum of the polynomial x^16 + x^12 + x^5 + 1 over every stride-th byte, highest bit first."""
    digits = F.hex(data)
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(stride)), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))

    def step(crc: Column, byte: Column) -> Column:
        mixed = F.get(F.transform(F.array(F.shiftright(crc, 8).bitwiseXOR(byte)), lambda x: x.bitwiseXOR(F.shiftright(x, 4))), F.lit(0))
        folded = F.transform(F.array(mixed), lambda x: F.shiftleft(crc, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x).bitwiseAND(F.lit(0xFFFF)))
        return F.get(folded, F.lit(0))

    start = seed.cast("int").bitwiseAND(F.lit(0xFFFF))
    return F.when(F.octet_length(data) == 0, start).otherwise(F.aggregate(codes, start, step))


def pack(value: Column, least: Column, most: Column, bits: int) -> Column:
    """A value as an integer of so many bits between the extremes; a constant field packs to zeros."""
    top = float((1 << bits) - 1)
    return F.when(most > least, F.round((value - least) / F.nullif(most - least, F.lit(0.0)) * top)).otherwise(0).cast("long")


def unpack(code: Column, least: Column, most: Column, bits: int) -> Column:
    return least + code * (most - least) / float((1 << bits) - 1)


def runs(values: Column) -> Column:
    """An array as its runs: structs of value and length.  A run starts where a value differs from the one before."""

    def made(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | ~F.get(v, i).eqNullSafe(F.get(v, i - 1)))
        return F.get(F.transform(F.array(F.struct(v.alias("v"), starts.alias("at"))), paired), F.lit(0))

    def paired(x: Column) -> Column:
        end = lambda k: F.coalesce(F.get(x["at"], k + 1), F.size(x["v"]))
        return F.transform(x["at"], lambda i, k: F.struct(F.get(x["v"], i).alias("value"), (end(k) - i).alias("length")))

    return F.get(F.transform(F.array(values), made), F.lit(0))


def unrun(encoded: Column) -> Column:
    return F.flatten(F.transform(encoded, lambda r: F.array_repeat(r["value"], r["length"])))


def differences(values: Column) -> Column:
    """An array as its first value and the steps after it."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def sums(steps: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.aggregate(F.slice(steps, 1, n), F.lit(0.0), lambda a, x: a + x))


#: What stands for missing in fields of reals, of signed integers of 32, 16 and 8 bits, and of unsigned ones.
MISSING_FLAGS = {"real": -1.0e38, "i4": -(1 << 31), "i2": -(1 << 15), "i1": -(1 << 7), "u4": (1 << 32) - 1, "u2": (1 << 16) - 1, "u1": (1 << 8) - 1}


def from_flag(value: Column, kind: str, flags: dict | None = None) -> Column:
    """Null where a field has the kind's flag."""
    return F.when(value != (MISSING_FLAGS | (flags or {}))[kind], value)


def to_flag(value: Column, kind: str, flags: dict | None = None) -> Column:
    return F.coalesce(value, F.lit((MISSING_FLAGS | (flags or {}))[kind]))


def hmac_md5(data: Column, key: bytes) -> Column:
    """Keyed digest of bytes, in hexadecimal; a key beyond 64 bytes counts by its own digest."""
    key = hashlib.md5(key).digest() if len(key) > 64 else key
    inner, outer = (bytes(k ^ pad for k in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return F.md5(F.concat(F.lit(bytearray(outer)), F.unhex(F.md5(F.concat(F.lit(bytearray(inner)), data)))))


def packed_words(tokens: Column, bits: int) -> Column:
    """Tokens of so many bits (of 8-, 16- or 32-bit numbers alike) side by side in words of 32 bits, the highest bit first; the
    last word is filled up with zeros."""
    digits = F.array_join(F.transform(tokens, lambda v: F.lpad(F.conv(v.bitwiseAND(F.lit((1 << bits) - 1)).cast("string"), 10, 2), bits, "0")), "")

    def words(text: Column) -> Column:
        count = F.ceil(F.length(text) / 32).cast("int")
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda w: F.conv(F.rpad(F.substring(text, w * 32 + 1, F.lit(32)), 32, "0"), 2, 10).cast("long"))

    return once(digits, words)


def unpacked_words(words: Column, bits: int, count: Column, signed: bool = False) -> Column:
    digits = F.array_join(F.transform(words, lambda w: F.lpad(F.conv(w.cast("string"), 10, 2), 32, "0")), "")

    def tokens(s: Column) -> Column:
        places = F.when(s["n"] > 0, F.sequence(F.lit(0), s["n"] - 1)).otherwise(F.array().cast("array<int>"))
        plain = F.transform(places, lambda k: F.conv(F.substring(s["t"], k * bits + 1, F.lit(bits)), 2, 10).cast("long"))
        return F.transform(plain, lambda v: F.when(v >= 1 << bits - 1, v - (1 << bits)).otherwise(v)) if signed else plain

    return once(F.struct(digits.alias("t"), count.cast("int").alias("n")), tokens)
