"""Fields of whole numbers of up to 16 bits, compressed tile by tile: over each tile's minimum, or as residuals of the sum of left
and below less diagonal."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers of the two ways, widths of their tiles, and the number of bits that says 16.
MINIMUM, PARALLELOGRAM = 3, 4
STEPS = {MINIMUM: 5, PARALLELOGRAM: 3}
WIDE = 15


class Bits:
    """Numbers of some bits each, side by side, the highest bit first."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, numbers, width: int) -> None:
        n = np.atleast_1d(np.asarray(numbers, np.int64))
        if width:
            self.parts.append((n[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).ravel())

    def words(self) -> bytes:
        """All of them in words of 32 bits, the last one filled up with zeros."""
        bits = np.concatenate([*self.parts, np.zeros(32, np.uint8)])
        return np.packbits(bits[: len(bits) // 32 * 32]).tobytes()


class Taken:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).astype(np.int64), 0

    def take(self, count: int, width: int) -> np.ndarray:
        part = self.bits[self.at : self.at + count * width].reshape(count, width)
        self.at += count * width
        return (part << np.arange(width - 1, -1, -1)).sum(axis=1)


def tiles(nj: int, ni: int, step: int, start: int):
    """Slices of the tiles of a field, rows first."""
    for j in range(start, nj, step):
        for i in range(start, ni, step):
            yield slice(j, min(j + step, nj)), slice(i, min(i + step, ni))


def _need(top: int) -> int:
    bits = int(top).bit_length()
    return WIDE if bits == 16 else bits


def residuals(z: np.ndarray) -> np.ndarray:
    out = np.zeros_like(z)
    out[1:, 1:] = z[1:, 1:] - z[:-1, 1:] - z[1:, :-1] + z[:-1, :-1]
    return out


def compress(values: np.ndarray, ni: int, bits: int, way: int) -> bytes:
    """A field of numbers of so many bits, i fastest; the first word says how."""
    z = np.asarray(values, np.int64).reshape(-1, ni)
    if not 0 < bits <= 16 or z.size and (z.min() < 0 or z.max() >> bits) or 1 in z.shape:
        raise ValueError("a field of two columns and rows at least, of numbers of up to 16 bits")
    step, out = STEPS[way], Bits()
    if way == MINIMUM:
        for rows, columns in tiles(*z.shape, step, 0):
            tile = z[rows, columns].ravel()
            need = _need(tile.max() - tile.min())
            out.put(need, 4)
            if need == WIDE:
                out.put(tile, 16)
            else:
                out.put(tile.min(), bits)
                out.put(tile - tile.min(), need)
    else:
        d = residuals(z)
        width = 5 if bits >= 15 and np.abs(d).max() > 65535 else 4
        out.put(width, 3)
        out.put(z[0], bits)
        out.put(z[1:, 0], bits)
        for rows, columns in tiles(*z.shape, step, 1):
            tile = d[rows, columns].ravel()
            need = _need(np.abs(tile).max())
            out.put(need, width)
            if need:
                out.put(tile, 17 if need == WIDE else need + 1)
    head = way << 28 | (way == PARALLELOGRAM) << 25 | step << 22 | bits << 17 | 1 << 14
    return struct.pack(">I", head) + out.words()


def uncompress(data: bytes, ni: int, nj: int) -> np.ndarray:
    head = struct.unpack(">I", data[:4])[0]
    way, step, bits = head >> 28, head >> 22 & 7, head >> 17 & 31
    taken, z = Taken(data[4:]), np.zeros((nj, ni), np.int64)
    if way == MINIMUM:
        for rows, columns in tiles(nj, ni, step, 0):
            shape = z[rows, columns].shape
            need, count = int(taken.take(1, 4)[0]), shape[0] * shape[1]
            if need == WIDE:
                z[rows, columns] = taken.take(count, 16).reshape(shape)
            else:
                least = taken.take(1, bits)[0]
                z[rows, columns] = least + (taken.take(count, need).reshape(shape) if need else 0)
        return z.ravel()
    if way != PARALLELOGRAM:
        raise ValueError("a field compressed in another way")
    width = int(taken.take(1, 3)[0])
    z[0] = taken.take(ni, bits)
    z[1:, 0] = taken.take(nj - 1, bits)
    z[0, 1:] = np.diff(z[0])
    z[1:, 0] = np.diff(np.concatenate([[z[0, 0]], z[1:, 0]]))
    for rows, columns in tiles(nj, ni, step, 1):
        shape = z[rows, columns].shape
        need = int(taken.take(1, width)[0])
        if need:
            wide = 17 if need in (WIDE, 16) else need + 1
            token = taken.take(shape[0] * shape[1], wide)
            z[rows, columns] = np.where(token >> wide - 1, token - (1 << wide), token).reshape(shape)
    return z.cumsum(axis=0).cumsum(axis=1).ravel()


def best_way(ni: int, nj: int, bits: int, level: int = 1) -> int:
    """Residuals for fields of 16 columns and rows at least and more than 4 bits, unless the level is 0."""
    return MINIMUM if level == 0 or ni < 16 or nj < 16 or bits <= 4 else PARALLELOGRAM


def compressed(array: Column, ni: int, bits: int, way: int) -> Column:
    """A field as compressed bytes; null where that is no shorter than two bytes a number."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    def one(values) -> bytes | None:
        data = compress(np.asarray(values), ni, bits, way)
        return data if len(data) < 2 * len(values) else None

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(array)


def uncompressed(data: Column, ni: int, nj: int) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else uncompress(bytes(b), ni, nj))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<long>")(data)
