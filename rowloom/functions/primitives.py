"""Byte primitives: plain functions over Python values, and Column forms where Spark can express them.

The Python forms check their input and raise ``ValueError``; integers are unsigned
64-bit unless a name says otherwise.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = (1 << 64) - 1


def _u64(values: list[int]) -> list[int]:
    if any(not 0 <= v <= U64 for v in values):
        raise ValueError("value out of u64 range")
    return values


# varint (LEB128)


def varint_encode(values: list[int]) -> bytes:
    out = bytearray()
    for v in _u64(values):
        while v >= 0x80:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)
    return bytes(out)


def varint_read(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value at ``at`` and the position after it; only the shortest form is valid."""
    value = shift = 0
    start = at
    while True:
        if at >= len(data):
            raise ValueError("truncated varint")
        byte = data[at]
        at += 1
        if shift == 63 and byte > 1:
            raise ValueError("varint overflow")
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            if byte == 0 and at - start > 1:
                raise ValueError("overlong varint")
            return value, at
        shift += 7


def varint_decode(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint_read(data, at)
        out.append(value)
    return out


def varint_length(value: Column) -> Column:
    """Bytes of a non-negative long."""
    return F.greatest(F.lit(1), F.ceil(bit_width(value) / 7)).cast("long")


def bit_width(value: Column) -> Column:
    """Bits of a non-negative long; 0 for 0."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value))).cast("long")


# zigzag


def zigzag_encode(value: int) -> int:
    return 2 * value if value >= 0 else -2 * value - 1


def zigzag_decode(value: int) -> int:
    return value >> 1 if not value & 1 else -(value >> 1) - 1


def zigzag(value: Column) -> Column:
    """For longs of at most 62 bits; the full range needs a decimal."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


# delta


def delta_encode(values: list[int]) -> list[int]:
    """First value, then differences; decreasing input is an error."""
    _u64(values)
    if any(b < a for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("delta input must not decrease")
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def delta_decode(deltas: list[int]) -> list[int]:
    out, total = [], 0
    for d in _u64(deltas):
        total += d
        if total > U64:
            raise ValueError("delta overflow")
        out.append(total)
    return out


def delta_encode_signed(values: list[int]) -> list[int]:
    return [_i64(b - a) for a, b in zip([0, *values], values, strict=False)]


def delta_decode_signed(deltas: list[int]) -> list[int]:
    out, total = [], 0
    for d in deltas:
        total = _i64(total + d)
        out.append(total)
    return out


def _i64(value: int) -> int:
    if not -(1 << 63) <= value < 1 << 63:
        raise ValueError("i64 overflow")
    return value


def byte_delta_encode(data: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8)
    return np.diff(x, prepend=np.uint8(0)).astype(np.uint8).tobytes()


def byte_delta_decode(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


# run length: (count, byte) pairs, counts 1..255


def rle_encode(data: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    size = np.diff(np.append(start, len(x)))
    pairs = -(-size // 255)
    out = np.empty((int(pairs.sum()), 2), np.uint8)
    out[:, 0] = 255
    last = np.cumsum(pairs) - 1
    out[last, 0] = size - 255 * (pairs - 1)
    out[:, 1] = np.repeat(x[start], pairs)
    return out.tobytes()


def rle_decode(data: bytes, most: int | None = None) -> bytes:
    if len(data) % 2:
        raise ValueError("rle data must be pairs")
    pairs = np.frombuffer(data, np.uint8).reshape(-1, 2)
    if (pairs[:, 0] == 0).any():
        raise ValueError("rle count must not be zero")
    if most is not None and int(pairs[:, 0].sum()) > most:
        raise ValueError("rle output is too long")
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()


# bit packing, least significant bit first


def bitpack_encode(values: list[int], width: int) -> bytes:
    if not 0 <= width <= 64:
        raise ValueError("bit width must be 0..64")
    if any(v >> width for v in _u64(values)):
        raise ValueError("value does not fit the bit width")
    total = 0
    for i, v in enumerate(values):
        total |= v << (i * width)
    return total.to_bytes(-(-len(values) * width // 8), "little")


def bitpack_decode(data: bytes, width: int, count: int) -> list[int]:
    if not 0 <= width <= 64:
        raise ValueError("bit width must be 0..64")
    if len(data) != -(-count * width // 8):
        raise ValueError("bit-packed length does not match")
    total = int.from_bytes(data, "little")
    if total >> (count * width):
        raise ValueError("bit-packed padding must be zero")
    mask = (1 << width) - 1
    return [total >> (i * width) & mask for i in range(count)]


def required_width(value: int) -> int:
    return value.bit_length()


def bitmap_encode(bits: list[bool]) -> bytes:
    return np.packbits(np.array(bits, bool), bitorder="little").tobytes()


def bitmap_decode(data: bytes, count: int) -> list[bool]:
    return [bool(b) for b in bitpack_decode(data, 1, count)]


# checksums and the delta-varint pipeline


def checksum(data: bytes) -> int:
    return zlib.crc32(data)


def verify(data: bytes, expected: int) -> None:
    if checksum(data) != expected:
        raise ValueError("checksum mismatch")


def delta_varint_encode(values: list[int]) -> bytes:
    return varint_encode(delta_encode(values))


def delta_varint_decode(data: bytes) -> list[int]:
    return delta_decode(varint_decode(data))
