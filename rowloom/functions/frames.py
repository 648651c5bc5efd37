"""Raw frames: one codec payload in an envelope of codec, length and checksum.

Plain functions over bytes, Column forms of the envelope in built-in functions, and an
Arrow batch form of the byte codec.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import primitives as P

#: Magic, version and codec numbers; then come payload length (8 bytes) and CRC-32 (4 bytes), little endian: fixed values.
MAGIC, VERSION = b"CMP1", 1
CODECS = {"rle": 1, "delta_varint_u64": 2}
HEADER_BYTES = 18


def encode_frame(codec: str, payload: bytes) -> bytes:
    return MAGIC + bytes([VERSION, CODECS[codec]]) + len(payload).to_bytes(8, "little") + P.checksum(payload).to_bytes(4, "little") + payload


def decode_frame(codec: str, data: bytes) -> bytes:
    """The payload of a whole frame of this codec."""
    head, payload = data[:HEADER_BYTES], data[HEADER_BYTES:]
    if len(head) < HEADER_BYTES or head[:4] != MAGIC:
        raise ValueError("not a frame")
    if head[4] != VERSION or head[5] not in CODECS.values():
        raise ValueError("a frame of another version or codec")
    if head[5] != CODECS[codec]:
        raise ValueError(f"the frame is not {codec}")
    if int.from_bytes(head[6:14], "little") != len(payload):
        raise ValueError("frame length does not match")
    P.verify(payload, int.from_bytes(head[14:], "little"))
    return payload


def encode_bytes(data: bytes) -> bytes:
    return encode_frame("rle", P.rle_encode(data))


def decode_bytes(frame: bytes) -> bytes:
    return P.rle_decode(decode_frame("rle", frame))


def encode_numbers(values: list[int]) -> bytes:
    return encode_frame("delta_varint_u64", P.delta_varint_encode(values))


def decode_numbers(frame: bytes) -> list[int]:
    return P.delta_varint_decode(decode_frame("delta_varint_u64", frame))


# columns


@F.pandas_udf(T.BinaryType())
def rle_payload(raw: pd.Series) -> pd.Series:
    """Run-length coded bytes; null stays null."""
    return raw.map(lambda b: None if b is None else P.rle_encode(b))


@F.pandas_udf(T.BinaryType())
def rle_content(payload: pd.Series) -> pd.Series:
    return payload.map(lambda b: None if b is None else P.rle_decode(b))


def _little(value: Column, size: int) -> Column:
    """Hex digits of a non-negative long in ``size`` bytes, the lowest first."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)))


def frame(codec: str, payload: Column) -> Column:
    head = F.lit((MAGIC + bytes([VERSION, CODECS[codec]])).hex().upper())
    return F.unhex(F.concat(head, _little(F.octet_length(payload).cast("long"), 8), _little(F.crc32(payload), 4), F.hex(payload)))


def unframe(codec: str, data: Column) -> Column:
    """The payload of a sound frame; null for anything else."""
    payload = F.substr(data, F.lit(HEADER_BYTES + 1), F.greatest(F.octet_length(data) - HEADER_BYTES, F.lit(0)))
    return F.when(frame(codec, payload) == data, payload)
