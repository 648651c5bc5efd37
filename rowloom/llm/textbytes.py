"""Vectorised work on the bytes of Arrow string columns.

A batch of texts is cut into runs of about ``RUN_BYTES`` (a longer text is a run
of its own), so memory follows the run and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on each input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 256), _BASE, _U)
        grown[0] = _U(1)
        _powers = np.cumprod(grown)
    return _powers


@dataclass
class Run:
    """Texts [first, last) of a batch: their bytes and where each begins and ends."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """Runs of a string column; null texts are empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + run_bytes, "right")) - 1)
        last = min(last, len(texts))
        yield Run(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a run in order: 64-bit hash, text number, first byte and end byte."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def find_words(run: Run, in_word: np.ndarray, fold: np.ndarray, cut: int = RUN_BYTES) -> Words:
    """``in_word``: 256 booleans, the bytes of words. ``fold``: 256 bytes applied before hashing.

    Bytes are hashed in pieces of about ``cut`` that end at a word's end.
    """
    inside = in_word[run.data]
    n = len(inside)
    if not n or not inside.any():
        return Words(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    fresh = np.zeros(n + 1, bool)
    fresh[run.bounds] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    hashes = np.empty(len(start), _U)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + cut, "right")))
        hashes[a:b] = _hash_spans(run.data, start[a:b], end[a:b], fold)
        a = b
    text = np.searchsorted(run.bounds, start, "right") - 1
    return Words(hashes, text, start, end)


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    size = end - start
    at = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    values = fold[data[np.repeat(start, size) + place]].astype(_U) + _U(1)
    values *= _power_table(int(size.max()))[place]
    return mix(np.add.reduceat(values, at) + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """As the hash of a word, for any non-empty spans, in pieces of bounded size."""
    out = np.empty(len(start), _U)
    a = 0
    total = np.cumsum(end - start)
    while a < len(start):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + RUN_BYTES, "right")))
        out[a:b] = _hash_spans(data, start[a:b], end[a:b], fold)
        a = b
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, in order; len(hashes) - n + 1 of them at least 0."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = np.zeros(count, _U)
    for i in range(n):
        out = out * _U(0xFF51AFD7ED558CCD) + hashes[i : i + count]
    return mix(out)


def member(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur in the sorted ones, and at what index (where they do)."""
    if not len(sorted_values):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values, at


def ascii_fold() -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


#: Bytes of words [^\x20\x09-\x0D]+, and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are folded.
SPACED_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM_WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
