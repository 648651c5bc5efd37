"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

The model is a serialised ``ModelProto``: one piece per rank, in rank order, whose
bytes are mapped to the characters U+0100 + byte, with score -rank, and an unknown
piece at the end; identity normalisation, no dummy prefix, no white-space rules.
Sentencepiece merges the adjacent pair whose joined piece has the highest score,
leftmost first, which is the rule of rank-ordered byte BPE. A pre-token that is
itself in the vocabulary is that one token, as in rank-ordered BPE libraries.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bound_batches
from .textbytes import runs

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
#: Distinct pre-tokens a worker remembers; beyond it, it begins anew.
CACHE = 100_000
#: Texts whose characters all lie below this code point take the quicker splitter.
LATIN = 0x250


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of ``base64 rank`` lines; ranks are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError("ranks must be contiguous from 0")
    return tokens


def to_chars(token: bytes) -> str:
    return "".join(chr(0x100 + b) for b in token)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, payload: bytes) -> bytes:
    size = _varint(len(payload)) if kind == 2 else b""
    return _varint(number << 3 | kind) + size + payload


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised model. Fields: piece 1 {text 1, score 2, type 3}, trainer 2, normaliser 3."""
    piece = lambda text, score, kind: _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))
    normal, unknown, bpe = 1, 2, 2
    pieces = [piece(to_chars(t), -float(rank), normal) for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    trainer = _field(3, 0, _varint(bpe)) + _field(4, 0, _varint(len(tokens) + 1)) + _field(40, 0, _varint(len(tokens)))
    trainer += b"".join(_field(n, 0, (1 << 64) - 1 and _varint((1 << 64) - 1)) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, b"\0") for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, normaliser)


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts below U+0250, with its classes spelt out; faster, with equal matches.

    None where the pattern has escapes other than ``\\p{L}``, ``\\p{N}``, ``\\s`` and ``\\S``.
    """
    span = lambda test: "".join(f"\\u{c:04x}" for c in range(LATIN) if test(chr(c)))
    classes = {r"\p{L}": span(lambda c: unicodedata.category(c)[0] == "L"), r"\p{N}": span(lambda c: unicodedata.category(c)[0] == "N"), r"\s": r"\t-\r\x20\x85\xa0"}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((k for k in (*classes, r"\S") if pattern.startswith(k, at)), "")
        if name == r"\S" and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif name in classes:
            out.append(classes[name] if inside else f"[{classes[name]}]")
        elif pattern[at] == "\\":
            return None
        else:
            inside = (inside or pattern[at] == "[") and pattern[at] != "]"
            out.append(pattern[at])
        at += len(name) or 1
    return re.compile("".join(out))


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.digits = [str(i) for i in range(len(tokens))]
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.split = regex.compile(pattern)
        self.latin = latin_pattern(pattern)
        self.beyond_latin = re.compile(f"[^\\x00-\\u{LATIN - 1:04x}]")
        self.known: dict[str, list[int]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if self.latin and not self.beyond_latin.search(text):
            return self.latin.findall(text)
        return self.split.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Encodes pre-tokens, in one call."""
        hard = []
        for p in pieces:
            raw = p.encode()
            if (r := self.rank.get(raw)) is not None:
                self.known[p] = [r]
            else:
                hard.append((p, to_chars(raw)))
        if hard:
            self.known.update(zip((p for p, _ in hard), self.model.encode([c for _, c in hard], num_threads=1), strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        split = [self.pre_tokens(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        self.learn(set(filterfalse(self.known.__contains__, chain.from_iterable(split))))
        for pieces in split:
            yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> bytes:
        """By the inverse of the byte map of each piece."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def id_text(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBPE:
    """One encoder for all tasks of a worker, with the pre-tokens it knows."""
    return ByteBPE(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and decoded bytes of each whole text.

    ``vocabulary`` is the path of a rank file that every executor has. One row per
    input row, null and repeated ``doc_id`` included. A null or empty text has no
    tokens (the digests of nothing). Other columns of ``docs`` are not read.
    ``round_trip`` tells if the decoded bytes are the text. ``with_ids`` adds ``ids``.
    """
    bound_batches(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary, pattern)
        for batch in batches:
            for run in runs(batch.column(1)):
                part = batch.slice(run.first, run.last - run.first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = []
                for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
                    decoded = bpe.decode(ids)
                    digest = hashlib.sha256(bpe.id_text(ids).encode()).hexdigest()
                    out.append((len(ids), digest, hashlib.sha256(decoded).hexdigest(), decoded == text.encode(), *([ids] if with_ids else [])))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32())), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids"][: 1 + len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
