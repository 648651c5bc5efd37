"""Quality rules from tokeniser fertility.

Public vocabularies cut each word of a text, with a space before it: a byte-level BPE gives characters per
token and the entropy of the text's tokens, a piece vocabulary with byte fallback
gives the share of pieces that are bare bytes. A text whose measures leave the band
of its language, or of its script where the language has none, is rejected, as is
one that fails the base rules.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import load_ranks, model_proto
from .session import bound_batches
from .textbytes import runs

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, fallback_share double, token_entropy double, band string"
)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Distinct words a worker remembers; beyond it, it begins anew.
CACHE = 400_000


@dataclass(frozen=True)
class Band:
    """Limits of the measures. ``least_entropy`` (bits) holds from ``entropy_from`` tokens on."""

    least_chars: float
    most_chars: float
    most_fallback: float = 0.1
    least_entropy: float = 5.0
    entropy_from: int = 128

    def holds(self, n_tokens: int, chars: float, fallback: float, entropy: float) -> bool:
        return not n_tokens or (self.least_chars <= chars <= self.most_chars and fallback <= self.most_fallback and (n_tokens < self.entropy_from or entropy >= self.least_entropy))


#: Bands by language, and by the script of most characters where the language is null or not listed; scripts
#: without a band of their own take "other". All limits are set by hand; the four languages' lower limits of characters per token
#: lie near the 0.5 % quantile of documents labelled good, less 3 %, which is the rule of ``fit_bands``.
BANDS = {
    "en": Band(2.05, 6.5),
    "de": Band(2.10, 6.5),
    "fr": Band(1.82, 6.5),
    "es": Band(1.89, 6.5),
    "latin": Band(1.5, 7.0),
    "other": Band(0.3, 7.0, most_fallback=0.9, least_entropy=3.0),
}
#: First and last code points of scripts' main Unicode blocks: fixed values.
SCRIPTS = {
    "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x0400, 0x052F),),
    "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)),
    "devanagari": ((0x0900, 0x097F),),
    "bengali": ((0x0980, 0x09FF),),
    "tamil": ((0x0B80, 0x0BFF),),
    "thai": ((0x0E00, 0x0E7F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}


def script(text: str) -> str:
    """latin if at least half of the characters lie below U+0250, else the listed script with the most characters, kana counting for han beside it, else other."""
    beyond = [ord(c) for part in _beyond_latin().findall(text) for c in part]
    if 2 * len(beyond) <= len(text):
        return "latin"
    points = np.array(beyond)
    counts = {name: sum(int(((points >= low) & (points <= high)).sum()) for low, high in blocks) for name, blocks in SCRIPTS.items()}
    if counts["kana"]:
        counts["kana"] += counts["han"]
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else "other"


@lru_cache(maxsize=1)
def _beyond_latin():
    import re

    return re.compile("[^\x00-ɏ]+")


class Vocabularies:
    """What is known of each word: its tokens in the first vocabulary, its pieces and bare bytes in the second."""

    def __init__(self, ranks: str, pieces: str):
        import sentencepiece

        self.bpe = sentencepiece.SentencePieceProcessor(model_proto=model_proto(load_ranks(ranks)))
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())], np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.tokens, self.n_pieces, self.n_bytes = array("q", [0]), array("i"), array("q"), array("q")

    def learn(self, words: set[bytes]) -> None:
        """Adds words that aren't known."""
        if not words:
            return
        new = list(words)
        # All words at once, each byte as its character in the model; words hold no newline.
        chars = (np.frombuffer(b"\n".join(b" " + w for w in new), np.uint8).astype("<u2") + 0x100).tobytes().decode("utf-16-le").split(chr(0x100 + 10))
        tokens = self.bpe.encode(chars, num_threads=1)
        pieces = self.pieces.encode([w.decode() for w in new], num_threads=1)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.at.extend((self.at[-1] + np.cumsum(list(map(len, tokens)))).tolist())
        self.tokens.extend(chain.from_iterable(tokens))
        sizes = np.array(list(map(len, pieces)), np.int64)
        ends = np.concatenate(([0], np.cumsum(self.is_byte[np.fromiter(chain.from_iterable(pieces), np.int64, int(sizes.sum()))])))
        last = np.cumsum(sizes)
        self.n_pieces.extend(sizes.tolist())
        self.n_bytes.extend((ends[last] - ends[last - sizes]).tolist())

    def measure(self, numbers: np.ndarray) -> tuple[int, float, float]:
        """Tokens, share of bare bytes among pieces, entropy of the tokens in bits."""
        at, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.tokens, np.int32)
        sizes = at[numbers + 1] - at[numbers]
        total = int(sizes.sum())
        tokens = flat[np.arange(total) + np.repeat(at[numbers] - (np.cumsum(sizes) - sizes), sizes)]
        counts = np.unique(tokens, return_counts=True)[1] / max(total, 1)
        pieces = int(np.frombuffer(self.n_pieces, np.int64)[numbers].sum())
        share = int(np.frombuffer(self.n_bytes, np.int64)[numbers].sum()) / max(pieces, 1)
        return total, share, float(-(counts * np.log2(counts)).sum()) + 0.0


@lru_cache(maxsize=2)
def loaded(ranks: str, pieces: str) -> Vocabularies:
    return Vocabularies(ranks, pieces)


def repeated_words(numbers: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; ``numbers`` tells words apart."""
    n = len(numbers) - 2
    if n < 2:
        return 0
    local = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    pairs = np.unique(local[:-1] * len(local) + local[1:], return_inverse=True)[1].astype(np.int64)
    _, which, counts = np.unique(pairs[:-1] * len(local) + local[2:], return_inverse=True, return_counts=True)
    often = counts[which] > 1
    hit = np.zeros(len(numbers), bool)
    for i in range(3):
        hit[i : i + n] |= often
    return int(hit.sum())


def measure_text(text: str, words: list[bytes], lang: str | None, vocab: Vocabularies, bands: dict[str, Band] | None) -> tuple:
    """The columns after doc_id. Without bands, ``band`` is the language, or the script of texts without one, and none is held to it."""
    numbers = np.fromiter(map(vocab.known.__getitem__, words), np.int64, len(words))
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeat = repeated_words(numbers)
    failed = n < 50 or 100 * repeat > 50 * n
    tokens, share, entropy = vocab.measure(numbers) if n else (0, 0.0, 0.0)
    per_token = chars / tokens if tokens else 0.0
    if bands is None:
        band = lang or script(text)
    else:
        band = next(b for b in (lang, script(text) if lang not in bands else lang, "other") if b in bands)
    kept = not failed and (bands is None or bands[band].holds(tokens, per_token, share, entropy))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, kept, tokens, per_token, share, entropy, band


def quality_rules(docs: DataFrame, ranks: str, pieces: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """Base rules and fertility verdict of each whole text.

    ``docs`` has doc_id, text, lang; other columns are not read. ``ranks`` and
    ``pieces`` name the public vocabularies that every executor has. One row per
    row of ``docs``, null or repeated ids included. A null or empty text has no words:
    it fails the base rules. A null or unknown language takes the band of its script, and a
    script without one takes "other", which ``bands`` must have.
    """
    return _measures(docs, ranks, pieces, BANDS if bands is None else bands)


def fit_bands(docs: DataFrame, ranks: str, pieces: str, low: float = 0.005, high: float = 0.995, slack: float = 0.03, least_rows: int = 200) -> dict[str, Band]:
    """Bands from the quantiles of documents that are known to be good, by language, or by script where the language is null or empty.

    Only texts that pass the base rules count, and groups of ``least_rows`` of them or
    more get a band, with ``slack`` (a share) beyond each quantile; the entropy's is of texts long enough to be held to it.
    One row per language or script reaches the driver; no documents give no bands.
    """
    default = Band(0.0, 0.0)
    good = _measures(docs, ranks, pieces, None).where("NOT base_failed")
    entropy = F.when(F.col("n_tokens") >= default.entropy_from, F.col("token_entropy"))
    found = good.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("chars_per_token", [low, high]).alias("chars"),
        F.percentile_approx("fallback_share", high).alias("fallback"), F.percentile_approx(entropy, low).alias("entropy"),
    )
    rows = found.where(F.col("n") >= least_rows).orderBy("band").collect()
    return {r.band: Band(r.chars[0] * (1 - slack), r.chars[1] * (1 + slack), min(1.0, r.fallback * (1 + slack)), (r.entropy or 0.0) * (1 - slack)) for r in rows}


def _measures(docs: DataFrame, ranks: str, pieces: str, bands: dict[str, Band] | None) -> DataFrame:
    bound_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), *[pa.float64()] * 3, pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = loaded(ranks, pieces)
        for batch in batches:
            for run in runs(batch.column(1)):
                part = batch.slice(run.first, run.last - run.first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                split = [t.encode().split() for t in texts]
                if len(vocab.known) > CACHE:
                    vocab.clear()
                vocab.learn({w for words in split for w in words if w not in vocab.known})
                out = [measure_text(t, w, lang, vocab, bands) for t, w, lang in zip(texts, split, part.column(2).to_pylist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return read.mapInArrow(work, SCHEMA)
