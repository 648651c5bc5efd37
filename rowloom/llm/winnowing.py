"""Benchmark decontamination by winnowing.

The text of a benchmark item and of a document is a sequence of words. Of every
``WINDOW - GRAM + 1`` consecutive k-grams (``GRAM`` words each) the one with the
least hash is kept, the rightmost of equals. Two texts that share ``WINDOW``
consecutive words keep the same k-gram of that span, so a document is only looked
at where one of its fingerprints is a fingerprint of the benchmark; there the hit
is extended to each window of ``WINDOW`` words around it, which counts if it is a
window of an item. Items of fewer words have no full winnowing window; their whole
sequence is looked up at each position of a document.

Documents are read once, narrowly: no shuffle while the benchmark fits one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bound_batches
from .textbytes import ALNUM_WORD, Run, Words, ascii_fold, find_words, grams, member, runs

WINDOW = 10
GRAM = 5
#: Benchmark bytes handed to the tasks at once; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
PARTIAL = "doc_id long, text_hash long, n_chars long, n_words long, first array<long>, last array<long>, items array<string>"


@dataclass
class Lookup:
    """Sorted gram hashes, and the items of each."""

    hashes: np.ndarray
    at: np.ndarray
    items: np.ndarray

    @staticmethod
    def build(hashes: np.ndarray, items: np.ndarray) -> Lookup:
        pairs = np.unique(np.stack([hashes, items.astype(np.uint64)], 1), axis=0) if len(hashes) else np.zeros((0, 2), np.uint64)
        distinct, at = np.unique(pairs[:, 0], return_index=True)
        return Lookup(distinct, np.append(at, len(pairs)), pairs[:, 1].astype(np.int64))


@dataclass
class Benchmark:
    """One block of the benchmark, ready for look-ups."""

    ids: list[str]
    fingerprints: np.ndarray
    windows: Lookup
    short: dict[int, Lookup] = field(default_factory=dict)


def kept_grams(hashes: np.ndarray, text: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """All k-gram hashes, and the positions that winnowing keeps; no window crosses texts."""
    g = grams(hashes, gram)
    span = window - gram + 1
    count = len(hashes) - window + 1
    if count <= 0:
        return g, np.zeros(0, np.int64)
    least, at = g[:count].copy(), np.arange(count)
    for i in range(1, span):
        other = g[i : i + count]
        lower = other <= least
        least = np.where(lower, other, least)
        at = np.where(lower, np.arange(i, i + count), at)
    return g, np.unique(at[text[:count] == text[window - 1 :]])


def prepare(rows: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM) -> Benchmark:
    """``rows``: (item id, text)."""
    ids = sorted({i for i, _ in rows})
    number = {x: i for i, x in enumerate(ids)}
    fingerprints, long_hashes, long_items = [], [], []
    short: dict[int, tuple[list, list]] = {}
    for item, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        words = find_words(Run(0, 1, raw, np.array([0, len(raw)])), ALNUM_WORD, ascii_fold())
        n = len(words.hash)
        if n >= window:
            g, kept = kept_grams(words.hash, words.text, window, gram)
            fingerprints.append(g[kept])
            full = grams(words.hash, window)
            long_hashes.append(full)
            long_items.append(np.full(len(full), number[item]))
        elif n:
            hashes, items = short.setdefault(n, ([], []))
            hashes.append(grams(words.hash, n))
            items.append(np.array([number[item]]))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Benchmark(
        ids, np.unique(join(fingerprints, np.uint64)), Lookup.build(join(long_hashes, np.uint64), join(long_items, np.int64)),
        {n: Lookup.build(np.concatenate(h), np.concatenate(i)) for n, (h, i) in sorted(short.items())},
    )


def find_hits(words: Words, bench: Benchmark, window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window length: the length, hit positions (word numbers), and for them the index and the look-up."""
    g, kept = kept_grams(words.hash, words.text, window, gram)
    near = kept[member(bench.fingerprints, g[kept])[0]]
    if len(near):
        reach = window - gram
        starts = np.unique((near[:, None] - np.arange(reach + 1)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + window <= len(words.text))]
        starts = starts[words.text[starts] == words.text[starts + window - 1]]
        if len(starts):
            rows = words.hash[starts[:, None] + np.arange(window)[None, :]]
            found, at = member(bench.windows.hashes, _rows_hash(rows))
            yield window, starts[found], at[found], bench.windows
    for n, lookup in bench.short.items():
        if len(words.hash) >= n:
            found, at = member(lookup.hashes, grams(words.hash, n))
            found &= words.text[: len(found)] == words.text[n - 1 :]
            starts = np.flatnonzero(found)
            yield n, starts, at[starts], lookup


def _rows_hash(rows: np.ndarray) -> np.ndarray:
    """``grams`` of each row."""
    from .textbytes import mix

    out = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + rows[:, i]
    return mix(out)


def _scan(run: Run, bench: Benchmark, window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """For each text of a run: number of words, first and last word of each run of hit words, ids of items."""
    words = find_words(run, ALNUM_WORD, ascii_fold())
    texts = run.last - run.first
    begins = np.searchsorted(words.text, np.arange(texts + 1))
    cover = np.zeros(len(words.text) + 1, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n, starts, at, lookup in find_hits(words, bench, window, gram):
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + n, -1)
        pairs = np.unique(np.stack([words.text[starts], at], 1), axis=0)
        sizes = lookup.at[pairs[:, 1] + 1] - lookup.at[pairs[:, 1]]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found.append((np.repeat(pairs[:, 0], sizes), lookup.items[np.repeat(lookup.at[pairs[:, 1]], sizes) + inner]))
    hit = np.cumsum(cover[:-1]) > 0
    pairs = np.unique(np.concatenate([np.stack(p, 1) for p in found]), axis=0) if found else np.zeros((0, 2), np.int64)
    item_at = np.searchsorted(pairs[:, 0], np.arange(texts + 1))
    for t in range(texts):
        a, b = begins[t], begins[t + 1]
        edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))) if item_at[t] < item_at[t + 1] else np.zeros(0, np.int8)
        yield int(b - a), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, [bench.ids[i] for i in pairs[item_at[t] : item_at[t + 1], 1]]


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def benchmark_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size, one on the driver at a time; an item of null id has the id ''."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not
    read. One row per row of ``docs``, null or repeated ids included. Null and empty
    texts have no words and are clean. Repeated items count once for an id.
    """
    bound_batches(docs.sparkSession)
    if not 0 < gram <= window:
        raise ValueError("gram must lie in 1..window")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = benchmark_blocks(items, "item_id", "text", block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return read.mapInArrow(_whole(prepare(first, window, gram), window, gram), SCHEMA)

    keyed = read.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").cast("long").alias("n_chars"), "text")
    parts = None
    for rows in _rest(first, second, blocks):
        part = keyed.mapInArrow(_part(prepare(rows, window, gram), window, gram), PARTIAL).withColumn("pass", F.lit(0 if parts is None else 1))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("doc_id", "text_hash", "n_chars").applyInArrow(_merge, SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no window with ``items``."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(bench: Benchmark):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for run in runs(batch.column(at)):
                    mask = [len(first) == 0 for _, first, _, _ in _scan(run, bench, window, gram)]
                    yield batch.slice(run.first, run.last - run.first).filter(pa.array(mask, pa.bool_()))

        return work

    schema = docs.schema
    for rows in benchmark_blocks(items, "item_id", "text", block_bytes):
        docs = docs.mapInArrow(clean(prepare(rows, window, gram)), schema)
    return docs


def _rest(first: list, second: list, blocks: Iterator[list]) -> Iterator[list]:
    yield first
    yield second
    yield from blocks


def _whole(bench: Benchmark, window: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(1)):
                out = [(n, int((last - first + 1).sum()), len(items), digest(items), len(first) > 0) for n, first, last, items in _scan(run, bench, window, gram)]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.last - run.first), *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return work


def _part(bench: Benchmark, window: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(3)):
                out = [(n, first.tolist(), last.tolist(), items) for n, first, last, items in _scan(run, bench, window, gram)]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                part = batch.slice(run.first, run.last - run.first)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["doc_id", "text_hash", "n_chars", "n_words", "first", "last", "items"])

    return work


def _merge(table: pa.Table) -> pa.Table:
    """One document's rows of all passes; equal rows of ``docs`` come back as often as they were."""
    rows = table.to_pylist()
    times = sum(r["pass"] == 0 for r in rows)
    hit = {w for r in rows for a, b in zip(r["first"], r["last"], strict=True) for w in range(a, b + 1)}
    items = sorted({i for r in rows for i in r["items"]})
    one = {"doc_id": rows[0]["doc_id"], "n_words": rows[0]["n_words"], "n_hit": len(hit), "n_items": len(items), "items_sha256": digest(items), "contaminated": bool(hit)}
    return pa.Table.from_pylist([one] * times, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]))
