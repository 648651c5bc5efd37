"""Candidate pairs across groups, block against block.

The nodes of a bucket that lie outside its largest group are compared with all of its
nodes, in tiles of about ``TILE`` nodes (or ``TILE_BYTES``) on either side, one tile a step of a task. So a
large bucket is work for many tasks, and only what may be linked leaves a tile: of each
node its nearest partners, at first a few, and more round by round until none is held back.

Pairs are ruled out by an exact bound. A sketch has a bit per slot, set if an odd number
of the set's hashes fall there; the slots where two sketches differ are at most the
elements that one set has and the other lacks (Mitzenmacher et al., Odd Sketches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Scratch

TILE, TILE_BYTES = 512, 16 << 20
#: Partners that a node of a tile names in the first round, and the growth from round to round.
FIRST_PARTNERS, MORE_PARTNERS = 4, 8
SCHEMA = "a long, b long, more boolean"


def sketch_of(hashes: np.ndarray) -> bytes:
    """Four bits and more for each element, a power of two of them."""
    bits = max(64, 1 << int(4 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes) to (node, sketch)."""
    for batch in batches:
        rows = [sketch_of(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["node", "sketch"])


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch as it would be with fewer slots."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0) if len(sketch) > words else sketch


class Side:
    """The nodes of one side of a tile, with their sketches stacked by size."""

    def __init__(self, rows: list[tuple]):
        self.node, self.comp, self.size = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.second = np.array([r[3] for r in rows], np.int64)
        self.sketch = [np.frombuffer(r[4], np.uint64) for r in rows]
        self.words = np.array([len(x) for x in self.sketch])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of_size(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes whose sketch has so many words or twice as many, and the sketches, folded."""
        if words not in self.folded:
            at = np.flatnonzero((self.words == words) | (self.words == 2 * words))
            self.folded[words] = at, np.array([fold(self.sketch[i], words) for i in at], np.uint64).reshape(len(at), words)
        return self.folded[words]


def compare(a: Side, b: Side, similarity: int, most: int) -> Iterator[tuple[int, int, bool]]:
    """Pairs of different groups that share a key and that the bound doesn't rule out, at most ``most`` for each node of ``a``; if more were there."""
    for i in range(len(a.node)):
        ok = (a.comp[i] != b.comp) & (100 * np.minimum(a.size[i], b.size) >= similarity * np.maximum(a.size[i], b.size))
        ok[ok] = (b.second[ok] == a.second[i]).any(1)
        if not ok.any():
            continue
        far = np.full(len(ok), -1, np.int64)
        # Sizes are near, so sketches are equally long or one twice the other.
        for words in {int(a.words[i]), max(1, int(a.words[i]) // 2)}:
            at, stacked = b.of_size(words)
            use = ok[at] & (np.minimum(b.words[at], a.words[i]) == words)
            if use.any():
                far[at[use]] = np.bitwise_count(stacked[use] ^ fold(a.sketch[i], words)).sum(1)
        may = np.flatnonzero(ok & (far >= 0) & (far * (100 + similarity) <= (a.size[i] + b.size) * (100 - similarity)))
        order = may[np.argsort(far[may], kind="stable")]
        for j in order[:most]:
            x, y = int(a.node[i]), int(b.node[j])
            yield min(x, y), max(x, y), len(order) > most


def _tile_steps(similarity: int, most: int):
    """Rows sorted by (bucket, a_tile, b_tile, is_b): bucket, a_tile, b_tile, is_b, node, comp, size, second, sketch."""

    def flush(rows: tuple[list, list], out: list) -> None:
        if rows[0] and rows[1]:
            out.extend(compare(Side(rows[0]), Side(rows[1]), similarity, most))
        rows[0].clear()
        rows[1].clear()

    def batch_of(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "more"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, out = None, ([], []), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != place:
                    flush(rows, out)
                    place = row[:3]
                rows[row[3]].append(row[4:])
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        flush(rows, out)
        if out:
            yield batch_of(out)

    return work


def candidates(members: DataFrame, traits: DataFrame, labels: DataFrame, similarity: int, most: int, scratch: Scratch) -> DataFrame:
    """(a, b, more) of ``members`` (bucket, node, size): pairs that may be linked, once a tile.

    ``traits`` (node, sketch, second), ``labels`` (node, comp) of the groups so far.
    """
    now = scratch.keep(members.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("comp", "node").alias("comp")))
    weight = (F.col("size").cast("double") + 2048) / 2
    per = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes"))
    whole = per.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.max_by("bytes", F.struct("n", "comp")).alias("top_bytes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > top.n")
    tiles_of = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_BYTES)).cast("int")
    plan = scratch.keep(whole.select("bucket", F.col("top.comp").alias("top"), tiles_of(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top_bytes")).alias("a_tiles"), tiles_of(F.col("n"), F.col("bytes")).alias("b_tiles")))
    rows = now.join(plan, "bucket")
    number = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "node", "comp", "size"]
    a = rows.where("comp <> top").select(*columns, number(1, "a_tiles").alias("a_tile"), all_of("b_tiles").alias("b_tile"), F.lit(0).alias("is_b"))
    b = rows.select(*columns, all_of("a_tiles").alias("a_tile"), number(2, "b_tiles").alias("b_tile"), F.lit(1).alias("is_b"))
    placed = a.unionByName(b).join(traits, "node").select("bucket", "a_tile", "b_tile", "is_b", "node", "comp", "size", "second", "sketch")
    return placed.repartition("bucket", "a_tile", "b_tile").sortWithinPartitions("bucket", "a_tile", "b_tile", "is_b").mapInArrow(_tile_steps(similarity, most), SCHEMA)
