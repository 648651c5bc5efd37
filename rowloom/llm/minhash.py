"""MinHash near-duplicates with tensored banding.

A document is the set of its word shingles. Two collections of ``REPEATS`` small
hashes, each of ``ROWS`` minhashes, are made of it; a table key is a pair of one hash
of either collection. So REPEATS^2 keys of 2 * ROWS minhashes come from only
2 * REPEATS * ROWS of them. Documents of similarity s share a key with probability
(1 - (1 - s^ROWS)^REPEATS)^2. Pairs are confirmed on their full sets.

First come the keys of equal places in both collections, where each document meets the most
frequent of its buckets; that joins most groups. Documents of different groups that share
any other key then meet at a shared hash of the first collection (``tiles.py``), where keys
with each hash of the second are looked up and most pairs are ruled out by a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .linking import attach, distinct_buckets, merge, near, stars
from .session import Scratch, bound_batches, rows_of
from .textbytes import SPACED_WORD, Run, ascii_fold, find_words, grams, mix, runs

SHINGLE, SIMILARITY = 5, 80
REPEATS, ROWS = 28, 6
#: Up to so many numbers (8 bytes each) of documents or buckets are broadcast; beyond, they are joined.
SENT_NODES = 1_000_000

_SEEDS = mix(np.arange(1, 1 + 4 * REPEATS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIPS, _FACTORS = np.split((_SEEDS >> np.uint64(32)).astype(np.uint32), 2)
_FACTORS = (_FACTORS | np.uint32(1))[:, None]
_FLIPS = _FLIPS[:, None]


def shingle_sets(run: Run, shingle: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    words = find_words(run, SPACED_WORD, ascii_fold())
    g = grams(words.hash, shingle)
    begins = np.searchsorted(words.text, np.arange(run.last - run.first + 1))
    out = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(g[a : b - shingle + 1]))
        elif b > a:
            out.append(grams(words.hash[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit hash of a whole set: equal sets, equal keys."""
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def half_hashes(hashes: np.ndarray) -> np.ndarray:
    """2 * REPEATS small hashes of a set, each of ROWS minhashes of 32 bits."""
    least = np.full(2 * REPEATS * ROWS, np.uint32(0xFFFFFFFF))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 256):
        np.minimum(least, ((short[None, i : i + 256] ^ _FLIPS) * _FACTORS).min(1), out=least)
    return grams_of_rows(mix(least.astype(np.uint64)).reshape(2 * REPEATS, ROWS)).view(np.int64)


def grams_of_rows(rows: np.ndarray) -> np.ndarray:
    out = np.arange(len(rows), dtype=np.uint64)
    for i in range(rows.shape[1]):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, i]
    return mix(out)


def _signatures(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(1)):
                sets = shingle_sets(run, shingle)
                keys = [set_key(s) if len(s) else None for s in sets]
                halves = [half_hashes(s) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(run.first, run.last - run.first) for i in (0, 2)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(halves, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "node", "halves"],
                )

    return work


def _sets(shingle: int):
    """(node, hashes) of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(0)):
                found = [s for s in shingle_sets(run, shingle) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "hashes"])

    return work


def _confirm(similarity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                ok.append(100 * both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return work


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Groups of documents whose shingle sets have 100 * intersection >= similarity * union.

    Returns doc_id, n_shingles, component_id (least doc_id of the group), kept (doc_id is
    component_id), one row per row of ``docs``. Null, empty and blank texts have no
    shingles and are groups of their own. Rows with equal sets are one node: all
    repeats of the kept id are kept, and a null doc_id is never the least unless the group has
    no other; then component_id is null and the row is kept. Only doc_id and text are read.
    Sets are known by 64-bit hashes of their shingles, a whole set by a 64-bit hash.
    """
    return _judge(docs, shingle, similarity).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept; equal rows are one document."""
    judged = _judge(docs, shingle, similarity)
    gone = Scratch(docs.sparkSession, "dropped").keep(judged.where("NOT kept").select("doc_id", "text_hash").distinct())
    # The row is one column, so that no name of it can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.text_hash") == F.col("g.text_hash"))
    return rows.alias("r").join(_few(gone).alias("g"), same, "left_anti").select("row.*")


def _few(nodes: DataFrame) -> DataFrame:
    """Kept nodes, to be broadcast if they are at most ``SENT_NODES``."""
    return F.broadcast(nodes) if rows_of(nodes) <= SENT_NODES else nodes


def _shared(keyed: DataFrame, told_by: str, scratch: Scratch) -> DataFrame:
    """Rows of ``keyed`` whose bucket has different values of ``told_by``. Equal sets fold before the shuffle."""
    shared = scratch.keep(keyed.groupBy("bucket").agg(F.min(told_by).alias("low"), F.max(told_by).alias("high")).where("low <> high").select("bucket"))
    return keyed.join(_few(shared), "bucket", "left_semi")


def _fetch(read: DataFrame, named: DataFrame, nodes: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(node, hashes) of the nodes, each made of one of its texts, so that other texts don't reach Python."""
    nodes = scratch.keep(nodes)
    chosen = scratch.keep(named.select("node", "text_hash").join(_few(nodes), "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash")).select("text_hash"))
    texts = read.select("text", "text_hash").join(_few(chosen), "text_hash", "left_semi").select("text")
    return scratch.keep(texts.mapInArrow(_sets(shingle), "node long, hashes binary").dropDuplicates(["node"]))


def _judge(docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "minhash")
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = scratch.keep(read.mapInArrow(_signatures(shingle), "doc_id long, text_hash long, n_shingles long, node long, halves array<long>"))

    named = signed.where("node IS NOT NULL")
    second = F.slice("halves", REPEATS + 1, REPEATS)
    keyed = named.select("node", F.col("n_shingles").alias("size"), F.explode(F.zip_with(F.slice("halves", 1, REPEATS), second, lambda x, y: F.xxhash64(x, y))).alias("bucket"))
    members = scratch.keep(distinct_buckets(_shared(keyed, "node", scratch).groupBy("bucket", "node", "size").agg(F.count(F.lit(1)).alias("weight"))))
    labels = spark.createDataFrame([], "node long, comp long").coalesce(1)
    alike = f"100 * least(a_size, b_size) >= {similarity} * greatest(a_size, b_size)"
    pairs = scratch.keep(stars(members, alike))
    scratch.free(members)

    def confirmed(pairs: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        edges = scratch.keep(attach(pairs, sets, "hashes").mapInArrow(_confirm(similarity), "a long, b long"))
        return merge(labels, near(edges), scratch, python=True) if rows_of(edges) else labels

    if rows_of(pairs):
        sets = _fetch(read, named, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle, scratch)
        labels = confirmed(pairs, sets, labels)
        scratch.free(sets)
    # Now what shares any key across groups.
    of_group = named.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    halves = of_group.select("node", "comp", F.col("n_shingles").alias("size"), F.posexplode(F.slice("halves", 1, REPEATS)).alias("half", "hash")).select("node", "comp", "size", F.xxhash64("half", "hash").alias("bucket"))
    across = scratch.keep(_shared(halves, "comp", scratch).select("bucket", "node", "size").distinct())
    if rows_of(across):
        nodes = across.select("node").distinct()
        sets = _fetch(read, named, nodes, shingle, scratch)
        keys = named.select("node", second.alias("second")).join(_few(scratch.keep(nodes)), "node", "left_semi").dropDuplicates(["node"])
        traits = scratch.keep(sets.mapInArrow(tiles.sketches, "node long, sketch binary").join(keys, "node"))
        compared, most = pairs, tiles.FIRST_PARTNERS
        while True:
            found = scratch.keep(tiles.candidates(across, traits, labels, similarity, most, scratch))
            fresh = scratch.keep(found.select("a", "b").distinct().join(compared, ["a", "b"], "left_anti"))
            if rows_of(fresh):
                labels = confirmed(fresh, sets, labels)
                compared = near(scratch.keep(compared.unionByName(fresh)))
            if found.where("more").isEmpty():
                break
            most *= tiles.MORE_PARTNERS
        scratch.free(sets, traits, across)
    low = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    grouped = low.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = grouped.groupBy("comp").agg(F.min("low").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    # Only nodes in groups of two rows or more need an answer: the others are their own.
    answer = scratch.keep(grouped.join(least, "comp").select("node", "component_id"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "node").join(answer, "node", "left")
    component = F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
