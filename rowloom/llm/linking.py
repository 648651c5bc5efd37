"""Connected groups of nodes that share buckets, without all pairs of a bucket.

Nodes are 64-bit numbers. Two nodes may be linked only if they share a bucket; a
caller's ``verify`` tells which pairs are. Where two nodes of a bucket are already in
one group, their pair cannot change a group and is not looked at. So per round a few
nodes of each bucket, one of each of its smallest groups, are compared with the
bucket's nodes of other groups; a bucket is done when the nodes that were not yet
compared with all others are in one group. In the end each pair of a bucket is in one
group or was verified, directly, not to be linked: the groups are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import Scratch, mark_of, rows_of

#: Nodes of a bucket that are compared with the others: this to the power of the round.
REPS_GROWTH = 4
#: Edges that one task may join.
TASK_EDGES = 500_000
#: Kept tables of so many rows (of a few numbers each) are worked on in one task, without a shuffle, and are broadcast.
SMALL_ROWS = 50_000


def near(table: DataFrame) -> DataFrame:
    """A kept table, in one partition if it is small: then groups and joins of such tables need no exchange."""
    return table.coalesce(1) if rows_of(table) <= SMALL_ROWS else table


def attach(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(a, b, a_<value>, b_<value>): the table's value of both nodes of kept pairs. Few pairs are broadcast, so that only their values are shuffled."""
    few = F.broadcast(pairs) if rows_of(pairs) <= SMALL_ROWS else pairs
    side = lambda name: table.join(few, F.col("node") == F.col(name)).select("a", "b", F.col(value).alias(f"{name}_{value}"))
    return side("a").join(side("b"), ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, python: bool = False) -> DataFrame:
    """(node, comp): the least node reachable, for each node of ``edges`` (a, b).

    Large-star and small-star steps until nothing changes. With ``python``, at most
    ``TASK_EDGES`` edges are instead joined by union-find in one task, in one job.
    """
    now = near(kept := scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    if python and rows_of(kept) <= TASK_EDGES:
        return now.coalesce(1).mapInArrow(_union_find, "node long, comp long")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.where("u <> v").distinct())
        same = mark_of(new) == mark_of(kept)
        scratch.free(kept)
        kept, now = new, near(new)
        if same:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "comp"])


def distinct_buckets(members: DataFrame, counted: bool = False) -> DataFrame:
    """``members`` (bucket, node, ...) of buckets with two nodes or more; of buckets with the same nodes one stays. ``counted``: with the bucket's nodes, ``n``."""
    buckets = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "node"), 20)).alias("s"),
    ).where("low <> high")
    kept = buckets.groupBy("n", "low", "high", "x", "s").agg(F.min("bucket").alias("bucket"))
    return members.join(kept.select("bucket", "n"), "bucket") if counted else members.join(kept.select("bucket"), "bucket", "left_semi")


def all_pairs(members: DataFrame, alike: str) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that share a bucket, once for each; for buckets of a few nodes."""
    side = lambda name: members.select("bucket", F.col("node").alias(name), F.col("size").alias(f"{name}_size"))
    return side("a").join(side("b"), "bucket").where(f"a < b AND {alike}").select("a", "b")


def stars(members: DataFrame, alike: str) -> DataFrame:
    """Pairs (a, b), a < b, one a node at most: the node, and of the heaviest nodes of its buckets the heaviest.

    The most frequent of near copies is mostly the one that the others were made from, so
    these pairs alone join most groups.
    """
    heavy = members.groupBy("bucket").agg(F.max(F.struct("weight", "node", "size")).alias("rep"))
    both = members.join(heavy, "bucket").withColumns({"a_size": F.col("size"), "b_size": F.col("rep.size")}).where(f"node <> rep.node AND {alike}")
    best = both.groupBy("node").agg(F.max("rep").alias("rep"))
    return best.select(F.least("node", "rep.node").alias("a"), F.greatest("node", "rep.node").alias("b")).distinct()


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, alike: str = "true", python: bool = False, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, comp) of the nodes in groups of two or more, and the pairs (a, b) that were verified.

    ``members`` (bucket, node, weight, size): distinct (bucket, node), of ``distinct_buckets``,
    kept. ``verify`` takes kept pairs (a, b), a < b, and returns those that are linked; only
    pairs for whose sizes ``alike`` (of a_size and b_size, symmetric) holds are handed to it. ``python`` as in ``components``.
    ``labels``: (node, comp) of groups that are known before.
    """
    spark = scratch.spark
    members = near(members)
    labels = spark.createDataFrame([], "node long, comp long").coalesce(1) if labels is None else near(labels)
    compared, round_no = spark.createDataFrame([], "a long, b long").coalesce(1), 0
    read: list[DataFrame] = []  # kept tables that ``members`` is made of
    known: list[DataFrame] = []
    while True:
        if round_no == 0:
            pairs = stars(members, alike)
        else:
            of_node = labels.select(F.col("node").alias("n"), "comp")
            every = scratch.keep(members.join(of_node, F.col("node") == F.col("n"), "left").select("bucket", "node", "size", F.coalesce("comp", "node").alias("comp")))
            scratch.free(*read)
            # Buckets of one group are done: only the rest is read again.
            several = near(every).groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
            rest = scratch.keep(near(every).join(several, "bucket", "left_semi"))
            scratch.free(every)
            now, read = near(rest), [rest]
            per = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("first"))
            order = W.partitionBy("bucket").orderBy("n", "comp")
            ranked = per.withColumn("rank", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order)).withColumn("groups", F.count(F.lit(1)).over(W.partitionBy("bucket"))).where("groups > 1")
            most = REPS_GROWTH**round_no
            # Whole small groups, but never the largest; of the groups beyond, one node each.
            whole = (F.col("rank") < F.col("groups")) & (F.col("upto") <= most)
            rep = lambda node, size: ["bucket", F.col(node).alias("rep"), F.col(size).alias("b_size"), F.col("comp").alias("rep_comp")]
            one = ranked.where(~whole & (F.col("rank") <= most)).select(*rep("first.node", "first.size"))
            all_of = now.join(ranked.where(whole).select("bucket", "comp"), ["bucket", "comp"]).select(*rep("node", "size"))
            kept_reps = scratch.keep(one.unionByName(all_of))
            read.append(kept_reps)
            if not rows_of(kept_reps):
                scratch.free(*read)
                break
            reps = near(kept_reps)
            met = now.withColumnRenamed("size", "a_size").join(reps, "bucket").where(f"comp <> rep_comp AND {alike}")
            pairs = met.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct().join(compared, ["a", "b"], "left_anti")
            # What was compared with all others leaves its bucket; buckets of one group close.
            active = now.join(reps.select("bucket").distinct(), "bucket", "left_semi")
            members = active.join(reps.select("bucket", F.col("rep").alias("node")), ["bucket", "node"], "left_anti").select("bucket", "node", "size")
        pairs = scratch.keep(pairs)
        edges = scratch.keep(verify(pairs)) if rows_of(pairs) else pairs
        both = scratch.keep(compared.unionByName(pairs))
        scratch.free(*known)
        compared, known = near(both), [both]
        if rows_of(edges):
            labels = merge(labels, near(edges), scratch, python)
        scratch.free(pairs, edges)
        round_no += 1
    return labels, compared


def merge(labels: DataFrame, edges: DataFrame, scratch: Scratch, python: bool = False) -> DataFrame:
    """Groups (node, comp) after more edges (a, b)."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    merged = near(scratch.keep(components(between, scratch, python)))
    old = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = merged.join(labels.select("node"), "node", "left_anti")
    return near(scratch.keep(old.unionByName(fresh)))
