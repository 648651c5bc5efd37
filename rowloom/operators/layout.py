"""Row order, row groups, blocks and segments.

Order is part of a log. Each table carries ``row_index``, contiguous from 0; groups and
blocks are computed from it, so files may be laid out as Spark likes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_GROUP_ROWS = 1024
BLOCK_ROWS, BLOCK_BYTES = 10_000, 8 << 20
SEGMENT_BLOCKS, SEGMENT_BYTES = 1024, 64 << 20
#: Bytes of rows, as they are in memory, that one task sorts.
TASK_BYTES = 32 << 20


def sort_tasks(df: DataFrame) -> int:
    """Tasks that the rows need if each is to sort about ``TASK_BYTES``.

    Left to itself, Spark joins small partitions by their compressed size, so that rows that
    compress well meet in one task by the gigabyte.
    """
    width = {"string": F.octet_length, "binary": F.octet_length}
    flat = lambda c, kind: width[kind](c) if kind in width else F.octet_length(F.to_json(F.struct(c))) if "<" in kind else F.lit(0)
    row = sum((F.coalesce(flat(F.col(f"`{c}`"), kind), F.lit(0)) for c, kind in df.dtypes), F.lit(16 + 8 * len(df.columns)))
    used = df.agg(F.sum(row.cast("long")).alias("used")).first()["used"] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-used // TASK_BYTES))


def held(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, however often they are read.

    A plan with a shuffle may be cut into other partitions each time it runs: range bounds
    come from a new sample, and small partitions are joined by size. So its output is
    written once, to the shared folder in ``spark.checkpoint.dir``; a session that names
    none keeps it on the executors' disks, where a lost part is made again of the same shuffle.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def with_row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """Adds the contiguous index, by ``order`` if given, else in input order.

    Ordered input is range-partitioned, into as many partitions as its bytes need, and sorted; then each partition's row count
    gives its offset, counts and rows coming from one output (``held``). Plain scans are read twice
    instead: their partitions depend on the files alone. No stage has all rows in one
    task; what reaches the driver is a count per partition.
    """
    if order:
        df = df.repartitionByRange(sort_tasks(df), *order).sortWithinPartitions(*order)
    if order or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = held(df)
    numbered = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets += [total] * (part + 1 - len(offsets))
        total += n
    start = F.get(F.array(*map(F.lit, offsets)), F.col("_part")) if offsets else F.lit(0)
    return numbered.withColumn(name, (F.col("_at") + start).cast("long")).drop("_part", "_at")


def with_group(df: DataFrame, rows: int = ROW_GROUP_ROWS, name: str = "row_group", index: str = "row_index") -> DataFrame:
    if rows <= 0:
        raise ValueError("a row group must have at least one row")
    return df.withColumn(name, F.floor(F.col(index) / rows).cast("long"))


def cut_blocks(df: DataFrame, size: str = "n_bytes", max_rows: int = BLOCK_ROWS, max_bytes: int = BLOCK_BYTES, stream: str | None = None, index: str = "row_index") -> DataFrame:
    """Adds block_index by row and byte limits, greedily in order.

    A block ends before a row that would exceed a limit. Each boundary depends on the
    one before, so a stream is one ordered fold: the rows of a stream (all rows, where
    none is named) go through one task, batch by batch, and only index and size do.
    A row over the byte limit is an error.
    """
    if max_rows <= 0 or max_bytes <= 0:
        raise ValueError("a block must be allowed a row and a byte at least")
    keys = [stream] if stream else []
    small = df.select(*keys, index, F.col(size).cast("long").alias("_size"))
    ordered = (small.repartition(stream) if stream else small.repartition(1)).sortWithinPartitions(*keys, index)
    kinds = dict(small.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block, rows, used = None, 0, 0, 0
        for batch in batches:
            out = []
            for i, n in enumerate(batch["_size"]):
                if stream and (batch[stream].iat[i] != now):
                    now, block, rows, used = batch[stream].iat[i], 0, 0, 0
                if n > max_bytes:
                    raise ValueError("a row has more bytes than a block may have")
                if rows and (rows + 1 > max_rows or used + n > max_bytes):
                    block, rows, used = block + 1, 0, 0
                rows, used = rows + 1, used + n
                out.append(block)
            yield batch.drop(columns="_size").assign(block_index=out)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, index]) + ", block_index long"
    return df.join(ordered.mapInPandas(fold, schema), [*keys, index])


def roll_segments(blocks: DataFrame, max_blocks: int = SEGMENT_BLOCKS, max_bytes: int = SEGMENT_BYTES, size: str = "n_bytes", index: str = "block_index") -> DataFrame:
    """Adds segment_id and block_in_segment to a table of blocks (one row each).

    A segment ends once it has ``max_blocks`` blocks or ``max_bytes`` bytes. By blocks
    alone it is a division; by bytes it is a fold over the small table of blocks.
    """
    if max_blocks <= 0 or max_bytes <= 0:
        raise ValueError("a segment must be allowed a block and a byte at least")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, count, used = 0, 0, 0
        for batch in batches:
            segments, places = [], []
            for n in batch["_size"]:
                if count >= max_blocks or used >= max_bytes:
                    segment, count, used = segment + 1, 0, 0
                segments.append(segment)
                places.append(count)
                count, used = count + 1, used + n
            yield batch.drop(columns="_size").assign(segment_id=segments, block_in_segment=places)

    small = blocks.select(index, F.col(size).cast("long").alias("_size")).repartition(1).sortWithinPartitions(index)
    return blocks.join(small.mapInPandas(fold, f"`{index}` {dict(small.dtypes)[index]}, segment_id long, block_in_segment long"), index)


def check_continuity(blocks: DataFrame, index: str = "block_index", first: str = "first_row", rows: str = "row_count") -> DataFrame:
    """Blocks that do not continue their predecessor; none in a sound stream."""
    w = W.orderBy(index)
    expected_index = F.coalesce(F.lag(index).over(w) + 1, F.lit(0))
    expected_row = F.coalesce(F.lag(F.col(first) + F.col(rows)).over(w), F.lit(0))
    return blocks.withColumn("_i", expected_index).withColumn("_r", expected_row).where((F.col(index) != F.col("_i")) | (F.col(first) != F.col("_r"))).drop("_i", "_r")
