"""Append-only logs: batches, replay, rolling, snapshots, and Structured Streaming ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import primitives as P
from ..operators.layout import with_row_index
from ..schema import Schema
from ..sources.jsonl import parse_lines


def next_row(log: DataFrame, index: str = "row_index") -> int:
    return log.agg(F.coalesce(F.max(index) + 1, F.lit(0)).alias("n")).first().n


def append_batch(log: DataFrame, batch: DataFrame, *order: str) -> DataFrame:
    """The log followed by a batch, whose rows get the numbers after the log's."""
    offset = next_row(log)
    numbered = with_row_index(batch, *order)
    return log.unionByName(numbered.withColumn("row_index", F.col("row_index") + offset))


def append_to(spark: SparkSession, path: str, batch: DataFrame, *order: str) -> int:
    """Appends a batch to a Parquet log and returns its first row number."""
    from pyspark.errors import AnalysisException

    try:
        offset = next_row(spark.read.parquet(path))
    except AnalysisException:
        offset = 0
    with_row_index(batch, *order).withColumn("row_index", F.col("row_index") + offset).write.mode("append").parquet(path)
    return offset


def replay(log: DataFrame, blocks: DataFrame | None = None, block: str = "block_index") -> DataFrame:
    """Rows in order; with a table of valid blocks, those of the valid prefix."""
    if blocks is not None:
        log = log.join(blocks.select(block), block, "left_semi")
    return log.orderBy("row_index")


def blocks_in_order(log: DataFrame, block: str = "block_index", first: int = 0) -> Iterator[tuple[int, list[Row]]]:
    """(block, its rows in order), block by block from ``first`` on.

    Blocks are range-partitioned, so that each is whole in one partition. While a caller
    handles one partition the next is computed, and no more than these two are on the driver.
    """
    rows = log.where(F.col(block) >= first).repartitionByRange(block).sortWithinPartitions(block, "row_index")
    for key, group in groupby(rows.toLocalIterator(prefetchPartitions=True), lambda r: r[block]):
        yield key, list(group)


def deliver(log: DataFrame, handle: Callable[[int, list[Row]], None], block: str = "block_index", first: int = 0) -> int:
    """Decodes blocks on the executors, calls ``handle`` in their order, and returns the number of the block to go on with.

    A handler that fails ends the delivery; a later call with ``first`` goes on from any block.
    """
    for key, rows in blocks_in_order(log, block, first):
        handle(key, rows)
        first = key + 1
    return first


def ingest(spark: SparkSession, source: str, schema: Schema, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follows a folder of JSON-lines files into a Parquet log; a restart goes on from the checkpoint."""
    parsed = parse_lines(spark.readStream.text(source), schema)
    writer = parsed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow(spark: SparkSession, path: str, schema: Schema, handle, checkpoint: str) -> StreamingQuery:
    """Calls ``handle(batch, batch_id)`` for what was appended to a log since the checkpoint."""
    return spark.readStream.schema(schema.struct()).parquet(path).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# snapshots

#: Layout of a snapshot: magic, id, raw length, checksum (little endian), then run-length coded state.
SNAPSHOT_MAGIC = b"RLS1"


def encode_snapshot(checkpoint_id: int, state: bytes) -> bytes:
    payload = P.rle_encode(state)
    return SNAPSHOT_MAGIC + checkpoint_id.to_bytes(8, "little") + len(state).to_bytes(8, "little") + P.checksum(payload).to_bytes(4, "little") + payload


def decode_snapshot(data: bytes) -> tuple[int, bytes]:
    if len(data) < 24 or data[:4] != SNAPSHOT_MAGIC:
        raise ValueError("not a snapshot")
    payload = data[24:]
    P.verify(payload, int.from_bytes(data[20:24], "little"))
    size = int.from_bytes(data[12:20], "little")
    state = P.rle_decode(payload, size)
    if len(state) != size:
        raise ValueError("snapshot length does not match")
    return int.from_bytes(data[4:12], "little"), state


def snapshots(states: DataFrame, checkpoint: str = "checkpoint_id", state: str = "state") -> DataFrame:
    """checkpoint_id, state, raw_len, crc of each state, with built-in functions."""
    return states.select(F.col(checkpoint).alias("checkpoint_id"), F.col(state).alias("state"), F.octet_length(state).cast("long").alias("raw_len"), F.crc32(state).alias("crc"))


def verify_snapshots(table: DataFrame) -> DataFrame:
    """Snapshots that don't match their length or checksum."""
    return table.where((F.octet_length("state") != F.col("raw_len")) | (F.crc32("state") != F.col("crc")))
