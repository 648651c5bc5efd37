"""Storage checks and repair over tables of blocks or row groups, and of raw files.

A stored table is a Parquet folder with its footer beside the rows, in ``_footer``, which
Parquet readers skip: a row per block with its first row, rows, bytes and the CRC-32 of
its rows as canonical lines, in order. A check recomputes these from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.jsonl import render
from .layout import check_continuity

#: File magics and the formats they begin: fixed values.
MAGIC = {b"CMP1": 1, b"CMP2": 2, b"CMP3": 3, b"CMP4": 4}


def format_version(content: Column) -> Column:
    """1 to 4 by the first four bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("int")
    for magic, version in MAGIC.items():
        out = F.when(head == magic.hex().upper(), F.lit(version)).otherwise(out)
    return out


def detect_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, format_version of each file of a folder. Only the heads decide, but Spark's reader loads each file (2 GB at most) into its task."""
    return spark.read.format("binaryFile").load(path).select("path", "length", format_version(F.col("content")).alias("format_version"))


def detect(data: bytes) -> int:
    version = MAGIC.get(data[:4])
    if version is None:
        raise ValueError("unknown storage format")
    return version


def negotiate(version: int, least: int = 1, most: int = 4) -> int:
    if not least <= version <= most:
        raise ValueError("storage format is outside the accepted versions")
    return version


def mark_valid(blocks: DataFrame, payload: str = "payload", crc: str = "crc") -> DataFrame:
    """Adds ``valid``: the payload has its checksum."""
    return blocks.withColumn("valid", F.coalesce(F.crc32(payload) == F.col(crc), F.lit(False)))


def recover_prefix(blocks: DataFrame, index: str = "block_index", valid: str = "valid") -> DataFrame:
    """Blocks before the first bad or missing one; what follows is not resumed.

    The first bad block is one aggregate, so no window gathers the table.
    """
    bad = blocks.agg(F.min(F.when(~F.col(valid), F.col(index))).alias("bad"))
    following = blocks.select((F.col(index) + 1).alias(index)).join(blocks.select(index), index, "left_anti")
    start = blocks.agg(F.when(F.min(index) != 0, F.lit(0)).cast("long").alias("bad"))
    gap = following.agg(F.min(index).alias("bad"))
    limit = bad.unionByName(gap).unionByName(start).agg(F.min("bad").alias("_limit"))
    return blocks.crossJoin(F.broadcast(limit)).where(F.col("_limit").isNull() | (F.col(index) < F.col("_limit"))).drop("_limit")


def recovery(blocks: DataFrame, rows: str = "row_count", size: str = "raw_size", index: str = "block_index", valid: str = "valid") -> DataFrame:
    """One row: valid blocks, rows and bytes, and whether a corrupt tail follows."""
    kept = recover_prefix(blocks, index, valid)
    total = blocks.agg(F.count(F.lit(1)).alias("_all"))
    out = kept.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    return out.crossJoin(F.broadcast(total)).select("blocks", "rows", "bytes", (F.col("_all") > F.col("blocks")).alias("corrupt_tail"))


def repair_plan(blocks: DataFrame, has_footer: bool, rows: str = "row_count", size: str = "raw_size", index: str = "block_index", valid: str = "valid", crc: str | None = None) -> DataFrame:
    """The recovery's row with ``action`` and the digest of the source: None, RebuildFooter or TruncateTailAndRebuildFooter.

    The digest depends on each block's number, counts and, where ``crc`` names it, the checksum of its content.
    """
    source = blocks.agg(_digest(index, rows, size, valid, *([crc] if crc else [])).alias("source_digest"))
    action = F.when(F.col("corrupt_tail"), F.lit("TruncateTailAndRebuildFooter")).otherwise(F.lit("None" if has_footer else "RebuildFooter"))
    return recovery(blocks, rows, size, index, valid).withColumn("action", action).crossJoin(F.broadcast(source))


def _digest(*columns: str) -> Column:
    """Of a table of distinct rows, in any order. A sum, so that repeated rows don't cancel."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")


def seal(df: DataFrame, group: str = "row_group", index: str = "row_index") -> DataFrame:
    """The footer that the rows should have: block_index, first_row, row_count, raw_size, crc.

    The lines of a block, which its writer bounds by rows, are gathered in order for its checksum.
    """
    columns = [c for c in df.columns if c not in (group, index)]
    lines = df.select(F.col(group).alias("block_index"), F.col(index).alias("i"), render(columns).alias("line"))
    blocks = lines.groupBy("block_index").agg(F.min("i").alias("first_row"), F.count(F.lit(1)).alias("row_count"), F.sum(F.octet_length("line")).cast("long").alias("raw_size"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("all"))
    return blocks.select("block_index", "first_row", "row_count", "raw_size", F.crc32(F.array_join(F.transform("all", lambda x: F.concat(x["i"].cast("string"), F.lit(":"), x["line"])), "\n").cast("binary")).alias("crc"))


def store(df: DataFrame, path: str, group: str = "row_group", index: str = "row_index") -> None:
    """Writes rows and footer to a new folder; the footer is that of the rows as written."""
    df.write.mode("errorifexists").parquet(path)
    seal(df.sparkSession.read.schema(df.schema).parquet(path), group, index).write.parquet(f"{path}/_footer")


def stored_blocks(spark: SparkSession, path: str, group: str = "row_group", index: str = "row_index") -> tuple[DataFrame, bool]:
    """Blocks of a stored table, and if it has a footer.

    ``valid`` tells if the rows have the counts and the checksum that the footer states;
    without a footer there is nothing to hold them against, and blocks are as they are. Blocks
    that the footer has and the rows lack are bad blocks without rows.
    """
    from pyspark.errors import AnalysisException

    found = seal(spark.read.parquet(path), group, index)
    try:
        stated = spark.read.parquet(f"{path}/_footer")
    except AnalysisException:
        return found.withColumn("valid", F.lit(True)), False
    names = ["first_row", "row_count", "raw_size", "crc"]
    both = found.alias("f").join(stated.alias("s"), "block_index", "full")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in names]
    of = lambda c, kind: F.coalesce(F.col(f"f.{c}"), F.col(f"s.{c}") if c == "first_row" else F.lit(0).cast(kind)).alias(c)
    return both.select("block_index", *(of(c, "long") for c in names), (same[0] & same[1] & same[2] & same[3]).alias("valid")), True


def repair_stored(spark: SparkSession, path: str, plan: DataFrame, out: str, group: str = "row_group", index: str = "row_index") -> None:
    """Writes the rows of the valid prefix, with a new footer, to a new folder; refuses a source whose content is not the plan's."""
    blocks, has_footer = stored_blocks(spark, path, group, index)
    if repair_plan(blocks, has_footer, crc="crc").first().source_digest != plan.first().source_digest:
        raise ValueError("the source has changed since the plan was made")
    good = recover_prefix(blocks).select(F.col("block_index").alias(group))
    store(spark.read.parquet(path).join(good, group, "left_semi"), out, group, index)


def repair(blocks: DataFrame, plan: DataFrame, path: str, rows: str = "row_count", size: str = "raw_size", index: str = "block_index", valid: str = "valid", crc: str | None = None) -> None:
    """Writes the valid prefix of a table of blocks to a new path; refuses a source that is not the plan's, and an existing path."""
    now = blocks.agg(_digest(index, rows, size, valid, *([crc] if crc else [])).alias("source_digest")).first().source_digest
    if plan.first().source_digest != now:
        raise ValueError("the source has changed since the plan was made")
    recover_prefix(blocks, index, valid).write.mode("errorifexists").parquet(path)


def validate(blocks: DataFrame, rows: str = "row_count", first: str = "first_row", index: str = "block_index", valid: str = "valid") -> DataFrame:
    """One row: blocks, rows, bad checksums, breaks in continuity, empty blocks, and whether all is well."""
    breaks = check_continuity(blocks, index, first, rows).agg(F.count(F.lit(1)).alias("breaks"))
    out = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), F.count_if(~F.col(valid)).alias("bad_checksums"), F.count_if(F.col(rows) <= 0).alias("empty_blocks"))
    return out.crossJoin(F.broadcast(breaks)).select("*", ((F.col("bad_checksums") == 0) & (F.col("empty_blocks") == 0) & (F.col("breaks") == 0)).alias("sound"))


def check_footer(groups: DataFrame, group: str = "row_group", total_rows: int | None = None) -> DataFrame:
    """Footer rows out of place: repeated groups, gaps in rows or numbers, empty groups, or one row (group null) for a wrong total."""
    w = W.orderBy(group)
    ends = F.coalesce(F.lag(F.col("first_row") + F.col("row_count")).over(w), F.lit(0))
    number = F.coalesce(F.lag(group).over(w) + 1, F.lit(0))
    bad = groups.withColumn("_e", ends).withColumn("_n", number).where((F.col("first_row") != F.col("_e")) | (F.col(group) != F.col("_n")) | (F.col("row_count") <= 0)).select(group)
    if total_rows is None:
        return bad
    return bad.unionByName(groups.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("t")).where(F.col("t") != total_rows).select(F.lit(None).cast("long").alias(group)))
