"""Row-group statistics: the footer of a table as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _raw_size(name: str, kind: str) -> Column:
    """Bytes of the values themselves: 8 per number, 1 per boolean, UTF-8 bytes of strings; nulls have none."""
    if kind == "string":
        return F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
    return F.count(name) * (1 if kind == "boolean" else 8)


def column_stats(df: DataFrame, columns: list[str] | None = None, group: str = "row_group") -> DataFrame:
    """One row per group and column: counts, and the statistic of its type.

    value_count counts rows, nulls too. Numbers have min_value and max_value (absent
    without values), booleans true_count, strings an exact distinct_count. One pass and
    one shuffle of partial aggregates for all columns but the distinct counts, which
    Spark expands.
    """
    kinds = dict(df.dtypes)
    names = [c for c in (columns or df.columns) if c not in (group, "row_index")]
    out: list[Column] = []
    for n in names:
        kind = kinds[n]
        number = kind not in ("string", "boolean")
        null = lambda t: F.lit(None).cast(t)
        out.append(
            F.struct(
                F.lit(n).alias("column"), F.count(F.lit(1)).alias("value_count"), F.count_if(F.col(n).isNull()).alias("null_count"),
                (F.min(n).cast("long") if number else null("long")).alias("min_value"), (F.max(n).cast("long") if number else null("long")).alias("max_value"),
                (F.count_if(F.col(n)) if kind == "boolean" else null("long")).alias("true_count"), (F.count_distinct(n) if kind == "string" else null("long")).alias("distinct_count"),
                _raw_size(n, kind).cast("long").alias("raw_size"),
            ).alias(n)
        )
    wide = df.groupBy(group).agg(*out)
    return wide.select(group, F.explode(F.array(*(F.col(f"`{n}`") for n in names))).alias("s")).select(group, "s.*")


def footer(df: DataFrame, group: str = "row_group", index: str = "row_index") -> DataFrame:
    """One row per group: first_row and row_count."""
    return df.groupBy(group).agg(F.min(index).alias("first_row"), F.count(F.lit(1)).alias("row_count"))


def inspect_file(df: DataFrame, group: str = "row_group") -> DataFrame:
    """Totals of a table: rows, groups, columns and raw bytes."""
    stats = column_stats(df, group=group)
    columns = [c for c in df.columns if c not in (group, "row_index")]
    groups = stats.where(F.col("column") == columns[0]).agg(F.sum("value_count").alias("row_count"), F.count(F.lit(1)).alias("row_groups"))
    return groups.crossJoin(F.broadcast(stats.agg(F.sum("raw_size").alias("raw_size")))).select("row_count", "row_groups", F.lit(len(columns)).cast("long").alias("columns"), "raw_size")


def block_stats(df: DataFrame, size: str = "n_bytes", block: str = "block_index", index: str = "row_index") -> DataFrame:
    """Blocks of a stream: first row, rows, raw bytes."""
    return df.groupBy(block).agg(F.min(index).alias("first_row"), F.count(F.lit(1)).alias("row_count"), F.sum(size).cast("long").alias("raw_size"))


def totals(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("raw_bytes"))


def mismatches(stored: DataFrame, df: DataFrame, group: str = "row_group") -> DataFrame:
    """Statistics recomputed from the rows that differ from the stored ones, or exist on one side only."""
    fresh = column_stats(df, group=group)
    values = ["value_count", "null_count", "min_value", "max_value", "true_count", "distinct_count", "raw_size"]
    a, b = stored.alias("a"), fresh.alias("b")
    differs = reduce(lambda x, y: x | y, (~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values))
    both = a.join(b, [group, "column"], "full")
    return both.where(differs).select(group, "column")


def check_shape(stats: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Statistics whose form does not fit: counts out of order, or a statistic of another type."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("column"))
    bad = (F.col("null_count") > F.col("value_count")) | (F.col("min_value") > F.col("max_value"))
    bad |= (kind != "string") & F.col("distinct_count").isNotNull() | (kind != "boolean") & F.col("true_count").isNotNull()
    bad |= kind.isin("string", "boolean") & F.col("min_value").isNotNull() | (F.col("true_count") > F.col("value_count") - F.col("null_count"))
    return stats.where(F.coalesce(bad, F.lit(False)))


def compression_ratio(out_bytes: Column, in_bytes: Column) -> Column:
    """1 for no input."""
    return F.when(in_bytes == 0, F.lit(1.0)).otherwise(out_bytes / in_bytes)


def mib_per_second(n_bytes: Column, seconds: Column) -> Column:
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(n_bytes / (1 << 20) / seconds)
