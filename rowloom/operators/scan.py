"""Projection and predicate scans with pruning counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import column_stats

COMPARISONS = {"eq": lambda c, v: c == v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "decimal(20,0)")


@dataclass(frozen=True)
class Predicate:
    """``op``: eq, lt, le, gt, ge with an unsigned value, or is_null without one."""

    column: str
    op: str
    value: int | None = None

    def __post_init__(self):
        if self.op not in COMPARISONS and self.op != "is_null":
            raise ValueError(f"unknown predicate {self.op}")
        if (self.value is None) != (self.op == "is_null"):
            raise ValueError("is_null takes no value, comparisons need one")
        if self.value is not None and self.value < 0:
            raise ValueError("predicate value must be u64")

    def check(self, df: DataFrame) -> None:
        kinds = dict(df.dtypes)
        if self.column not in kinds:
            raise ValueError("the predicate names no column of the table")
        if self.op != "is_null" and kinds[self.column] not in NUMBERS:
            raise ValueError("comparisons need a column of unsigned numbers")

    def condition(self) -> Column:
        return F.col(self.column).isNull() if self.op == "is_null" else COMPARISONS[self.op](F.col(self.column), F.lit(self.value))


def parse_projection(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def parse_predicate(column: str | None, op: str | None, value: str | None) -> Predicate | None:
    """From command-line parts, all or none of column and op; names as in ``is-null``."""
    if column is None and op is None and value is None:
        return None
    if column is None or op is None:
        raise ValueError("filter needs column and operator")
    name = op.replace("-", "_")
    if value is not None and not value.isdigit():
        raise ValueError("filter value must be u64")
    return Predicate(column, name, None if value is None else int(value))


def project(df: DataFrame, projection: list[str] | None) -> list[str]:
    """Checked column names; empty means all."""
    names = list(projection or [])
    if len(set(names)) < len(names):
        raise ValueError("a column is projected twice")
    if any(n not in df.columns for n in names):
        raise ValueError("the projection names no column of the table")
    return names or df.columns


def scan(df: DataFrame, projection: list[str] | None = None, predicate: Predicate | None = None) -> DataFrame:
    """Rows that match, with the projected columns. The filter and the columns reach the file scan; the predicate's column need not be projected."""
    names = project(df, projection)
    if predicate:
        predicate.check(df)
        df = df.where(predicate.condition())
    return df.select(*names)


def may_match(predicate: Predicate) -> Column:
    """Over a row of column statistics: false only if no row of the group can match."""
    if predicate.op == "is_null":
        return F.col("null_count") > 0
    v = F.lit(predicate.value)
    low, high = F.col("min_value"), F.col("max_value")
    rule = {"eq": (low <= v) & (v <= high), "lt": low < v, "le": low <= v, "gt": high > v, "ge": high >= v}[predicate.op]
    # Without statistics (all null) a group is scanned.
    return F.coalesce(rule, F.lit(True))


def prune_counts(df: DataFrame, predicate: Predicate, group: str = "row_group") -> DataFrame:
    """One row: row_groups_scanned and row_groups_pruned."""
    predicate.check(df)
    stats = column_stats(df, [predicate.column], group)
    keep = may_match(predicate)
    return stats.agg(F.count_if(keep).alias("row_groups_scanned"), F.count_if(~keep).alias("row_groups_pruned"))


@dataclass
class ScanResult:
    rows: DataFrame
    row_groups_scanned: int
    row_groups_pruned: int


def scan_groups(df: DataFrame, projection: list[str] | None = None, predicate: Predicate | None = None, group: str = "row_group") -> ScanResult:
    """A scan of a table with row groups, and how many of them statistics rule out."""
    visible = df.drop(group, "row_index")
    names = project(visible, projection)
    rows = df
    if predicate:
        predicate.check(visible)
        rows = df.where(predicate.condition())
        r = prune_counts(df, predicate, group).first()
        scanned, pruned = r.row_groups_scanned, r.row_groups_pruned
    else:
        scanned, pruned = df.select(group).distinct().count(), 0
    return ScanResult(rows.select(*names), scanned, pruned)


def find_row_group(footer: DataFrame, row: int) -> DataFrame:
    """The footer row of the group that has this row number; none past the end."""
    return footer.where((F.col("first_row") <= row) & (F.lit(row) < F.col("first_row") + F.col("row_count")))
