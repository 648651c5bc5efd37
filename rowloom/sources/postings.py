"""Search postings as text: ``term doc_id positions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_postings(lines: DataFrame, value: str = "value") -> DataFrame:
    """term, doc_id, positions of each line. ``#`` begins a comment line, ``-`` means no positions; any other form fails the query."""
    text = F.trim(F.col(value))
    parts = lines.where((text != "") & ~text.startswith("#")).select(F.split(text, r"\s+").alias("p"), text.alias("line"))
    ok = (F.size("p") == 3) & F.col("p")[1].rlike("^[0-9]+$") & F.col("p")[2].rlike("^(-|[0-9]+(,[0-9]+)*)$")
    checked = parts.select(F.when(ok, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("invalid posting line: "), "line"))).alias("p"))
    positions = F.when(F.col("p")[2] == "-", F.array().cast("array<long>")).otherwise(F.transform(F.split(F.col("p")[2], ","), lambda x: x.cast("long")))
    return checked.select(F.col("p")[0].alias("term"), F.col("p")[1].cast("long").alias("doc_id"), positions.alias("positions"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return parse_postings(spark.read.text(path))
