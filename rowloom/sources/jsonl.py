"""Strict JSON-lines input and canonical JSON-lines output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.layout import with_row_index
from ..schema import Schema

MAX_LINE_BYTES = 256 << 20
_BAD = "_bad"


def parse_lines(lines: DataFrame, schema: Schema, value: str = "value", most_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """JSON objects of a text column as typed columns; other columns of ``lines`` stay in front.

    Blank lines are skipped and keys outside the schema dropped. A missing key is null
    in a nullable column. A row that is no object, lacks a required column or has a
    value of another type fails the query when it runs. Unsigned values may be as
    large as a long. One pass, in Spark's JSON parser.
    """
    kept = [F.col(c) for c in lines.columns if c != value]
    text = F.regexp_replace(F.col(value), "\r$", "")
    ready = lines.where(F.length(F.trim(text)) > 0).select(*kept, text.alias(value))
    types = T.StructType([T.StructField(c.name, T.LongType() if c.type == "u64" else T.BooleanType() if c.type == "bool" else T.StringType()) for c in schema.columns] + [T.StructField(_BAD, T.StringType())])
    row = F.from_json(F.col(value), types, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    parsed = ready.withColumn("_row", row)
    problem = F.coalesce(
        F.when(F.octet_length(value) > most_bytes, F.lit("a line is longer than allowed")),
        F.when(F.json_object_keys(value).isNull(), F.lit("a line is no JSON object")),
        *(_problem(c.name, c.type, c.nullable, value) for c in schema.columns),
        F.when(F.col(f"_row.{_BAD}").isNotNull(), F.lit("a line is no JSON object")),
    )
    # A filter stays in every plan, also where no column is read, and looks at each line once.
    sound = parsed.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))
    return sound.select(*kept, *(F.col("_row").getField(c.name).alias(c.name) for c in schema.columns))


def _problem(name: str, kind: str, nullable: bool, value: str) -> Column:
    """The message for a missing, null or ill-typed value, else null."""
    got = F.col("_row").getField(name)
    has = F.array_contains(F.json_object_keys(value), name)
    raw = F.get_json_object(value, f"$['{name}']")
    missing = F.when(F.lit(not nullable) & ~has, F.lit(f"a row lacks the column {name}"))
    null = F.when(F.lit(not nullable) & has & raw.isNull(), F.lit(f"the value of column {name} is no {kind}"))
    if kind == "u64":
        wrong = raw.isNotNull() & (got.isNull() | (got < 0))
    elif kind == "bool":
        wrong = raw.isNotNull() & got.isNull()
    else:
        wrong = raw.isNotNull() & (got.isNull() | _not_a_string(name, value))
    return F.coalesce(missing, null, F.when(wrong, F.lit(f"the value of column {name} is no {kind}")))


def _not_a_string(name: str, value: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), f"$['{name}']", "variant"))
    return F.coalesce(kind != "STRING", F.lit(False))


def read_jsonl(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """A JSON-lines file or folder, with a contiguous row_index in file order."""
    lines = with_row_index(spark.read.text(path))
    return parse_lines(lines, schema)


def render(columns: list[str]) -> Column:
    """One compact JSON object per row, keys in the order given, nulls written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Canonical lines; by default never over existing data."""
    names = columns or [c for c in df.columns if c != "row_index"]
    df.select(render(names).alias("value")).write.mode(mode).text(path)
