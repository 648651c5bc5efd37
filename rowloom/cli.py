"""Command line over the Python API: ``python -m rowloom.cli COMMAND ...``.

Tables are Parquet folders with a row_index and a row_group column.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Iterator
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evolution, layout, scan, search, stats, storage
from .schema import parse_schema
from .sources import jsonl
from .sources.postings import read_postings
from .streaming import append


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rowloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **options: dict) -> None:
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x)
        for x, o in options.items():
            p.add_argument("--" + x.replace("_", "-"), **o)

    rows = {"type": int, "default": layout.ROW_GROUP_ROWS}
    command("encode", "input", "output", schema={"required": True}, row_group_rows=rows)
    command("decode", "input", "output", columns={}, filter_column={}, filter_op={}, filter_value={})
    command("inspect", "input")
    command("validate", "input")
    command("schema-check", "writer", "reader")
    command("evolve-decode", "input", "output", writer={"required": True}, reader={"required": True})
    command("repair", "input", "output", plan_only={"action": "store_true"})
    command("metadata-migrate", "input", "output", assign={"action": "append", "default": []})
    for name in ("bench", "parallel-bench", "repair-bench"):
        command(name, "input", iterations={"type": int, "default": 3})
    command("search-encode", "input", "output")
    command("search-inspect", "input")
    command("search-lookup", "input", "term")
    command("search-seek", "input", "term", "doc_id")
    command("search-bench", "input", "terms", k={"type": int, "default": 10}, iterations={"type": int, "default": 3})
    command("stream-append", "input", "output", schema={"required": True})
    command("stream-recover", "input")
    command("stream-replay", "input", "output")
    command("stream-roll", "input", "output", max_blocks={"type": int, "default": layout.SEGMENT_BLOCKS}, max_segment_bytes={"type": int, "default": layout.SEGMENT_BYTES}, block_rows={"type": int, "default": layout.BLOCK_ROWS}, block_bytes={"type": int, "default": layout.BLOCK_BYTES})
    command("stream-bench", "input", schema={"required": True}, iterations={"type": int, "default": 3})
    command("snapshot-encode", "input", "output", checkpoint_id={"type": int, "required": True})
    command("snapshot-decode", "input", "output")
    return top


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Blocks of a table held against its footer; a log without row groups is cut by ``BLOCK_ROWS``."""
    if "row_group" in spark.read.parquet(path).columns:
        return storage.stored_blocks(spark, path)
    return storage.seal(layout.with_group(spark.read.parquet(path), layout.BLOCK_ROWS)).withColumn("valid", F.lit(True)), False


def _timed(work, iterations: int) -> float:
    began = time.perf_counter()
    for _ in range(iterations):
        work()
    return 1000 * (time.perf_counter() - began) / iterations


def _rows(table: DataFrame) -> Iterator[dict]:
    """All rows, a partition in the driver at a time."""
    return (r.asDict() for r in table.toLocalIterator())


def emit(out: object, to: TextIO) -> None:
    """Writes what ``run`` returns as JSON, like ``json.dumps``; iterators as lists, item by item."""
    if isinstance(out, dict):
        to.write("{")
        for i, (k, v) in enumerate(out.items()):
            to.write(f"{', ' if i else ''}{json.dumps(k)}: ")
            emit(v, to)
        to.write("}")
    elif isinstance(out, Iterator):
        to.write("[")
        for i, v in enumerate(out):
            to.write((", " if i else "") + json.dumps(v, default=str))
        to.write("]")
    else:
        to.write(json.dumps(out, default=str))


def run(argv: list[str], spark: SparkSession | None = None) -> dict | list | Iterator | None:
    """Runs a command and returns what it reports: terms and row groups, of which there may be many, as iterators."""
    a = _parser().parse_args(argv)
    if a.command == "schema-check":
        found = evolution.assess(*(evolution.parse_revision(Path(p).read_text()) for p in (a.writer, a.reader)))
        return {"compatible": found.compatible, "actions": found.actions, "issues": found.issues}
    if a.command == "metadata-migrate":
        given = {k: int(v) for k, v in (x.split("=", 1) for x in a.assign)}
        with open(a.output, "x") as f:
            f.write(evolution.migrate_metadata(Path(a.input).read_text(), given))
        return None
    if a.command == "snapshot-encode":
        with open(a.output, "xb") as f:
            f.write(append.encode_snapshot(a.checkpoint_id, Path(a.input).read_bytes()))
        return None
    if a.command == "snapshot-decode":
        number, state = append.decode_snapshot(Path(a.input).read_bytes())
        with open(a.output, "xb") as f:
            f.write(state)
        return {"checkpoint_id": number, "raw_len": len(state)}

    spark = spark or SparkSession.builder.appName("rowloom").getOrCreate()
    schema = parse_schema(Path(a.schema).read_text()) if getattr(a, "schema", None) else None
    if a.command == "encode":
        storage.store(layout.with_group(jsonl.read_jsonl(spark, a.input, schema.check_groups()), a.row_group_rows), a.output)
        return None
    if a.command == "search-encode":
        found = read_postings(spark, a.input)
        if not search.check_postings(found).isEmpty():
            raise ValueError("postings must be strictly increasing")
        search.write_index(found, a.output)
        return None
    if a.command == "stream-append":
        return {"first_row": append.append_to(spark, a.output, jsonl.read_jsonl(spark, a.input, schema.check_stream()).drop("row_index"))}
    if a.command == "stream-bench":
        return {"parse_ms": _timed(lambda: jsonl.read_jsonl(spark, a.input, schema).write.format("noop").mode("overwrite").save(), a.iterations)}

    table = spark.read.parquet(a.input)
    if a.command == "decode":
        names = scan.parse_projection(a.columns) or [c for c in table.columns if c not in ("row_index", "row_group")]
        r = scan.scan_groups(table, names, scan.parse_predicate(a.filter_column, a.filter_op, a.filter_value))
        jsonl.write_jsonl(r.rows, a.output, names)
        return {"row_groups_scanned": r.row_groups_scanned, "row_groups_pruned": r.row_groups_pruned}
    if a.command == "inspect":
        return stats.inspect_file(table).first().asDict() | {"groups": _rows(stats.footer(table).orderBy("row_group"))}
    if a.command == "validate":
        return storage.validate(_blocks(spark, a.input)[0]).first().asDict()
    if a.command == "evolve-decode":
        writer, reader = (evolution.parse_revision(Path(p).read_text()) for p in (a.writer, a.reader))
        out = evolution.evolve(table, writer, reader)
        jsonl.write_jsonl(out, a.output, sorted(out.columns))
        return None
    if a.command == "repair":
        plan = storage.repair_plan(*_blocks(spark, a.input), crc="crc")
        if not a.plan_only:
            storage.repair_stored(spark, a.input, plan, a.output)
        return plan.first().asDict()
    if a.command in ("bench", "parallel-bench"):
        columns = [c for c in table.columns if c not in ("row_index", "row_group")]
        return {"decode_ms": _timed(lambda: table.write.format("noop").mode("overwrite").save(), a.iterations), "projected_decode_ms": _timed(lambda: table.select(columns[0]).write.format("noop").mode("overwrite").save(), a.iterations)}
    if a.command == "repair-bench":
        return {"plan_ms": _timed(lambda: storage.repair_plan(*_blocks(spark, a.input), crc="crc").collect(), a.iterations)}
    if a.command == "search-inspect":
        return _rows(search.dictionary(table).orderBy("term"))
    if a.command == "search-lookup":
        return [r.asDict() for r in search.lookup(table, a.term).orderBy("doc_id").collect()]
    if a.command == "search-seek":
        return [r.asDict() for r in search.seek_doc(table, a.term, int(a.doc_id)).collect()]
    if a.command == "search-bench":
        terms = scan.parse_projection(a.terms)
        return {"and_ms": _timed(lambda: search.and_docs(table, terms).count(), a.iterations), "top_k_ms": _timed(lambda: search.topk_frequency(table, terms, a.k).collect(), a.iterations)}
    if a.command == "stream-recover":
        return storage.recovery(_blocks(spark, a.input)[0]).first().asDict()
    if a.command == "stream-replay":
        columns = [c for c in table.columns if c not in ("row_index", "row_group")]
        jsonl.write_jsonl(append.replay(table), a.output, columns)
        return None
    if a.command == "stream-roll":
        columns = [c for c in table.columns if c not in ("row_index", "row_group")]
        sized = table.drop("row_group").withColumn("n_bytes", F.octet_length(jsonl.render(columns)))
        cut = layout.cut_blocks(sized, max_rows=a.block_rows, max_bytes=a.block_bytes)
        blocks = cut.groupBy("block_index").agg(F.sum("n_bytes").alias("n_bytes"))
        rolled = cut.drop("n_bytes").join(layout.roll_segments(blocks, a.max_blocks, a.max_segment_bytes).select("block_index", "segment_id"), "block_index")
        rolled.write.mode("errorifexists").partitionBy("segment_id").parquet(a.output)
        return {"segments": rolled.select("segment_id").distinct().count()}
    raise ValueError(a.command)


def main() -> int:
    try:
        out = run(sys.argv[1:])
    except (ValueError, FileExistsError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if out is not None:
        emit(out, sys.stdout)
        print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
