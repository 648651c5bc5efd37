"""The engine's queries, and the DuckDB SQL of each, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import frames
from ..functions import primitives as P
from ..operators import evolution as V
from ..operators import layout, scan, search, stats, storage
from ..sources import jsonl
from ..streaming import append

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GROUP = layout.ROW_GROUP_ROWS


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; event_id is contiguous from 0, so it is the row index."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_index"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "user_id", "event_type",
        F.expr("nullif(event_type, 'error')").alias("svc"), (F.col("value") > 100).alias("active"),
    )


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_group(events(spark, sf_dir), GROUP)


EV = "(SELECT event_id AS row_index, event_id, epoch_us(ts) AS ts, user_id, event_type, nullif(event_type, 'error') AS svc, value > 100 AS active FROM events)"
EVG = f"(SELECT *, CAST(floor(row_index / {GROUP}) AS BIGINT) AS row_group FROM {EV})"


def crc_sql(octets: str) -> str:
    """CRC-32 of a list of byte values: each byte is mixed in, then shifted out bit by bit (-1 marks a bit)."""
    steps = f"flatten(list_transform({octets}, lambda o: [o, -1, -1, -1, -1, -1, -1, -1, -1]))"
    mix = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(CAST({steps} AS BIGINT[]), lambda c, x: {mix}, CAST(4294967295 AS BIGINT)), 4294967295)"


# scans


@query(f"SELECT * FROM {EV}")
def scan_full(spark, sf_dir):
    return scan.scan(events(spark, sf_dir))


@query(f"SELECT event_id, svc FROM {EV}")
def scan_project(spark, sf_dir):
    return scan.scan(events(spark, sf_dir), ["event_id", "svc"])


def _comparison(op: str, sign: str) -> None:
    def run(spark, sf_dir):
        return scan.scan(events(spark, sf_dir), ["event_id", "event_type"], scan.Predicate("event_id", op, 500))

    run.__name__ = f"scan_{op}"
    query(f"SELECT event_id, event_type FROM events WHERE event_id {sign} 500")(run)


for _op, _sign in (("eq", "="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _comparison(_op, _sign)


@query(f"SELECT event_id FROM {EV} WHERE svc IS NULL")
def scan_is_null(spark, sf_dir):
    return scan.scan(events(spark, sf_dir), ["event_id"], scan.Predicate("svc", "is_null"))


@query("""SELECT '{"event_id":' || event_id || ',"active":' || CASE WHEN active THEN 'true' ELSE 'false' END || ',"svc":' || CASE WHEN svc IS NULL THEN 'null' ELSE '"' || svc || '"' END || '}' AS line FROM """ + EV)
def scan_jsonl_render(spark, sf_dir):
    return events(spark, sf_dir).select(jsonl.render(["event_id", "active", "svc"]).alias("line"))


@query(f"SELECT row_index, event_id, active, svc FROM {EV}")
def ingest_jsonl(spark, sf_dir):
    from ..schema import ColumnSchema, Schema

    schema = Schema((ColumnSchema("event_id", "u64"), ColumnSchema("active", "bool"), ColumnSchema("svc", "string", nullable=True)))
    lines = events(spark, sf_dir).select("row_index", jsonl.render(["event_id", "active", "svc"]).alias("value"))
    return jsonl.parse_lines(lines, schema)


# pruning and footers


def _prune(name: str, predicate: scan.Predicate, rule: str) -> None:
    def run(spark, sf_dir):
        return scan.prune_counts(grouped(spark, sf_dir), predicate)

    run.__name__ = f"prune_counts_{name}"
    c = predicate.column
    low = f"min({c}) AS lo, max({c}) AS hi," if predicate.op != "is_null" else ""
    query(f"SELECT count(*) FILTER ({rule}) AS row_groups_scanned, count(*) FILTER (NOT ({rule})) AS row_groups_pruned FROM (SELECT row_group, {low} count(*) FILTER ({c} IS NULL) AS nulls FROM {EVG} GROUP BY row_group)")(run)


_prune("eq", scan.Predicate("event_id", "eq", 5000), "lo <= 5000 AND 5000 <= hi")
_prune("ge", scan.Predicate("event_id", "ge", 5000), "hi >= 5000")
_prune("lt", scan.Predicate("event_id", "lt", 5000), "lo < 5000")
_prune("is_null", scan.Predicate("svc", "is_null"), "nulls > 0")


@query(f"SELECT row_group, min(row_index) AS first_row, count(*) AS row_count FROM {EVG} GROUP BY row_group")
def footer_row_groups(spark, sf_dir):
    return stats.footer(grouped(spark, sf_dir))


def _footer(name: str, column: str, parts: str, keep: list[str]) -> None:
    def run(spark, sf_dir):
        return stats.column_stats(grouped(spark, sf_dir), [column]).select("row_group", "value_count", "null_count", *keep, "raw_size")

    run.__name__ = f"footer_stats_{name}"
    query(f"SELECT row_group, count(*) AS value_count, count(*) FILTER ({column} IS NULL) AS null_count, {parts} FROM {EVG} GROUP BY row_group")(run)


_footer("u64", "user_id", "min(user_id) AS min_value, max(user_id) AS max_value, 8 * count(user_id) AS raw_size", ["min_value", "max_value"])
_footer("bool", "active", "count(*) FILTER (active) AS true_count, count(active) AS raw_size", ["true_count"])
_footer("string", "svc", "count(DISTINCT svc) AS distinct_count, CAST(coalesce(sum(strlen(svc)), 0) AS BIGINT) AS raw_size", ["distinct_count"])


@query(f"SELECT count(*) AS row_count, count(DISTINCT row_group) AS row_groups, CAST(6 AS BIGINT) AS columns, CAST(sum(24 + 1 + strlen(event_type) + coalesce(strlen(svc), 0)) AS BIGINT) AS raw_size FROM {EVG}")
def inspect_totals(spark, sf_dir):
    return stats.inspect_file(grouped(spark, sf_dir))


@query(f"SELECT * FROM (SELECT row_group, min(row_index) AS first_row, count(*) AS row_count FROM {EVG} GROUP BY row_group) WHERE first_row <= 3000 AND 3000 < first_row + row_count")
def row_lookup(spark, sf_dir):
    return scan.find_row_group(stats.footer(grouped(spark, sf_dir)), 3000)


@query("SELECT row_group, 'svc' AS \"column\" FROM (SELECT 0 AS row_group) WHERE false")
def stats_mismatches(spark, sf_dir):
    data = grouped(spark, sf_dir).select("row_index", "row_group", "event_id", "svc", "active")
    return stats.mismatches(stats.column_stats(data), data)


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark, sf_dir):
    return layout.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS note, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def row_index_wide(spark, sf_dir):
    """Rows of 1 KB, whose partitions are cut otherwise than those of the key alone."""
    wide = table(spark, sf_dir, "orders").select("o_orderkey", F.repeat(F.md5(F.col("o_orderkey").cast("string")), 32).alias("wide"))
    return layout.with_row_index(wide, "o_orderkey").select("o_orderkey", F.left("wide", F.lit(32)).alias("note"), "row_index")


@query(f"SELECT DISTINCT row_group, 'svc' AS \"column\" FROM {EVG} WHERE row_index % 5000 = 3 AND svc IS NOT NULL")
def stats_mismatches_found(spark, sf_dir):
    """Statistics stored before some values were lost."""
    data = grouped(spark, sf_dir).select("row_index", "row_group", "event_id", "svc", "active")
    lost = data.withColumn("svc", F.when(F.col("row_index") % 5000 != 3, F.col("svc")))
    return stats.mismatches(stats.column_stats(data), lost)


# blocks and streams


def _sized(spark, sf_dir):
    return events(spark, sf_dir).select("row_index", (F.octet_length("event_type") + F.length(F.col("user_id").cast("string"))).cast("long").alias("n_bytes"))


SIZED = f"(SELECT row_index, strlen(event_type) + length(CAST(user_id AS VARCHAR)) AS n_bytes FROM {EV})"


@query(f"SELECT CAST(floor(row_index / 100) AS BIGINT) AS block_index, min(row_index) AS first_row, count(*) AS row_count, CAST(sum(n_bytes) AS BIGINT) AS raw_size FROM {SIZED} GROUP BY 1")
def blocks_by_rows(spark, sf_dir):
    return stats.block_stats(layout.with_group(_sized(spark, sf_dir), 100, "block_index"))


@query(
    f"""WITH RECURSIVE r AS (SELECT row_index, n_bytes FROM {SIZED}),
t AS (SELECT row_index, n_bytes AS used, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS block FROM r WHERE row_index = 0 UNION ALL
SELECT r.row_index, CASE WHEN t.n + 1 > 30 OR t.used + r.n_bytes > 256 THEN r.n_bytes ELSE t.used + r.n_bytes END, CASE WHEN t.n + 1 > 30 OR t.used + r.n_bytes > 256 THEN 1 ELSE t.n + 1 END,
CASE WHEN t.n + 1 > 30 OR t.used + r.n_bytes > 256 THEN t.block + 1 ELSE t.block END FROM t JOIN r ON r.row_index = t.row_index + 1)
SELECT block AS block_index, min(row_index) AS first_row, count(*) AS row_count FROM t GROUP BY block"""
)
def blocks_by_bytes(spark, sf_dir):
    return stats.block_stats(layout.cut_blocks(_sized(spark, sf_dir), max_rows=30, max_bytes=256)).select("block_index", "first_row", "row_count")


def _blocks(spark, sf_dir):
    return stats.block_stats(layout.with_group(_sized(spark, sf_dir), 100, "block_index"))


BLOCKS = f"(SELECT CAST(floor(row_index / 100) AS BIGINT) AS block_index, min(row_index) AS first_row, count(*) AS row_count, CAST(sum(n_bytes) AS BIGINT) AS raw_size FROM {SIZED} GROUP BY 1)"


@query(f"SELECT count(*) AS blocks, CAST(sum(row_count) AS BIGINT) AS rows, CAST(sum(raw_size) AS BIGINT) AS raw_bytes FROM {BLOCKS}")
def stream_totals(spark, sf_dir):
    return stats.totals(_blocks(spark, sf_dir))


@query(f"SELECT row_index, event_id, event_type FROM {EV}")
def append_replay(spark, sf_dir):
    log = events(spark, sf_dir).select("row_index", "event_id", "event_type")
    head, tail = log.where("event_id < 400"), log.where("event_id >= 400").drop("row_index")
    return append.append_batch(head, tail, "event_id")


def _marked(spark, sf_dir):
    return _blocks(spark, sf_dir).withColumn("valid", (F.col("block_index") % 17 != 16))


MARKED = f"(SELECT *, block_index % 17 != 16 AS valid FROM {BLOCKS})"
PREFIX = f"(SELECT * FROM {MARKED} WHERE block_index < coalesce((SELECT min(block_index) FROM {MARKED} WHERE NOT valid), 1000000000))"


@query(f"SELECT * FROM {PREFIX}")
def recover_prefix(spark, sf_dir):
    return storage.recover_prefix(_marked(spark, sf_dir))


@query(f"SELECT (SELECT count(*) FROM {PREFIX}) AS blocks, (SELECT CAST(sum(row_count) AS BIGINT) FROM {PREFIX}) AS rows, (SELECT CAST(sum(raw_size) AS BIGINT) FROM {PREFIX}) AS bytes, (SELECT count(*) FROM {PREFIX}) < (SELECT count(*) FROM {MARKED}) AS corrupt_tail, CASE WHEN (SELECT count(*) FROM {PREFIX}) < (SELECT count(*) FROM {MARKED}) THEN 'TruncateTailAndRebuildFooter' ELSE 'RebuildFooter' END AS action")
def repair_plan(spark, sf_dir):
    return storage.repair_plan(_marked(spark, sf_dir), has_footer=False).drop("source_digest")


@query(f"SELECT count(*) AS blocks, CAST(sum(row_count) AS BIGINT) AS rows, count(*) FILTER (NOT valid) AS bad_checksums, CAST(0 AS BIGINT) AS empty_blocks, CAST(0 AS BIGINT) AS breaks, count(*) FILTER (NOT valid) = 0 AS sound FROM {MARKED}")
def validate_report(spark, sf_dir):
    return storage.validate(_marked(spark, sf_dir))


@query(f"SELECT count(*) AS blocks, CAST(sum(row_count) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bad_checksums, CAST(0 AS BIGINT) AS empty_blocks, CAST(2 AS BIGINT) AS breaks, false AS sound FROM {BLOCKS} WHERE block_index NOT IN (2, 5)")
def validate_breaks(spark, sf_dir):
    """Two blocks are gone."""
    return storage.validate(_blocks(spark, sf_dir).where("block_index NOT IN (2, 5)").withColumn("valid", F.lit(True)))


@query(f"SELECT row_group AS block_index, max(CASE WHEN row_index % 3000 = 7 THEN 1 ELSE 0 END) = 0 AS valid FROM {EVG} GROUP BY row_group")
def damaged_blocks(spark, sf_dir):
    """Blocks whose rows no longer have the checksum that was taken when they were sound."""
    data = grouped(spark, sf_dir).select("row_index", "row_group", "event_id", "event_type")
    damaged = data.withColumn("event_type", F.when(F.col("row_index") % 3000 == 7, F.reverse("event_type")).otherwise(F.col("event_type")))
    stated = storage.seal(data).select("block_index", F.col("crc").alias("stated"))
    return storage.seal(damaged).join(stated, "block_index").select("block_index", (F.col("crc") == F.col("stated")).alias("valid"))


@query(f"SELECT block_index, CAST(floor(block_index / 4) AS BIGINT) AS segment_id, block_index % 4 AS block_in_segment FROM {BLOCKS}")
def roll_by_blocks(spark, sf_dir):
    return layout.roll_segments(_blocks(spark, sf_dir), max_blocks=4, size="raw_size").select("block_index", "segment_id", "block_in_segment")


@query(
    f"""WITH RECURSIVE t AS (SELECT block_index, CAST(raw_size AS BIGINT) AS used, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS segment FROM {BLOCKS} WHERE block_index = 0 UNION ALL
SELECT b.block_index, CASE WHEN t.n >= 5 OR t.used >= 2500 THEN b.raw_size ELSE t.used + b.raw_size END, CASE WHEN t.n >= 5 OR t.used >= 2500 THEN 1 ELSE t.n + 1 END,
CASE WHEN t.n >= 5 OR t.used >= 2500 THEN t.segment + 1 ELSE t.segment END FROM t JOIN {BLOCKS} b ON b.block_index = t.block_index + 1)
SELECT block_index, segment AS segment_id, n - 1 AS block_in_segment FROM t"""
)
def roll_by_bytes(spark, sf_dir):
    return layout.roll_segments(_blocks(spark, sf_dir), max_blocks=5, max_bytes=2500, size="raw_size").select("block_index", "segment_id", "block_in_segment")


@query(f"SELECT row_index, event_id, event_type FROM {EVG} WHERE row_group < coalesce((SELECT min(row_group) FROM {EVG} WHERE row_index % 3000 = 2999), 1000000000)")
def replay_valid_prefix(spark, sf_dir):
    """Replay of a log of which blocks were damaged after their checksums were taken: rows before the first such block."""
    data = grouped(spark, sf_dir).select("row_index", "row_group", "event_id", "event_type")
    damaged = data.withColumn("event_type", F.when(F.col("row_index") % 3000 == 2999, F.reverse("event_type")).otherwise(F.col("event_type")))
    stated = storage.seal(data).select("block_index", F.col("crc").alias("stated"))
    blocks = storage.seal(damaged).join(stated, "block_index").withColumn("valid", F.col("crc") == F.col("stated"))
    log = damaged.withColumnRenamed("row_group", "block_index")
    return append.replay(log, storage.recover_prefix(blocks)).select("row_index", "event_id", "event_type")


@query(f"""SELECT checkpoint_id, CAST(length(s) AS BIGINT) AS raw_len, {crc_sql("list_transform(string_split(s, ''), lambda d: CAST(ascii(d) AS BIGINT))")} AS crc
FROM (SELECT user_id AS checkpoint_id, CAST(sum(event_id) AS VARCHAR) AS s FROM events GROUP BY user_id)""")
def snapshot_crc(spark, sf_dir):
    states = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("event_id").alias("s"))
    return append.snapshots(states.select(F.col("user_id").alias("checkpoint_id"), F.encode(F.col("s").cast("string"), "UTF-8").alias("state"))).select("checkpoint_id", "raw_len", "crc")


@query("SELECT p_partkey, md5(p_name) AS path, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END AS format_version FROM part")
def detect_formats(spark, sf_dir):
    head = F.when(F.col("p_partkey") % 5 == 0, F.lit("XXXX")).otherwise(F.concat(F.lit("CMP"), (F.col("p_partkey") % 5).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.md5("p_name").alias("path"), storage.format_version(F.encode(F.concat(head, F.col("p_name")), "UTF-8")).alias("format_version"))


# primitives


@query(f"SELECT row_index, row_group, ts - coalesce(lag(ts) OVER (PARTITION BY row_group ORDER BY row_index), 0) AS delta FROM {EVG}")
def delta_u64_encode(spark, sf_dir):
    return C.delta_rows(grouped(spark, sf_dir), "ts")


@query(f"SELECT row_index, ts AS value FROM {EV}")
def delta_u64_decode(spark, sf_dir):
    return C.undelta_rows(C.delta_rows(grouped(spark, sf_dir), "ts")).select("row_index", "value")


@query(f"SELECT row_index, d AS delta, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS zigzag FROM (SELECT row_index, user_id - coalesce(lag(user_id) OVER (PARTITION BY row_group ORDER BY row_index), 0) AS d FROM {EVG})")
def delta_i64_zigzag(spark, sf_dir):
    return C.delta_rows(grouped(spark, sf_dir), "user_id", signed=True).select("row_index", "delta", P.zigzag(F.col("delta")).alias("zigzag"))


WIDTH = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


@query(f"SELECT o_orderkey, CAST(greatest(1, ceil(({WIDTH.format('o_custkey')}) / 7.0)) AS BIGINT) AS varint_len, CAST({WIDTH.format('o_custkey')} AS BIGINT) AS bit_width FROM orders")
def varint_len(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", P.varint_length(F.col("o_custkey")).alias("varint_len"), P.bit_width(F.col("o_custkey")).alias("bit_width"))


@query(
    f"""SELECT row_group, count(*) AS value_count, CAST(ceil(count(*) * (CASE WHEN coalesce(max(inner_d), 0) = 0 THEN 0 ELSE length(bin(max(inner_d))) END) / 8.0) AS BIGINT) AS delta_bitpack,
CAST(ceil(count(*) * length(bin(max(ts))) / 8.0) AS BIGINT) AS bitpack, CAST(sum(greatest(1, ceil(({WIDTH.format('d')}) / 7.0))) AS BIGINT) AS delta_varint_u64, 8 * count(*) AS stored
FROM (SELECT row_group, ts, ts - lag(ts) OVER w AS inner_d, ts - coalesce(lag(ts) OVER w, 0) AS d FROM {EVG} WINDOW w AS (PARTITION BY row_group ORDER BY row_index)) GROUP BY row_group"""
)
def codec_sizes_u64(spark, sf_dir):
    return C.number_sizes(grouped(spark, sf_dir), "ts")


@query(
    f"""WITH r AS (SELECT row_index, row_group, event_type, lag(event_type) OVER (PARTITION BY row_group ORDER BY row_index) AS b FROM {EVG}),
i AS (SELECT row_index, row_group, event_type, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY row_group ORDER BY row_index) AS run FROM r)
SELECT row_group, min(row_index) AS first_row, event_type, count(*) AS run_length, CAST(ceil(count(*) / 255.0) AS BIGINT) AS pairs FROM i GROUP BY row_group, run, event_type"""
)
def rle_runs(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("row_group").orderBy("row_index")
    before = F.lag("event_type").over(w)
    runs = grouped(spark, sf_dir).withColumn("fresh", (before.isNull() | (before != F.col("event_type"))).cast("int")).withColumn("run", F.sum("fresh").over(w))
    out = runs.groupBy("row_group", "run", "event_type").agg(F.min("row_index").alias("first_row"), F.count(F.lit(1)).alias("run_length"))
    return out.select("row_group", "first_row", "event_type", "run_length", F.ceil(F.col("run_length") / 255).alias("pairs"))


@query("SELECT n_nationkey AS key, CAST(i AS BIGINT) AS place, CAST((ascii(substr(n_name, i + 1, 1)) - CASE WHEN i = 0 THEN 0 ELSE ascii(substr(n_name, i, 1)) END + 256) % 256 AS BIGINT) AS delta FROM (SELECT n_nationkey, n_name, unnest(range(CAST(length(n_name) AS BIGINT))) AS i FROM nation)")
def byte_delta(spark, sf_dir):
    from pyspark.sql import Window as W

    chars = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.posexplode(F.filter(F.split("n_name", ""), lambda c: c != "")).alias("place", "c"))
    byte = F.ascii("c")
    before = F.coalesce(F.lag(byte).over(W.partitionBy("key").orderBy("place")), F.lit(0))
    return chars.select("key", F.col("place").cast("long").alias("place"), F.pmod(byte - before, F.lit(256)).cast("long").alias("delta"))


@query(f"WITH f AS (SELECT event_type, min(row_index) AS f FROM {EV} GROUP BY 1), d AS (SELECT event_type, row_number() OVER (ORDER BY f) - 1 AS id FROM f) SELECT row_index, id FROM {EV} JOIN d USING (event_type)")
def dictionary_encode(spark, sf_dir):
    return C.dictionary_encode(events(spark, sf_dir), "event_type")[0]


@query(f"SELECT row_index, event_type AS value FROM {EV}")
def dictionary_decode(spark, sf_dir):
    return C.dictionary_decode(*C.dictionary_encode(events(spark, sf_dir), "event_type"))


@query(
    """WITH c AS (SELECT c_custkey, c_name, lag(c_name) OVER (ORDER BY c_custkey) AS b FROM customer)
SELECT c_custkey, CAST(CASE WHEN b IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(b), length(c_name)) + 1), lambda i: substr(b, 1, i) = substr(c_name, 1, i))) END AS BIGINT) AS shared FROM c"""
)
def prefix_lengths(spark, sf_dir):
    from pyspark.sql import Window as W

    c = layout.with_group(layout.with_row_index(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey"), GROUP)
    # The value before a group's first is the last of the group before: fetched by row number, so no window spans the table.
    before = F.lag("c_name").over(W.partitionBy("row_group").orderBy("row_index"))
    last = c.where(F.col("row_index") % GROUP == GROUP - 1).select((F.col("row_group") + 1).alias("row_group"), F.col("c_name").alias("tail"))
    return c.withColumn("b", before).join(last, "row_group", "left").select("c_custkey", C.prefix_length(F.coalesce("b", "tail"), F.col("c_name")).alias("shared"))


def _bitmap(bit: str, name: str) -> None:
    sql_bit = {"active": "active", "svc": "svc IS NOT NULL"}[bit]

    def run(spark, sf_dir):
        e = events(spark, sf_dir)
        value = F.col("active") if bit == "active" else F.col("svc").isNotNull()
        shift = F.expr("CAST(row_index % 8 AS INT)")
        return e.groupBy(F.floor(F.col("row_index") / 8).cast("long").alias("byte_index")).agg(F.sum(F.call_function("shiftleft", value.cast("long"), shift)).alias("byte_value"))

    run.__name__ = name
    query(f"SELECT CAST(floor(row_index / 8) AS BIGINT) AS byte_index, CAST(sum(CAST({sql_bit} AS BIGINT) << CAST(row_index % 8 AS INT)) AS BIGINT) AS byte_value FROM {EV} GROUP BY 1")(run)


_bitmap("active", "bitmap_pack")
_bitmap("svc", "validity_bitmap")


@query(
    f"""WITH s AS (SELECT row_group, count(*) AS n, CASE WHEN coalesce(max(inner_d), 0) = 0 THEN 0 ELSE length(bin(max(inner_d))) END AS dw, length(bin(max(ts))) AS w, sum(greatest(1, ceil(({WIDTH.format('d')}) / 7.0))) AS v
FROM (SELECT row_group, ts, ts - lag(ts) OVER w AS inner_d, ts - coalesce(lag(ts) OVER w, 0) AS d FROM {EVG} WINDOW w AS (PARTITION BY row_group ORDER BY row_index)) GROUP BY row_group),
o AS (SELECT row_group, unnest(['delta_bitpack', 'bitpack', 'delta_varint_u64', 'stored']) AS codec, unnest([0, 1, 2, 3]) AS rank, unnest([CAST(ceil(n * dw / 8.0) AS BIGINT) + 17, CAST(ceil(n * w / 8.0) AS BIGINT) + 9, CAST(v AS BIGINT) + 8, 8 * n + 8]) AS size FROM s)
SELECT row_group, codec, size AS encoded_size FROM (SELECT *, row_number() OVER (PARTITION BY row_group ORDER BY size, rank) AS k FROM o) WHERE k = 1"""
)
def auto_codec(spark, sf_dir):
    return C.auto_codec(C.number_sizes(grouped(spark, sf_dir), "ts"), "u64")


# The event types are ASCII and shorter than 128 bytes, as the SQL of their byte streams takes for granted.
STREAM = f"""(SELECT row_group, row_index, k, CASE WHEN k = 0 THEN strlen(event_type) ELSE ascii(substr(event_type, k, 1)) END AS octet
FROM (SELECT row_group, row_index, event_type, unnest(range(0, strlen(event_type) + 1)) AS k FROM {EVG}))"""
RUNS = f"""(SELECT row_group, run, octet, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY row_group ORDER BY row_index, k) AS run
FROM (SELECT *, CASE WHEN octet = lag(octet) OVER (PARTITION BY row_group ORDER BY row_index, k) THEN 0 ELSE 1 END AS fresh FROM {STREAM})) GROUP BY row_group, run, octet)"""
ENTRIES = f"(SELECT row_group, event_type, n, row_number() OVER (PARTITION BY row_group ORDER BY f) - 1 AS id FROM (SELECT row_group, event_type, min(row_index) AS f, count(*) AS n FROM {EVG} GROUP BY ALL))"


@query(
    f"""WITH p AS (SELECT row_group, event_type AS v, lag(event_type) OVER (PARTITION BY row_group ORDER BY row_index) AS b FROM {EVG}),
q AS (SELECT row_group, strlen(v) AS size, CASE WHEN b IS NULL THEN 0 ELSE coalesce(len(list_filter(range(1, least(strlen(b), strlen(v)) + 1), lambda i: substr(b, 1, i) = substr(v, 1, i))), 0) END AS shared FROM p),
a AS (SELECT row_group, count(*) AS value_count, CAST(sum(1 + size) AS BIGINT) AS stored, CAST(sum(2 + size - shared) AS BIGINT) AS prefix FROM q GROUP BY row_group),
d AS (SELECT row_group, CAST(1 + sum(1 + strlen(event_type) + n) AS BIGINT) AS dictionary FROM {ENTRIES} GROUP BY row_group),
r AS (SELECT row_group, CAST(sum(2 * ceil(n / 255.0)) AS BIGINT) AS rle FROM {RUNS} GROUP BY row_group)
SELECT * FROM a JOIN d USING (row_group) JOIN r USING (row_group)"""
)
def string_codec_sizes(spark, sf_dir):
    return C.string_sizes(grouped(spark, sf_dir), "event_type")


PAYLOADS = (("ts", "u64", "delta_bitpack"), ("event_type", "string", "dictionary"), ("event_type", "string", "rle"), ("active", "bool", "bitmap"))


def _packed(width: str, value: str, rows: str) -> str:
    """row_group, octets, n: values of ``width`` bits, lowest bit first, in bytes."""
    bits = f"SELECT row_group, n, i * w + j AS spot, (v >> CAST(j AS INT)) & 1 AS bit FROM (SELECT row_group, n, i, w, v, unnest(range(0, w)) AS j FROM (SELECT row_group, n, i, {width} AS w, {value} AS v FROM {rows}))"
    octets = f"SELECT row_group, n, CAST(floor(spot / 8) AS BIGINT) AS place, CAST(sum(bit << CAST(spot % 8 AS INT)) AS BIGINT) AS octet FROM ({bits}) GROUP BY ALL"
    return f"SELECT row_group, n, list(octet ORDER BY place) AS octets FROM ({octets}) GROUP BY row_group, n"


TS = f"""(SELECT row_group, i, v, count(*) OVER g AS n, length(bin(max(v) OVER g)) AS w FROM (SELECT row_group, row_index % {GROUP} AS i, coalesce(ts - lag(ts) OVER (PARTITION BY row_group ORDER BY row_index), 0) AS v FROM {EVG}) WINDOW g AS (PARTITION BY row_group))"""
FLAGS = f"(SELECT row_group, row_index % {GROUP} AS i, CAST(active AS BIGINT) AS v, count(*) OVER (PARTITION BY row_group) AS n FROM {EVG})"


@query(
    f"""WITH ts AS ({_packed('w', 'v', TS)}), active AS ({_packed('CAST(1 AS BIGINT)', 'v', FLAGS)}), e AS (SELECT * FROM {ENTRIES}),
names AS (SELECT row_group, count(*) AS entries, flatten(list(list_prepend(CAST(strlen(event_type) AS BIGINT), list_transform(string_split(event_type, ''), lambda c: CAST(ascii(c) AS BIGINT))) ORDER BY id)) AS octets FROM e GROUP BY row_group),
ids AS (SELECT row_group, count(*) AS n, list(CAST(id AS BIGINT) ORDER BY row_index) AS octets FROM {EVG} JOIN e USING (row_group, event_type) GROUP BY row_group),
dictionary AS (SELECT row_group, ids.n, flatten([[CAST(entries AS BIGINT)], names.octets, ids.octets]) AS octets FROM names JOIN ids USING (row_group)),
rle AS (SELECT row_group, flatten(list([CAST(n AS BIGINT), CAST(octet AS BIGINT)] ORDER BY run)) AS octets FROM {RUNS} GROUP BY row_group),
u AS (SELECT 'ts' AS name, row_group, n, octets FROM ts UNION ALL SELECT 'active', row_group, n, octets FROM active UNION ALL SELECT 'event_type', row_group, n, octets FROM dictionary
UNION ALL SELECT 'event_type', row_group, ids.n, rle.octets FROM rle JOIN ids USING (row_group))
SELECT name AS "column", row_group, n AS count, CAST(len(octets) AS INT) AS bytes, {crc_sql('octets')} AS crc FROM u"""
)
def column_payloads(spark, sf_dir):
    """Sound SQL for runs of fewer than 256 equal bytes."""
    parts = [C.encode_column(grouped(spark, sf_dir), c, k, codec).select(F.lit(c).alias("column"), "row_group", "count", F.octet_length("payload").alias("bytes"), F.crc32("payload").alias("crc")) for c, k, codec in PAYLOADS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    f"""WITH c AS (SELECT c_custkey, k, ascii(substr(c_name, k, 1)) AS octet FROM (SELECT c_custkey, c_name, unnest(range(1, length(c_name) + 1)) AS k FROM customer)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY c_custkey ORDER BY k) AS run FROM (SELECT *, CASE WHEN octet = lag(octet) OVER (PARTITION BY c_custkey ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM c)),
p AS (SELECT c_custkey, flatten(list([n, CAST(octet AS BIGINT)] ORDER BY run)) AS octets FROM (SELECT c_custkey, run, octet, count(*) AS n FROM r GROUP BY ALL) GROUP BY c_custkey)
SELECT c_custkey, '434D50310101' || printf('%02X', len(octets)) || '00000000000000' AS head, {crc_sql('octets')} AS crc, c_name AS content FROM p JOIN customer USING (c_custkey)"""
)
def raw_frames(spark, sf_dir):
    """Names as run-length coded payloads in frames, and read out of them again."""
    framed = table(spark, sf_dir, "customer").select("c_custkey", frames.frame("rle", frames.rle_payload(F.encode("c_name", "UTF-8"))).alias("frame"))
    digits = F.hex("frame")
    crc = F.conv(F.concat(*(F.substring(digits, 29 + 2 * i, 2) for i in (3, 2, 1, 0))), 16, 10).cast("long")
    return framed.select("c_custkey", F.substring(digits, 1, 28).alias("head"), crc.alias("crc"), F.decode(frames.rle_content(frames.unframe("rle", F.col("frame"))), "UTF-8").alias("content"))


@query(f"SELECT row_group, CAST(ceil(count(*) * length(bin(max(user_id))) / 8.0) AS BIGINT) / CAST(8 * count(*) AS DOUBLE) AS ratio FROM {EVG} GROUP BY row_group")
def compression_ratio(spark, sf_dir):
    sizes = C.number_sizes(grouped(spark, sf_dir), "user_id")
    return sizes.select("row_group", stats.compression_ratio(F.col("bitpack"), F.col("stored")).alias("ratio"))


# search

TOKENS = "(SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS position FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\t\\r\\n]+') AS w FROM documents))"
POSTINGS = f"(SELECT term, doc_id, list_sort(list(position)) AS positions FROM {TOKENS} WHERE term <> '' GROUP BY term, doc_id)"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_postings(table(spark, sf_dir, "documents"))


@query(f"SELECT * FROM {POSTINGS}")
def postings_build(spark, sf_dir):
    return postings(spark, sf_dir)


@query(f"SELECT term, count(*) AS doc_count, CAST(sum(len(positions)) AS BIGINT) AS frequency FROM {POSTINGS} GROUP BY term")
def dictionary_index(spark, sf_dir):
    return search.dictionary(postings(spark, sf_dir))


@query(f"SELECT doc_id FROM {POSTINGS} WHERE term = 'the'")
def term_docs(spark, sf_dir):
    return search.term_docs(postings(spark, sf_dir), "the")


@query(f"SELECT doc_id FROM {POSTINGS} WHERE term IN ('the', 'of', 'in') GROUP BY doc_id HAVING count(*) = 3")
def and_docs(spark, sf_dir):
    return search.and_docs(postings(spark, sf_dir), ["the", "of", "in", "of"])


@query(f"SELECT a.doc_id FROM {POSTINGS} a JOIN {POSTINGS} b USING (doc_id) WHERE a.term = 'of' AND b.term = 'the' AND len(list_intersect(list_transform(a.positions, lambda x: x + 1), b.positions)) > 0")
def phrase_docs(spark, sf_dir):
    return search.phrase_docs(postings(spark, sf_dir), "of", "the")


@query(f"SELECT doc_id, CAST(sum(len(positions) * CASE term WHEN 'the' THEN 2 ELSE 1 END) AS BIGINT) AS score FROM {POSTINGS} WHERE term IN ('the', 'of') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def topk_tf(spark, sf_dir):
    return search.topk_frequency(postings(spark, sf_dir), ["the", "of", "the"], 10)


@query(f"SELECT (SELECT count(*) > 0 FROM {POSTINGS} WHERE term = 'the' AND doc_id = 5) AS found")
def contains_doc(spark, sf_dir):
    return search.seek_doc(postings(spark, sf_dir), "the", 5).agg((F.count(F.lit(1)) > 0).alias("found"))


@query(f"SELECT doc_id, positions FROM {POSTINGS} WHERE term = 'the' AND doc_id = 7")
def seek_doc(spark, sf_dir):
    return search.seek_doc(postings(spark, sf_dir), "the", 7)


VARINT = f"greatest(1, ceil(({WIDTH}) / 7.0))"


@query(
    f"""WITH g AS (SELECT term, doc_id, position - coalesce(lag(position) OVER (PARTITION BY term, doc_id ORDER BY position), 0) AS gap FROM {TOKENS} WHERE term <> ''),
n AS (SELECT term, doc_id, count(*) AS n, sum({VARINT.format('gap')}) AS size FROM g GROUP BY term, doc_id),
b AS (SELECT *, row_number() OVER w - 1 AS ordinal, coalesce(lag(doc_id) OVER w, 0) AS previous_doc_id FROM n WINDOW w AS (PARTITION BY term ORDER BY doc_id)),
z AS (SELECT *, size + {VARINT.format('n')} + {VARINT.format('(doc_id - previous_doc_id)')} AS whole FROM b)
SELECT term, ordinal, first_doc_id, previous_doc_id, "offset" FROM (SELECT term, ordinal, doc_id AS first_doc_id, previous_doc_id, CAST(coalesce(sum(whole) OVER (PARTITION BY term ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM z) WHERE ordinal % 16 = 0"""
)
def skip_table(spark, sf_dir):
    return search.skip_table(postings(spark, sf_dir), 16)


@query(f"SELECT CASE WHEN doc_id % 50 = 7 THEN '' ELSE term END AS term, doc_id, CASE WHEN doc_id % 50 = 3 THEN list_reverse(positions) ELSE positions END AS positions FROM {POSTINGS} WHERE doc_id % 50 = 7 OR (doc_id % 50 = 3 AND len(positions) > 1)")
def posting_faults_found(spark, sf_dir):
    """An index with terms lost in some documents and positions out of order in others."""
    p = postings(spark, sf_dir)
    term = F.when(F.col("doc_id") % 50 == 7, F.lit("")).otherwise(F.col("term")).alias("term")
    positions = F.when(F.col("doc_id") % 50 == 3, F.reverse("positions")).otherwise(F.col("positions")).alias("positions")
    return search.check_postings(p.select(term, "doc_id", positions))


@query(f"SELECT term, doc_id, positions FROM {POSTINGS} WHERE false")
def posting_faults(spark, sf_dir):
    return search.check_postings(postings(spark, sf_dir))


@query("SELECT p_name AS term, p_partkey AS doc_id, [CAST(p_size AS BIGINT), CAST(p_size AS BIGINT) + 3] AS positions FROM (SELECT regexp_replace(p_name, '\\s+', '_', 'g') AS p_name, p_partkey, p_size FROM part)")
def postings_text(spark, sf_dir):
    from ..sources.postings import parse_postings

    p = table(spark, sf_dir, "part")
    lines = p.select(F.concat_ws(" ", F.regexp_replace("p_name", r"\s+", "_"), "p_partkey", F.concat_ws(",", "p_size", F.col("p_size") + 3)).alias("value"))
    return parse_postings(lines.unionByName(spark.createDataFrame([("# comment",), ("",)], "value string")))


# evolution

WRITER = V.Revision(1, (V.EvolvedColumn(1, "event_id", "u64"), V.EvolvedColumn(2, "svc", "string", nullable=True), V.EvolvedColumn(3, "active", "bool")))
READER = V.Revision(2, (V.EvolvedColumn(1, "id", "u64", aliases=("event_id",)), V.EvolvedColumn(3, "active", "bool"), V.EvolvedColumn(4, "checked", "bool", default=True), V.EvolvedColumn(5, "region", "string", nullable=True)))
STRICT = V.Revision(2, (V.EvolvedColumn(1, "event_id", "string"), V.EvolvedColumn(2, "svc", "string"), V.EvolvedColumn(6, "needed", "bool")))


@query(f"SELECT event_id AS id, active, true AS checked, CAST(NULL AS VARCHAR) AS region FROM {EV}")
def evolve_rows(spark, sf_dir):
    return V.evolve(events(spark, sf_dir).select("event_id", "svc", "active"), WRITER, READER)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'event_id', 'event_id', 'ValueTypeChanged'), (2, 'svc', 'svc', 'NullabilityTightened'), (3, 'active', NULL, 'Drop'), (6, NULL, 'needed', 'RequiredColumnAddedWithoutDefault')) AS t(stable_id, writer_name, reader_name, outcome)")
def evolve_assess(spark, sf_dir):
    return V.assess_table(spark, WRITER, STRICT)


OLDER = V.Revision(1, (V.EvolvedColumn(1, "event_id", "u64"), V.EvolvedColumn(2, "svc", "u64"), V.EvolvedColumn(7, "note", "string", nullable=True)))
NEWER = V.Revision(2, WRITER.columns)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'event_id', 'event_id', 'Read'), (2, 'svc', 'svc', 'ValueTypeChanged'), (2, 'svc', 'svc', 'NullabilityTightened'), (3, 'active', NULL, 'Drop'), (7, NULL, 'note', 'FillNull'), (NULL, NULL, NULL, 'ReaderRevisionIsOlder')) AS t(stable_id, writer_name, reader_name, outcome)")
def evolve_assess_issues(spark, sf_dir):
    """An older reader, and a column with two issues."""
    return V.assess_table(spark, NEWER, OLDER)
