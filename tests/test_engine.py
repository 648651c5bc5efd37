import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowloom.functions import codecs
from rowloom.operators import evolution, layout, scan, search, stats, storage
from rowloom.schema import dump_yaml, load_yaml, parse_schema
from rowloom.sources import jsonl
from rowloom.sources.postings import parse_postings
from rowloom.streaming import append

SCHEMA = """columns:
  - name: id
    type: u64
    codec: delta_bitpack
  - name: active
    type: bool
    codec: bitmap
  - name: service
    type: string
    codec: prefix
    nullable: true
"""


@pytest.fixture(scope="module")
def log(spark):
    rows = [(0, 1, True, "api"), (1, 2, False, "api"), (2, 10, True, None), (3, 11, False, "worker")]
    return layout.with_group(spark.createDataFrame(rows, "row_index long, id long, active boolean, service string"), 2)


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row_index long, value string")


# schemas and JSON lines


def test_schema():
    s = parse_schema(SCHEMA).check_groups()
    assert [c.name for c in s.columns] == ["id", "active", "service"] and s.column("service").nullable
    for bad in (SCHEMA.replace("nullable", "nullabe"), SCHEMA.replace("name: active", "name: id"), SCHEMA.replace("name: id", "name: ''"), "columns: []", SCHEMA.replace("type: u64", "type: f64")):
        with pytest.raises(ValueError):
            parse_schema(bad)
    with pytest.raises(ValueError, match="schema column codec"):
        s.check_stream()
    with pytest.raises(ValueError, match="no such codec"):
        parse_schema(SCHEMA.replace("codec: bitmap", "codec: prefix")).check_groups()


def test_simple_yaml():
    from rowloom.schema import _simple_yaml

    assert _simple_yaml(SCHEMA) == load_yaml(SCHEMA)
    assert load_yaml(dump_yaml(load_yaml(SCHEMA))) == load_yaml(SCHEMA) == _simple_yaml(dump_yaml(load_yaml(SCHEMA)))


def test_parse_lines(spark):
    s = parse_schema(SCHEMA)
    got = jsonl.parse_lines(lines(spark, '{"id":1,"active":true,"service":"a\\"é","other":[1]}', "", '  {"service":null,"active":false,"id":2}\r', '{"id":3,"active":true}'), s).orderBy("row_index").collect()
    assert [tuple(r)[1:] for r in got] == [(1, True, 'a"é'), (2, False, None), (3, True, None)]
    out = spark.createDataFrame([(1, None)], "a long, b string").select(jsonl.render(["b", "a"]).alias("l")).first().l
    assert out == '{"b":null,"a":1}'


@pytest.mark.parametrize(
    ("line", "message"),
    [
        ('{"active":true}', "lacks the column"), ('{"id":-1,"active":true}', "is no u64"), ('{"id":1.0,"active":true}', "is no u64"), ('{"id":"5","active":true}', "is no u64"),
        ('{"id":null,"active":true}', "is no u64"), ('{"id":1,"active":1}', "is no bool"), ('{"id":1,"active":true,"service":1}', "is no string"), ("{bad json}", "no JSON object"), ("[1]", "no JSON object"),
    ],
)
def test_parse_rejects(spark, line, message):
    with pytest.raises(PySparkException, match=message):
        jsonl.parse_lines(lines(spark, line), parse_schema(SCHEMA)).collect()
    with pytest.raises(PySparkException, match=message):
        jsonl.parse_lines(lines(spark, line), parse_schema(SCHEMA)).count()


# scans


def test_scan_golden(log):
    ids = lambda r: sorted(x.id for x in r.rows.collect())
    r = scan.scan_groups(log, ["id"], scan.Predicate("id", "ge", 10))
    assert (ids(r), r.row_groups_scanned, r.row_groups_pruned) == ([10, 11], 1, 1)
    r = scan.scan_groups(log, ["id", "service"], scan.Predicate("service", "is_null"))
    assert ([tuple(x) for x in r.rows.collect()], r.row_groups_scanned, r.row_groups_pruned) == ([(10, None)], 1, 1)
    r = scan.scan_groups(log)
    assert r.rows.columns == ["id", "active", "service"] and r.row_groups_scanned == 2
    assert scan.scan_groups(log, ["service", "id"]).rows.columns == ["service", "id"]


def test_scan_errors(log):
    for names in (["missing"], ["id", "id"]):
        with pytest.raises(ValueError):
            scan.scan(log, names)
    with pytest.raises(ValueError):
        scan.scan(log, ["id"], scan.Predicate("service", "ge", 1))
    with pytest.raises(ValueError):
        scan.scan(log, ["id"], scan.Predicate("gone", "is_null"))
    with pytest.raises(ValueError, match="at least one row"):
        layout.with_group(log, 0)
    assert scan.parse_projection(" a, ,b ") == ["a", "b"] and scan.parse_projection(None) == []
    assert scan.parse_predicate("a", "is-null", None) == scan.Predicate("a", "is_null") and scan.parse_predicate(None, None, None) is None
    for bad in (("a", None, "1"), ("a", "eq", None), ("a", "is-null", "1"), ("a", "eq", "-1")):
        with pytest.raises(ValueError):
            scan.parse_predicate(*bad)


def test_all_null_group_is_scanned(spark):
    df = layout.with_group(spark.createDataFrame([(0, None), (1, None), (2, 5), (3, 6)], "row_index long, v long"), 2)
    r = scan.scan_groups(df, ["v"], scan.Predicate("v", "ge", 6))
    assert ([x.v for x in r.rows.collect()], r.row_groups_scanned, r.row_groups_pruned) == ([6], 2, 0)


def test_push_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS w").write.parquet(f"{tmp_path}/t")
    plan = scan.scan(spark.read.parquet(f"{tmp_path}/t"), ["id"], scan.Predicate("v", "ge", 10))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,10)" in plan and "w:string" not in plan


def test_footer_and_stats(log):
    assert sorted(map(tuple, stats.footer(log).collect())) == [(0, 0, 2), (1, 2, 2)]
    assert stats.inspect_file(log).first()[:3] == (4, 2, 3)
    found = {(r.row_group, r.column): r for r in stats.column_stats(log).collect()}
    assert found[1, "id"][2:6] == (2, 0, 10, 11) and found[0, "active"].true_count == 1 and found[1, "service"][3] == 1 and found[0, "service"].distinct_count == 1
    stored = stats.column_stats(log)
    assert stats.mismatches(stored, log).isEmpty() and stats.check_shape(stored, dict(log.dtypes)).isEmpty()
    assert not stats.mismatches(stored, log.withColumn("id", F.col("id") + 1)).isEmpty()
    groups = stats.footer(log)
    assert [scan.find_row_group(groups, n).count() for n in (0, 3, 4)] == [1, 1, 0]


# layout and streams


def test_row_index(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    assert all(r.row_index == r.k for r in layout.with_row_index(df, "k").collect())
    assert sorted(r.row_index for r in layout.with_row_index(df).collect()) == list(range(1000))


def sized(spark, *sizes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "row_index long, n_bytes long")


def test_block_cutting(spark):
    cut = lambda df, **k: [r.block_index for r in layout.cut_blocks(df, **k).orderBy("row_index").collect()]
    assert cut(sized(spark, 12, 12, 12), max_rows=2) == [0, 0, 1]
    assert cut(sized(spark, 11, 11), max_bytes=21) == [0, 1]
    assert cut(sized(spark, 5, 5, 20, 1), max_bytes=20) == [0, 0, 1, 2]
    with pytest.raises(PySparkException, match="more bytes than a block"):
        cut(sized(spark, 22), max_bytes=21)


def test_rolling(spark):
    blocks = spark.createDataFrame([(i, 10) for i in range(5)], "block_index long, n_bytes long")
    roll = lambda **k: [r.segment_id for r in layout.roll_segments(blocks, **k).orderBy("block_index").collect()]
    assert roll(max_blocks=2) == [0, 0, 1, 1, 2] and roll(max_bytes=15) == [0, 0, 1, 1, 2]


def test_append_and_replay(spark, tmp_path):
    batch = lambda *ts: spark.createDataFrame([(t,) for t in ts], "ts long")
    path = f"{tmp_path}/log"
    assert append.append_to(spark, path, batch(100, 101), "ts") == 0 and append.append_to(spark, path, batch(102), "ts") == 2
    assert [tuple(r) for r in append.replay(spark.read.parquet(path)).select("row_index", "ts").collect()] == [(0, 100), (1, 101), (2, 102)]


def test_structured_streaming(spark, tmp_path):
    schema = parse_schema(SCHEMA)
    (tmp_path / "in").mkdir()
    run = lambda: append.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "in" / "a.json").write_text('{"id":1,"active":true}\n\n{"id":2,"active":false,"service":"x"}\n')
    run()
    (tmp_path / "in" / "b.json").write_text('{"id":3,"active":true}\n')
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_snapshot(spark):
    data = append.encode_snapshot(42, b"aaaaaaaaabbbbbbbbb")
    assert append.decode_snapshot(data) == (42, b"aaaaaaaaabbbbbbbbb")
    for bad in (data[:-1] + b"x", data[:20], b"XXXX" + data[4:]):
        with pytest.raises(ValueError):
            append.decode_snapshot(bad)
    table = append.snapshots(spark.createDataFrame([(1, bytearray(b"state"))], "checkpoint_id long, state binary"))
    assert append.verify_snapshots(table).isEmpty() and not append.verify_snapshots(table.withColumn("crc", F.lit(1))).isEmpty()


# storage


def blocks(spark, bad=(), missing=()):
    rows = [(i, i, 1, 10, i not in bad) for i in range(5) if i not in missing]
    return spark.createDataFrame(rows, "block_index long, first_row long, row_count long, raw_size long, valid boolean")


@pytest.mark.parametrize("k", range(5))
def test_recovery_stops_at_the_first_fault(spark, k):
    r = storage.recovery(blocks(spark, bad=(k,))).first()
    assert (r.blocks, r.rows, r.corrupt_tail) == (k, k, True)
    assert storage.recover_prefix(blocks(spark, missing=(k,))).count() == k


def test_repair(spark, tmp_path):
    sound, broken = blocks(spark), blocks(spark, bad=(3,))
    assert [storage.repair_plan(b, f).first().action for b, f in ((sound, True), (sound, False), (broken, True))] == ["None", "RebuildFooter", "TruncateTailAndRebuildFooter"]
    plan = storage.repair_plan(broken, True)
    storage.repair(broken, plan, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 3
    with pytest.raises(ValueError, match="changed since the plan"):
        storage.repair(sound, plan, f"{tmp_path}/s")
    with pytest.raises(PySparkException):
        storage.repair(broken, plan, f"{tmp_path}/r")


def test_stored_tables(spark, tmp_path):
    """A changed row, a lost block, a lost footer, and a repair bound to the content."""
    rows = spark.range(40).selectExpr("id AS row_index", "id DIV 10 AS row_group", "concat('v', id) AS v", "IF(id % 3 = 0, NULL, id) AS n")
    good, bad, gone = (f"{tmp_path}/{x}" for x in ("good", "bad", "gone"))
    storage.store(rows, good)
    assert spark.read.parquet(good).count() == 40
    blocks, has_footer = storage.stored_blocks(spark, good)
    assert has_footer and storage.validate(blocks).first().sound and storage.repair_plan(blocks, True).first().action == "None"
    for path, changed in ((bad, rows.withColumn("v", F.when(F.col("row_index") == 25, F.lit("other")).otherwise(F.col("v")))), (gone, rows.where("row_group <> 1"))):
        changed.write.parquet(path)
        spark.read.parquet(f"{good}/_footer").write.parquet(f"{path}/_footer")
    found = storage.stored_blocks(spark, bad)
    assert [r.valid for r in found[0].orderBy("block_index").collect()] == [True, True, False, True]
    plan = storage.repair_plan(*found, crc="crc")
    assert plan.first().action == "TruncateTailAndRebuildFooter" and plan.first().rows == 20
    storage.repair_stored(spark, bad, plan, f"{tmp_path}/fixed")
    assert [r.row_index for r in spark.read.parquet(f"{tmp_path}/fixed").orderBy("row_index").collect()] == list(range(20))
    assert storage.validate(storage.stored_blocks(spark, f"{tmp_path}/fixed")[0]).first().sound
    with pytest.raises(ValueError, match="changed since the plan"):
        storage.repair_stored(spark, gone, plan, f"{tmp_path}/no")
    report = storage.validate(storage.stored_blocks(spark, gone)[0]).first()
    assert (report.bad_checksums, report.empty_blocks, report.sound) == (1, 1, False)
    rows.write.parquet(f"{tmp_path}/bare")
    assert storage.repair_plan(*storage.stored_blocks(spark, f"{tmp_path}/bare")).first().action == "RebuildFooter"


def test_row_index_tasks(spark):
    """Wide rows that compress well are sorted in as many tasks as their bytes need."""
    wide = spark.range(40_000).select(F.col("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 160).alias("wide"), F.array(F.lit(None).cast("string")).alias("more"))
    got = layout.with_row_index(wide, "k")
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) >= 5 and max(parts) <= 12_000
    assert got.where("k = row_index").count() == 40_000


def test_row_index_of_wide_rows(spark):
    """At Spark's default partition count, where small partitions are joined by size: the key alone and whole rows differ."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        wide = spark.range(20_000).selectExpr("xxhash64(id) AS k", "repeat(sha2(string(id), 512), 8) AS wide")
        got = layout.with_row_index(wide, "k")
        numbers = [r.row_index for r in got.orderBy("k").select("row_index").collect()]
        assert numbers == list(range(20_000)) and got.where("row_index IS NULL OR wide IS NULL").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_validate(spark):
    assert storage.validate(blocks(spark)).first().sound and not storage.validate(blocks(spark, missing=(2,))).first().sound
    groups = spark.createDataFrame([(0, 0, 2), (1, 2, 2)], "row_group long, first_row long, row_count long")
    assert storage.check_footer(groups, total_rows=4).isEmpty() and storage.check_footer(groups, total_rows=5).count() == 1
    assert storage.check_footer(groups.withColumn("first_row", F.lit(0).cast("long"))).count() == 1
    payload = spark.createDataFrame([(bytearray(b"123456789"), 0xCBF43926), (bytearray(b"x"), 1)], "payload binary, crc long")
    assert [r.valid for r in storage.mark_valid(payload).collect()] == [True, False]


def test_formats(spark, tmp_path):
    for name, data in (("a", b"CMP1.."), ("b", b"CMP4.."), ("c", b"else"), ("d", b"CM")):
        (tmp_path / name).write_bytes(data)
    assert {r.path[-1]: r.format_version for r in storage.detect_files(spark, str(tmp_path)).collect()} == {"a": 1, "b": 4, "c": None, "d": None}
    assert storage.negotiate(storage.detect(b"CMP3")) == 3
    for f in (lambda: storage.detect(b"nope"), lambda: storage.negotiate(4, 1, 3)):
        with pytest.raises(ValueError):
            f()


def test_string_sizes_tasks(spark, monkeypatch):
    """Groups are dealt over as many tasks as their bytes need, however well they compress, and only once."""
    monkeypatch.setattr(codecs, "TASK_OCTETS", 10_000, raising=False)
    df = spark.range(20_000).selectExpr("id AS row_index", "id DIV 100 AS row_group", "IF(id % 7 = 0, NULL, concat('aa', id % 3)) AS v")
    sizes = codecs.string_sizes(df, "v")
    rows = sizes.collect()
    assert len(rows) == 200 and sum(r.value_count for r in rows) == 17_142
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert sizes.rdd.getNumPartitions() >= 7


# search


@pytest.fixture(scope="module")
def index(spark):
    return parse_postings(spark.createDataFrame([(x,) for x in ("# terms", "brown 1 1", "brown 3 4,8", "fox 1 2,9", "fox 2 1", "fox 3 5", "quick 1 0", "ghost 2 -")], "value string")).cache()


def test_search_golden(index):
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(search.term_docs(index, "fox")) == [1, 2, 3] and ids(search.term_docs(index, "missing")) == []
    assert ids(search.and_docs(index, ["brown", "fox"])) == [1, 3] and ids(search.and_docs(index, ["quick", "fox", "brown"])) == [1]
    assert ids(search.and_docs(index, ["quick", "missing"])) == [] and ids(search.and_docs(index, [])) == [] and ids(search.and_docs(index, ["ghost"])) == [2]
    assert [search.has_adjacent_phrase(index, *p) for p in (("quick", "brown", 1), ("brown", "fox", 3), ("fox", "brown", 1))] == [True, True, False]
    assert [tuple(r) for r in search.topk_frequency(index, ["brown", "fox"], 2).collect()] == [(1, 3), (3, 3)]
    assert [tuple(r) for r in search.topk_frequency(index, ["quick", "quick", "ghost"], 5).collect()] == [(1, 2)]
    assert search.topk_frequency(index, ["fox"], 0).collect() == [] and search.topk_frequency(index, [], 3).collect() == []
    assert search.contains_doc(index, "fox", 3) and not search.contains_doc(index, "fox", 4) and not search.contains_doc(index, "missing", 3)
    assert search.seek_doc(index, "fox", 1).first().positions == [2, 9]
    assert search.check_postings(index).isEmpty() and search.has_position_gap([1], [2]) and not search.has_position_gap([2], [1])


def test_skip_table(spark):
    rows = [("t", 1, [0, 8, 12]), ("t", 3, [2]), ("t", 10, [1, 9]), ("t", 15, []), ("t", 30, [4, 64, 1024])]
    got = search.skip_table(spark.createDataFrame(rows, "term string, doc_id long, positions array<long>"), 2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.first_doc_id, r.previous_doc_id, r.offset) for r in got] == [(0, 1, 0, 0), (2, 10, 3, 8), (4, 30, 15, 14)]
    with pytest.raises(ValueError):
        search.skip_table(spark.createDataFrame(rows, "term string, doc_id long, positions array<long>"), 0)


DOCS = [(1, "a b a\tb  c"), (2, " lead and tail \n"), (3, ""), (4, None), (5, "é 漢 é a"), (None, "no id no"), (7, "x " * 500)]


@pytest.mark.parametrize("more", [[], [(1, "b of another row"), (None, "no")]])
def test_document_postings(spark, more):
    """As the tokens grouped; documents of one row are not shuffled."""
    docs = spark.createDataFrame(DOCS + more, "doc_id long, text string")
    got, want = search.document_postings(docs), search.build_postings(search.tokenize(docs))
    assert got.dtypes == want.dtypes
    rows = lambda df: sorted((r.term, r.doc_id or 0, r.positions) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 10
    assert more or "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [10, 0])
def test_posting_faults_shuffle(spark, monkeypatch, most):
    """Repeated postings are found, and no positions but those of rows that may be faulty are shuffled."""
    monkeypatch.setattr(search, "SENT_HASHES", most)
    rows = [("a", 1, [0, 2]), ("a", 1, [5]), ("a", 2, [1]), ("", 2, [0]), ("b", 2, [3, 1]), ("b", 3, [4, 4]), ("c", 3, []), ("c", None, [1]), ("c", None, [2])]
    index = spark.createDataFrame(rows, "term string, doc_id long, positions array<long>")
    faults = search.check_postings(index)
    assert sorted((r.term, r.doc_id or 0, r.positions) for r in faults.collect()) == [("", 2, [0]), ("a", 1, [0, 2]), ("a", 1, [5]), ("b", 2, [3, 1]), ("b", 3, [4, 4]), ("c", 0, [1]), ("c", 0, [2])]
    assert not most or "_again" in faults._jdf.queryExecution().optimizedPlan().toString().split("Window")[1]


def test_skip_table_shuffle(spark):
    """The window reads sizes, not positions."""
    index = spark.createDataFrame([("t", 1, [0, 8, 12])], "term string, doc_id long, positions array<long>")
    plan = search.skip_table(index, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "positions" not in plan.split("Exchange")[0]


@pytest.mark.parametrize("line", ["fox 1", "fox x 1", "fox 1 1,,2", "fox 1 -1"])
def test_postings_reject(spark, line):
    with pytest.raises(PySparkException, match="invalid posting"):
        parse_postings(spark.createDataFrame([(line,)], "value string")).collect()


def test_index_files(spark, index, tmp_path):
    search.write_index(index, f"{tmp_path}/i")
    assert search.dictionary(spark.read.parquet(f"{tmp_path}/i")).where("term = 'fox'").first()[1:] == (3, 4)


# evolution


def column(i, name, kind="u64", **k):
    return evolution.EvolvedColumn(i, name, kind, **k)


def test_evolution(spark):
    w = evolution.Revision(1, (column(1, "id"), column(2, "service", "string", nullable=True)))
    r = evolution.Revision(2, (column(1, "event_id", aliases=("id",)), column(3, "active", "bool", default=True), column(4, "region", "string", nullable=True)))
    rows = spark.createDataFrame([(1, "api"), (2, None)], "id long, service string")
    assert [tuple(x) for x in evolution.evolve(rows, w, r).collect()] == [(1, True, None), (2, True, None)]
    assert [a[0] for a in evolution.assess(w, r).actions] == ["Read", "FillDefault", "FillNull", "Drop"]
    bad = evolution.Revision(2, (column(1, "id", "string"), column(2, "service", "string"), column(3, "new", "bool")))
    assert evolution.assess(w, bad).issues == [("ValueTypeChanged", 1), ("NullabilityTightened", 2), ("RequiredColumnAddedWithoutDefault", 3)]
    assert evolution.assess(r, w).issues[0] == ("ReaderRevisionIsOlder", None)
    with pytest.raises(ValueError):
        evolution.evolve(rows, w, bad)
    for columns in ((), (column(0, "a"),), (column(1, "a"), column(1, "b")), (column(1, "a"), column(2, "b", aliases=("a",))), (column(1, "a", default="x"),)):
        with pytest.raises(ValueError):
            evolution.Revision(1, columns)


def test_migration():
    v1 = "metadata_version: 1\nowner: ops\ncolumns:\n- name: id\n  type: u64\n  logical_role: key\n- name: service\n  type: string\n"
    v2 = evolution.migrate_metadata(v1, {"id": 10, "service": 20})
    data = load_yaml(v2)
    assert data["metadata_version"] == 2 and data["owner"] == "ops" and [c["stable_id"] for c in data["columns"]] == [10, 20] and data["columns"][0]["logical_role"] == "key"
    assert evolution.migrate_metadata(v2) == v2
    for text, given in ((v1, {"id": 1}), (v1, {"id": 1, "service": 1}), (v1, {"id": 1, "service": 2, "x": 3}), (v2, {"id": 1})):
        with pytest.raises(ValueError):
            evolution.migrate_metadata(text, given)
