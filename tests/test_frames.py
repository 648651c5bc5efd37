import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowloom.functions import codecs as C
from rowloom.functions import frames
from rowloom.operators import evolution
from rowloom.streaming import append


@pytest.mark.parametrize("data", [b"", b"aaab", bytes(range(256)) * 3])
def test_byte_frames(data):
    assert frames.decode_bytes(frames.encode_bytes(data)) == data


def test_number_frames():
    values = [0, 5, 5, (1 << 64) - 1]
    frame = frames.encode_numbers(values)
    assert frames.decode_numbers(frame) == values and frame[:6] == b"CMP1\x01\x02"
    with pytest.raises(ValueError):
        frames.decode_bytes(frame)


@pytest.mark.parametrize("at", [0, 4, 5, 6, 14, 18, 19])
def test_damaged_frames(at):
    data = bytearray(frames.encode_bytes(b"hello hello"))
    data[at] ^= 0xFF
    with pytest.raises(ValueError):
        frames.decode_bytes(bytes(data))
    for cut in (0, 10, 18, len(data) - 1):
        with pytest.raises(ValueError):
            frames.decode_bytes(frames.encode_bytes(b"hello hello")[:cut])


def test_frame_columns(spark):
    raw = [b"", b"aab", b"x" * 700, None]
    df = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(raw)], "i int, raw binary")
    framed = df.select("i", "raw", frames.frame("rle", frames.rle_payload("raw")).alias("frame"))
    for r in framed.collect():
        assert r.frame is None if r.raw is None else bytes(r.frame) == frames.encode_bytes(bytes(r.raw))
    back = framed.select("i", frames.rle_content(frames.unframe("rle", F.col("frame"))).alias("raw"))
    assert {r.i: r.raw and bytes(r.raw) for r in back.collect()} == {i: r and r for i, r in enumerate(raw)}
    bad = framed.where("i = 1").select(frames.unframe("rle", F.unhex(F.concat(F.hex("frame"), F.lit("00")))).alias("p"))
    assert bad.first().p is None


def test_nullable_payloads(spark):
    rows = [(i, i // 10, None if i % 3 == 0 else i * i + (1 << 60), None if i % 4 == 0 else f"v{i // 5}", None if i % 5 == 0 else i % 2 == 0) for i in range(25)]
    df = spark.createDataFrame(rows, "row_index long, row_group long, n long, s string, b boolean")
    for at, (column, kind, codec) in enumerate((("n", "u64", "stored"), ("s", "string", "prefix"), ("b", "bool", "bitmap")), 2):
        for r in C.encode_column(df, column, kind, codec, nullable=True).collect():
            want = [x[at] for x in rows if x[1] == r.row_group]
            assert r["count"] == len(want) and C.decode_payload(kind, codec, bytes(r.payload), r["count"], nullable=True) == want
    nothing = df.where("row_index = 0")
    assert bytes(C.encode_column(nothing, "n", "u64", "stored", nullable=True).first().payload) == b"\x00"


def test_delta_rows(spark):
    df = spark.createDataFrame([(0, 0, 7), (1, 0, 9), (2, 1, 3)], "row_index long, row_group long, v long")
    deltas = C.delta_rows(df, "v")
    assert [r.delta for r in deltas.orderBy("row_index").collect()] == [7, 2, 3]
    assert [r.value for r in C.undelta_rows(deltas).orderBy("row_index").collect()] == [7, 9, 3]
    falling = spark.createDataFrame([(0, 0, 7), (1, 0, 6)], "row_index long, row_group long, v long")
    with pytest.raises(PySparkException, match="must not decrease"):
        C.delta_rows(falling, "v").collect()
    assert [r.delta for r in C.delta_rows(falling, "v", signed=True).orderBy("row_index").collect()] == [7, -1]


def test_ordered_delivery(spark):
    log = spark.range(95).select(F.col("id").alias("row_index"), F.floor(F.col("id") / 10).cast("long").alias("block_index")).repartition(7)
    got = []
    assert append.deliver(log, lambda k, rows: got.append((k, [r.row_index for r in rows]))) == 10
    assert got == [(k, list(range(10 * k, min(10 * k + 10, 95)))) for k in range(10)]
    assert [k for k, _ in append.blocks_in_order(log, first=8)] == [8, 9]
    assert append.deliver(log.where("false"), lambda *_: None) == 0

    def fails(k, rows):
        if k == 3:
            raise RuntimeError("sink")

    with pytest.raises(RuntimeError):
        append.deliver(log, fails)


def test_all_issues(spark):
    column = evolution.EvolvedColumn
    writer = evolution.Revision(2, (column(1, "a", "string", nullable=True), column(2, "b", "bool")))
    reader = evolution.Revision(1, (column(1, "a", "u64"), column(2, "b", "bool")))
    rows = {(r.stable_id, r.outcome) for r in evolution.assess_table(spark, writer, reader).collect()}
    issues = {(i, name) for name, i in evolution.assess(writer, reader).issues}
    assert rows == issues | {(2, "Read")}
