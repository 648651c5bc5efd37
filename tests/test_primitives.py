import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.functions import codecs as C
from rowloom.functions import primitives as P

MAX = (1 << 64) - 1


def test_varint_vectors():
    assert [P.varint_encode([v]).hex() for v in (0, 127, 128, MAX)] == ["00", "7f", "8001", "ff" * 9 + "01"]
    assert P.varint_decode(bytes.fromhex("00017f8001ac02ffffffff0f")) == [0, 1, 127, 128, 300, 4294967295]


@pytest.mark.parametrize("data", ["80", "8000", "80" * 9 + "02"])
def test_varint_rejects(data):
    with pytest.raises(ValueError):
        P.varint_decode(bytes.fromhex(data))


def test_zigzag_vectors():
    pairs = {0: 0, -1: 1, 1: 2, -2: 3, 2: 4, (1 << 63) - 1: MAX - 1, -(1 << 63): MAX}
    assert all(P.zigzag_encode(a) == b and P.zigzag_decode(b) == a for a, b in pairs.items())


def test_delta_vectors():
    assert P.delta_encode([100, 100, 101, 120, 120, 200]) == [100, 0, 1, 19, 0, 80]
    with pytest.raises(ValueError):
        P.delta_encode([2, 1])
    low = -(1 << 63) + 2
    assert P.delta_encode_signed([100, 98, 101, -20, -20, low]) == [100, -2, 3, -121, 0, low + 20]
    with pytest.raises(ValueError):
        P.delta_decode([MAX, 1])
    assert P.byte_delta_encode(bytes([10, 12, 9, 9])) == bytes([10, 2, 253, 0])
    assert P.byte_delta_decode(bytes([10, 2, 253, 0])) == bytes([10, 12, 9, 9])
    assert P.delta_varint_encode([100, 101, 102, 130]) == bytes([100, 1, 1, 28])


def test_rle_vectors():
    assert P.rle_encode(b"AAABBBCCC") == b"\3A\3B\3C"
    assert P.rle_encode(b"ABC") == b"\1A\1B\1C"
    assert P.rle_encode(b"A" * 300) == b"\xffA\x2dA"
    for bad in (b"\1", b"\0A"):
        with pytest.raises(ValueError):
            P.rle_decode(bad)
    with pytest.raises(ValueError):
        P.rle_decode(b"\xffA", most=10)


def test_bitpack_vectors():
    assert P.bitpack_encode([1, 0, 1, 1, 0, 0, 1, 0], 1) == bytes([0b01001101])
    assert len(P.bitpack_encode(list(range(8)), 3)) == 3
    assert P.bitpack_encode([0, 0], 0) == b""
    assert P.bitmap_encode([True, False, True, True, False, False, True, False, True]) == bytes([0b01001101, 1])
    with pytest.raises(ValueError):
        P.bitpack_decode(bytes([0b10000001]), 1, 3)
    assert all(P.required_width((1 << w) - 1) == w for w in range(65))


def test_checksum_vectors():
    assert P.checksum(b"123456789") == 0xCBF43926 and P.checksum(b"") == 0
    with pytest.raises(ValueError):
        P.verify(b"a", 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, MAX)), st.binary())
def test_round_trips(values, data):
    assert P.varint_decode(P.varint_encode(values)) == values
    assert P.rle_decode(P.rle_encode(data)) == data
    assert P.byte_delta_decode(P.byte_delta_encode(data)) == data
    width = max((v.bit_length() for v in values), default=0)
    assert P.bitpack_decode(P.bitpack_encode(values, width), width, len(values)) == values
    rising = sorted(values)
    for codec in C.CANDIDATES["u64"]:
        payload, parts = C.encode_numbers(codec, rising)
        assert C.decode_numbers(codec, payload, len(rising), parts) == rising


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]))), st.lists(st.sampled_from([True, False, None])))
def test_string_and_bool_codecs(values, bits):
    for codec in C.CANDIDATES["string"]:
        assert C.decode_strings(codec, C.encode_strings(codec, values), len(values)) == values
    assert C.decode_bools(C.encode_bools(bits, True), len(bits), True) == bits


def test_bool_payload():
    assert C.encode_bools([False, True, False], True) == bytes([0b111, 0b010])


def test_auto_choice():
    assert C.choose("string", ["a", "z"])[0] == "stored"
    with pytest.raises(ValueError):
        C.encode_strings("dictionary", [str(i) for i in range(4097)])


def golden_rows(n):
    return [(1_700_000_000 + i, ("INFO", "WARN", "ERROR")[i % 3], f"service/api/v1/tenant/{i % 16}/resource/{i % 64}") for i in range(n)]


def test_size_golden():
    """Published encoded size of 10,000 rows with the codecs chosen by size: 23,866 bytes."""
    rows = golden_rows(10_000)
    total = 10 + 40 + 4
    chosen = {}
    for i, (name, kind) in enumerate((("ts", "u64"), ("level", "string"), ("path", "string"))):
        values = [r[i] for r in rows]
        codec, size = C.choose(kind, values)
        payload = size - C.CODEC_METADATA[codec]
        chosen[name] = codec
        total += 4 + C.column_metadata_size(name, kind, codec) + payload
    assert chosen == {"ts": "delta_bitpack", "level": "dictionary", "path": "dictionary"}
    assert total == 23_866


def test_size_models_equal_encoders(spark):
    rng = random.Random(1)
    rows = [(i, i // 40, sorted(rng.randrange(10_000) for _ in range(400))[i] if i // 40 % 2 else rng.randrange(1000), rng.choice(["", "ab", "abc", "é/x", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "row_index long, row_group long, v long, s string")
    for r in C.number_sizes(df, "v").collect():
        values = [x[2] for x in rows if x[1] == r.row_group]
        for codec in C.CANDIDATES["u64"]:
            try:
                want = len(C.encode_numbers(codec, values)[0])
            except ValueError:
                want = None
            assert r[codec] == want
    sizes = C.string_sizes(df, "s").collect()
    for r in sizes:
        values = [x[3] for x in rows if x[1] == r.row_group and x[3] is not None]
        assert (r.prefix, r.stored, r.dictionary) == tuple(len(C.encode_strings(c, values)) for c in ("prefix", "stored", "dictionary"))
    best = {r.row_group: (r.codec, r.encoded_size) for r in C.auto_codec(C.number_sizes(df, "v"), "u64").collect()}
    assert best == {g: C.choose("u64", [x[2] for x in rows if x[1] == g]) for g in best}
    for r in C.encode_column(df, "s", "string", "prefix").collect():
        assert C.decode_strings("prefix", bytes(r.payload), r["count"]) == [x[3] for x in rows if x[1] == r.row_group and x[3] is not None]


def test_string_choice_is_the_encoders(spark):
    """Sizes and choice of strings with runs of one byte, also across values, against the encoder."""
    groups = {0: ["a" * 600, "b" * 300], 1: ["x", "yz", "x"], 2: ["\x01"] * 300, 3: ["", "", "é" * 200], 4: ["k" * 127, "k" * 128, "\x7f" * 127], 5: ["same words"] * 20, 6: [""]}
    df = spark.createDataFrame([(g, i, v) for g, vs in groups.items() for i, v in enumerate([*vs, None])], "row_group long, row_index long, s string")
    sizes = C.string_sizes(df, "s")
    for r in sizes.collect():
        assert {c: r[c] for c in C.CANDIDATES["string"]} == {c: len(C.encode_strings(c, groups[r.row_group])) for c in C.CANDIDATES["string"]}
    got = {r.row_group: (r.codec, r.encoded_size) for r in C.auto_codec(sizes, "string").collect()}
    assert got == {g: C.choose("string", vs) for g, vs in groups.items()} and "rle" in {c for c, _ in got.values()}
    with pytest.raises(ValueError):
        C.auto_codec(sizes.drop("rle"), "string")
