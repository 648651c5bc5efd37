"""Column codecs: byte-exact encoders, size models as DataFrame aggregates, and the choice of the smallest.

The encoders work on one column of one row group. The size models give the same sizes
for all groups of a table at once, without Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import primitives as P

DICTIONARY_ENTRIES = 4096
#: Bytes of values (each a row of a sort, when run lengths are told) that one task takes.
TASK_OCTETS = 1_000_000
#: Candidates in the order in which ties are decided: fixed values.
CANDIDATES = {"u64": ("delta_bitpack", "bitpack", "delta_varint_u64", "stored"), "string": ("prefix", "dictionary", "rle", "stored"), "bool": ("bitmap",)}
#: Bytes of a column's metadata beside its name, codec metadata and statistics: fixed values.
COLUMN_FIXED, NAME_LENGTH = 43, 2
STATISTICS = {"u64": 17, "bool": 9, "string": 9}
CODEC_METADATA = {"bitpack": 9, "delta_bitpack": 17, "delta_varint_u64": 8, "stored": 8, "prefix": 8, "dictionary": 8, "rle": 8, "bitmap": 8}


# byte-exact, on Python values


def _stored_strings(values: list[str]) -> bytes:
    return b"".join(P.varint_encode([len(raw)]) + raw for raw in (v.encode() for v in values))


def _read_strings(data: bytes, count: int) -> list[str]:
    out, at = [], 0
    for _ in range(count):
        size, at = P.varint_read(data, at)
        if at + size > len(data):
            raise ValueError("truncated string")
        out.append(data[at : at + size].decode())
        at += size
    if at != len(data):
        raise ValueError("trailing bytes after strings")
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def encode_strings(codec: str, values: list[str], cap: int | None = DICTIONARY_ENTRIES) -> bytes:
    if codec == "stored":
        return _stored_strings(values)
    if codec == "rle":
        return P.rle_encode(_stored_strings(values))
    if codec == "dictionary":
        ids: dict[str, int] = {}
        places = [ids.setdefault(v, len(ids)) for v in values]
        if cap is not None and len(ids) > cap:
            raise ValueError("dictionary has too many entries")
        return P.varint_encode([len(ids)]) + _stored_strings(list(ids)) + P.varint_encode(places)
    if codec == "prefix":
        out, last = bytearray(), b""
        for v in values:
            raw = v.encode()
            shared = common_prefix(last, raw)
            out += P.varint_encode([shared, len(raw) - shared]) + raw[shared:]
            last = raw
        return bytes(out)
    raise ValueError(f"no string codec {codec}")


def decode_strings(codec: str, data: bytes, count: int) -> list[str]:
    if codec == "stored":
        return _read_strings(data, count)
    if codec == "rle":
        return _read_strings(P.rle_decode(data), count)
    if codec == "dictionary":
        size, at = P.varint_read(data)
        entries = []
        for _ in range(size):
            n, at = P.varint_read(data, at)
            entries.append(data[at : at + n].decode())
            at += n
        places = P.varint_decode(data[at:])
        if len(places) != count or any(p >= size for p in places):
            raise ValueError("dictionary id out of range")
        return [entries[p] for p in places]
    if codec == "prefix":
        out, last, at = [], b"", 0
        for _ in range(count):
            shared, at = P.varint_read(data, at)
            n, at = P.varint_read(data, at)
            if shared > len(last) or at + n > len(data):
                raise ValueError("prefix is longer than the value before")
            last = last[:shared] + data[at : at + n]
            at += n
            out.append(last.decode())
        if at != len(data):
            raise ValueError("trailing bytes after strings")
        return out
    raise ValueError(f"no string codec {codec}")


def encode_numbers(codec: str, values: list[int]) -> tuple[bytes, tuple[int, ...]]:
    """The payload, and what decoding needs: width, or base and width."""
    if codec == "stored":
        return b"".join(v.to_bytes(8, "little") for v in values), ()
    if codec == "bitpack":
        width = P.required_width(max(values, default=0))
        return P.bitpack_encode(values, width), (width,)
    if codec == "delta_bitpack":
        deltas = P.delta_encode(values)
        base = deltas[0] if deltas else 0
        deltas[:1] = [0] * len(deltas[:1])
        width = P.required_width(max(deltas, default=0))
        return P.bitpack_encode(deltas, width), (base, width)
    if codec == "delta_varint_u64":
        return P.delta_varint_encode(values), ()
    raise ValueError(f"no number codec {codec}")


def decode_numbers(codec: str, data: bytes, count: int, parts: tuple[int, ...] = ()) -> list[int]:
    if codec == "stored":
        if len(data) != 8 * count:
            raise ValueError("stored length does not match")
        return [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data), 8)]
    if codec == "bitpack":
        return P.bitpack_decode(data, parts[0], count)
    if codec == "delta_bitpack":
        deltas = P.bitpack_decode(data, parts[1], count)
        return P.delta_decode([parts[0], *deltas[1:]]) if count else []
    if codec == "delta_varint_u64":
        out = P.delta_varint_decode(data)
        if len(out) != count:
            raise ValueError("value count does not match")
        return out
    raise ValueError(f"no number codec {codec}")


def encode_bools(values: list[bool | None], nullable: bool) -> bytes:
    """Validity bits (for a nullable column, nulls or not), then the bits of the values present."""
    validity = P.bitmap_encode([v is not None for v in values]) if nullable else b""
    return validity + P.bitmap_encode([v for v in values if v is not None])


def decode_bools(data: bytes, count: int, nullable: bool) -> list[bool | None]:
    if not nullable:
        return list(P.bitmap_decode(data, count))
    size = -(-count // 8)
    present = P.bitmap_decode(data[:size], count)
    bits = iter(P.bitmap_decode(data[size:], sum(present)))
    return [next(bits) if p else None for p in present]


def choose(kind: str, values: list) -> tuple[str, int]:
    """The codec of least metadata and payload, and that size; candidates that fail are passed over."""
    best: tuple[int, str] | None = None
    failed: ValueError | None = None
    for codec in CANDIDATES[kind]:
        try:
            payload = encode_numbers(codec, values)[0] if kind == "u64" else encode_strings(codec, values) if kind == "string" else encode_bools(values, False)
        except ValueError as e:
            failed = failed or e
            continue
        size = len(payload) + CODEC_METADATA[codec]
        if best is None or size < best[0]:
            best = (size, codec)
    if best is None:
        raise failed or ValueError("no codec")
    return best[1], best[0]


# size models


def number_sizes(df: DataFrame, value: str, order: str = "row_index", group: str = "row_group") -> DataFrame:
    """Payload bytes per group by codec; null where the codec cannot take the values (decreasing ones)."""
    w = W.partitionBy(group).orderBy(order)
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"), F.lag(value).over(w).alias("before"))
    delta = F.coalesce(F.col("v") - F.col("before"), F.col("v"))
    inner = F.when(F.col("before").isNotNull(), F.col("v") - F.col("before"))
    width = lambda c: F.coalesce(P.bit_width(c), F.lit(0))
    agg = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("most"), F.max(inner).alias("step"), F.min(inner).alias("least"),
        F.sum(F.when(delta >= 0, P.varint_length(F.greatest(delta, F.lit(0))))).cast("long").alias("varint"),
    )
    rising = F.coalesce(F.col("least") >= 0, F.lit(True))
    return agg.select(
        group, F.col("n").alias("value_count"),
        F.when(rising, F.ceil(F.col("n") * width(F.col("step")) / 8).cast("long")).alias("delta_bitpack"),
        F.ceil(F.col("n") * width(F.col("most")) / 8).cast("long").alias("bitpack"),
        F.when(rising, F.col("varint")).alias("delta_varint_u64"), (8 * F.col("n")).cast("long").alias("stored"),
    )


def string_sizes(df: DataFrame, value: str, order: str = "row_index", group: str = "row_group", cap: int = DICTIONARY_ENTRIES) -> DataFrame:
    """Payload bytes per group by codec.

    Groups are dealt over as many tasks as the bytes of the values need: left to itself, Spark joins small
    partitions by their compressed size, of which the single bytes take a few hundred times as much.
    """
    w = W.partitionBy(group).orderBy(order)
    octets = df.agg(F.sum(F.octet_length(value).cast("long") + 1).alias("n")).first()["n"] or 0
    df = df.select(group, order, value).repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-octets // TASK_OCTETS)), group)
    size = F.octet_length("v").cast("long")
    rows = df.where(F.col(value).isNotNull()).select(group, order, F.col(value).alias("v"), F.lag(value).over(w).alias("before"))
    shared = prefix_length(F.col("before"), F.col("v"))
    stored = P.varint_length(size) + size
    plain = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("value_count"), F.sum(stored).cast("long").alias("stored"),
        F.sum(P.varint_length(shared) + P.varint_length(size - shared) + size - shared).cast("long").alias("prefix"),
    )
    ids = rows.groupBy(group, "v").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    ids = ids.withColumn("id", (F.row_number().over(W.partitionBy(group).orderBy("first")) - 1).cast("long"))
    entry = ids.groupBy(group).agg(F.count(F.lit(1)).alias("entries"), F.sum(stored + F.col("n") * P.varint_length(F.col("id"))).cast("long").alias("bytes"))
    dictionary = F.when(F.col("entries") <= cap, F.col("bytes") + P.varint_length(F.col("entries")))
    out = plain.join(entry, group).select(group, "value_count", "prefix", dictionary.alias("dictionary"), "stored")
    return out.join(_rle_sizes(rows, order, group), group)


def _rle_sizes(rows: DataFrame, order: str, group: str) -> DataFrame:
    """Bytes of the stored form (lengths and values) of the values ``v``, run-length encoded: two for each run of at most 255."""
    rows = rows.select(group, order, F.encode("v", "UTF-8").alias("raw")).withColumn("size", F.octet_length("raw").cast("long"))
    rows = rows.withColumn("parts", P.varint_length(F.col("size"))).withColumn("digits", F.hex("raw"))
    length = F.expr("transform(sequence(0, CAST(parts AS INT) - 1), k -> lpad(hex(shiftright(size, 7 * k) & 127 | IF(k < parts - 1, 128, 0)), 2, '0'))")
    value = F.expr("IF(size = 0, CAST(array() AS ARRAY<STRING>), transform(sequence(0, CAST(size AS INT) - 1), i -> substr(digits, 2 * i + 1, 2)))")
    stream = rows.select(group, order, F.posexplode(F.concat(length, value)).alias("at", "byte"))
    w = W.partitionBy(group).orderBy(order, "at")
    begins = stream.withColumn("begins", (~F.col("byte").eqNullSafe(F.lag("byte").over(w))).cast("long"))
    runs = begins.withColumn("run", F.sum("begins").over(w)).groupBy(group, "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(group).agg(F.sum(2 * F.ceil(F.col("n") / 255)).cast("long").alias("rle"))


def prefix_length(before, value):
    """Bytes that both strings begin with; 0 without a value before. By hex digits, two to a byte."""
    a, b = F.hex(F.encode(before, "UTF-8")), F.hex(F.encode(value, "UTF-8"))
    most = F.least(F.octet_length(before), F.octet_length(value))
    differs = F.array_position(F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.substr(a, 2 * i + 1, F.lit(2)) == F.substr(b, 2 * i + 1, F.lit(2))), False)
    found = F.when(most == 0, F.lit(0)).otherwise(F.when(differs == 0, most).otherwise(differs - 1))
    return F.when(before.isNull(), F.lit(0)).otherwise(found).cast("long")


def auto_codec(sizes: DataFrame, kind: str, group: str = "row_group") -> DataFrame:
    """The smallest codec per group; ties go to the earlier candidate, codecs without a size in a group are passed over. Strings need all candidates' columns."""
    if kind == "string" and (missing := [c for c in CANDIDATES[kind] if c not in sizes.columns]):
        raise ValueError(f"no sizes of {', '.join(missing)}")
    names = [c for c in CANDIDATES[kind] if c in sizes.columns]
    options = F.array(*(F.struct((F.col(c) + CODEC_METADATA[c]).alias("size"), F.lit(i).alias("rank"), F.lit(c).alias("codec")) for i, c in enumerate(names)))
    best = F.array_min(F.filter(options, lambda o: o["size"].isNotNull()))
    return sizes.select(group, best["codec"].alias("codec"), best["size"].cast("long").alias("encoded_size"))


def column_metadata_size(name: str, kind: str, codec: str, has_values: bool = True) -> int:
    stats = 1 if kind == "u64" and not has_values else STATISTICS[kind]
    return NAME_LENGTH + len(name.encode()) + COLUMN_FIXED + CODEC_METADATA[codec] + stats


# codecs over DataFrames


def encode_column(df: DataFrame, value: str, kind: str, codec: str, order: str = "row_index", group: str = "row_group", nullable: bool = False) -> DataFrame:
    """group, payload, count: byte-exact payloads. A task holds one row group, which the writer bounds.

    A nullable column's payload begins with the validity bits of all its rows, and the
    count is that of the rows; otherwise nulls are left out and not counted.
    """
    import pandas as pd

    encode: Callable = (lambda v: encode_numbers(codec, [int(x) for x in v])[0]) if kind == "u64" else (lambda v: encode_strings(codec, v)) if kind == "string" else (lambda v: encode_bools([bool(x) for x in v], False))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        validity = P.bitmap_encode(list(rows["_there"])) if nullable else b""
        return pd.DataFrame({group: [key[0]], "payload": [validity + encode(list(rows.loc[rows["_there"], "_value"]))], "count": [len(rows)]})

    # A null stands as a value of its type, so that Arrow keeps 64-bit integers exact.
    filler = {"u64": F.lit(0).cast("long"), "string": F.lit(""), "bool": F.lit(False)}[kind]
    small = df.select(group, order, F.coalesce(value, filler).alias("_value"), F.col(value).isNotNull().alias("_there"))
    return (small if nullable else small.where("_there")).groupBy(group).applyInPandas(one, f"{group} long, payload binary, count long")


def decode_payload(kind: str, codec: str, data: bytes, count: int, parts: tuple[int, ...] = (), nullable: bool = False) -> list:
    """The values of one payload of ``encode_column``, nulls in their places."""
    size = -(-count // 8) if nullable else 0
    there = P.bitmap_decode(data[:size], count) if nullable else [True] * count
    data, n = data[size:], sum(there)
    values = iter(decode_numbers(codec, data, n, parts) if kind == "u64" else decode_strings(codec, data, n) if kind == "string" else decode_bools(data, n, False))
    return [next(values) if t else None for t in there]


def delta_rows(df: DataFrame, value: str, order: str = "row_index", group: str = "row_group", signed: bool = False) -> DataFrame:
    """order, group, delta: each group's first value, then differences. Unsigned values that decrease fail the query."""
    before = F.lag(value).over(W.partitionBy(group).orderBy(order))
    delta = F.col(value) - F.coalesce(before, F.lit(0))
    if not signed:
        delta = F.when(F.col(value) < F.coalesce(before, F.lit(0)), F.raise_error(F.lit("delta input must not decrease")).cast("long")).otherwise(delta)
    return df.select(order, group, delta.alias("delta"))


def undelta_rows(deltas: DataFrame, order: str = "row_index", group: str = "row_group", name: str = "value") -> DataFrame:
    """order, group and the values that ``delta_rows`` was given."""
    return deltas.select(order, group, F.sum("delta").over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)).alias(name))


def dictionary_encode(df: DataFrame, value: str, order: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """(order, id) and (id, value): ids by first appearance. The table of distinct values is ranked, not the rows."""
    first = df.groupBy(value).agg(F.min(order).alias("first"))
    entries = first.select((F.row_number().over(W.orderBy("first")) - 1).cast("long").alias("id"), F.col(value).alias("value"))
    return df.join(entries, F.col(value).eqNullSafe(F.col("value"))).select(order, "id"), entries


def dictionary_decode(ids: DataFrame, entries: DataFrame, order: str = "row_index") -> DataFrame:
    return ids.join(entries, "id").select(order, "value")
