"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def choose(labels: DataFrame, label: str, rows: int, keep: Column | None = None) -> DataFrame:
    """At most ``rows`` of (doc_id, label 0 or 1), the first by a hash of the id.

    Rows with a null id or label, or another label than 0 and 1, are left out; of repeated
    rows one stays. The choice does not depend on the order of the rows.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if keep is not None:
        chosen = chosen.where(keep)
    return chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the chosen ids that have a text. ``chosen`` is bounded by its caller, so it is broadcast."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id")


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, keep: Column | None = None) -> list[tuple[int, str, int]]:
    """At most ``rows`` of (doc_id, text, label), of ``most_bytes`` of UTF-8 together.

    Rows are taken in the order of ``choose`` as long as their texts fit what is left of the
    bytes; of texts that share an id the first by length and hash is taken. Texts are whole.
    """
    found = labelled_texts(docs, choose(labels, label, rows, keep)).withColumns({"size": F.octet_length("text").cast("long"), "mark": F.xxhash64("text")})
    # Bounded by ``rows`` but for repeated ids: three numbers each.
    sizes = found.groupBy("doc_id").agg(F.min(F.struct("size", "mark")).alias("first")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, taken = most_bytes, []
    for r in sizes:
        if r.first.size <= left:
            left -= r.first.size
            taken.append((r.doc_id, r.first.mark))
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, mark long")
    texts = found.join(F.broadcast(wanted), ["doc_id", "mark"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "label").collect()
    return sorted((r.doc_id, r.text, r.label) for r in texts)
