"""Inverted index: postings (term, doc_id, positions), one row per term and document.

Stored sorted by term and doc_id, so look-ups prune files and row groups. Terms sort by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.primitives import varint_length
from .layout import held

WHITE = "[ \t\r\n]+"
#: Up to so many hashes of repeated postings (8 bytes each) are broadcast; beyond, they are joined.
SENT_HASHES = 1_000_000


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, position: parts between ASCII white space; empty parts keep their number but are dropped."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, WHITE)).alias("position", "term"))
    return parts.where("term <> ''").select("term", "doc_id", F.col("position").cast("long").alias("position"))


def build_postings(tokens: DataFrame) -> DataFrame:
    """Positions of a term in a document, ascending. The gathered group is one term of one document."""
    return tokens.groupBy("term", "doc_id").agg(F.array_sort(F.collect_set("position")).alias("positions"))


def document_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of ``tokenize`` and ``build_postings``, made within each row: no token is shuffled.

    A document's tokens are sorted by term and position and cut where the term changes. Only
    documents of several rows have their tokens grouped. Whether there are any is told by the ids, here and now.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    several = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id"))
    if several.isEmpty():
        return _row_postings(docs)
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    return _row_postings(docs.join(several, same, "left_anti")).unionByName(build_postings(tokenize(docs.join(several, same, "left_semi"))))


def _row_postings(docs: DataFrame) -> DataFrame:
    tokens = F.sort_array(F.transform(F.split("text", WHITE), lambda t, i: F.struct(t.alias("term"), i.cast("long").alias("position"))))
    # An array of one element names a value, so that it is computed once.
    named = lambda value, f: F.transform(F.array(value), f)[0]
    starts = lambda terms: F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    parts = named(tokens, lambda s: F.struct(s["term"].alias("terms"), s["position"].alias("positions")))
    cut = named(parts, lambda g: F.struct(g["terms"].alias("terms"), g["positions"].alias("positions"), starts(g["terms"]).alias("starts")))
    one = lambda g, i, k: F.struct(F.get(g["terms"], i).alias("term"), F.slice(g["positions"], i + 1, F.coalesce(F.get(g["starts"], k + 1), F.size(g["positions"])) - i).alias("positions"))
    found = named(cut, lambda g: F.transform(g["starts"], lambda i, k: one(g, i, k)))
    return docs.select("doc_id", F.inline(F.filter(found, lambda p: p["term"] != ""))).select("term", "doc_id", "positions")


def write_index(postings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Range-partitioned by (term, doc_id): a term with very many documents takes several files."""
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(path)


def check_postings(postings: DataFrame) -> DataFrame:
    """Faulty rows: empty terms, repeated documents of a term, positions that don't increase."""
    ascending = F.coalesce(F.array_distinct(F.array_sort("positions")) == F.col("positions"), F.lit(False))
    # Of all postings, hashes alone are shuffled; those that occur again tell which rows may be repeated.
    hashed = postings.select(F.xxhash64("term", "doc_id").alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = held(hashed.select("_h", F.lit(True).alias("_again")))
    again = F.broadcast(again) if again.count() <= SENT_HASHES else again
    may = postings.withColumn("_h", F.xxhash64("term", "doc_id")).join(again, "_h", "left").where((F.col("term") == "") | F.col("_again") | ~ascending)
    repeated = F.count(F.lit(1)).over(W.partitionBy("term", "doc_id")) > 1
    return may.withColumn("_r", repeated).where((F.col("term") == "") | F.col("_r") | ~ascending).select(*postings.columns)


def dictionary(postings: DataFrame) -> DataFrame:
    """doc_count and total frequency of each term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_count"), F.sum(F.size("positions")).cast("long").alias("frequency"))


def lookup(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("term") == term).select("doc_id", "positions")


def term_docs(postings: DataFrame, term: str) -> DataFrame:
    return lookup(postings, term).select("doc_id").orderBy("doc_id")


def and_docs(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with all terms; none for no terms. Postings without positions count."""
    wanted = sorted(set(terms))
    found = postings.where(F.col("term").isin(wanted) if wanted else F.lit(False))
    return found.groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def phrase_docs(postings: DataFrame, first: str, second: str) -> DataFrame:
    """Documents where ``second`` stands right after ``first``."""
    a = lookup(postings, first).select("doc_id", F.transform("positions", lambda x: x + 1).alias("after"))
    return a.join(lookup(postings, second), "doc_id").where(F.arrays_overlap("after", "positions")).select("doc_id")


def has_adjacent_phrase(postings: DataFrame, first: str, second: str, doc_id: int) -> bool:
    return not phrase_docs(postings.where(F.col("doc_id") == doc_id), first, second).isEmpty()


def topk_frequency(postings: DataFrame, terms: list[str], k: int) -> DataFrame:
    """doc_id and score (summed frequency; a term listed twice counts twice), best first, ties by doc_id; k rows."""
    times = {t: terms.count(t) for t in terms}
    wanted = postings.where(F.col("term").isin(list(times)) if times else F.lit(False)).where(F.size("positions") > 0)
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in times.items() for x in pair)), F.col("term")) if times else F.lit(0)
    scored = wanted.groupBy("doc_id").agg(F.sum(F.size("positions") * weight).cast("long").alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def contains_doc(postings: DataFrame, term: str, doc_id: int) -> bool:
    return not postings.where((F.col("term") == term) & (F.col("doc_id") == doc_id)).isEmpty()


def seek_doc(postings: DataFrame, term: str, doc_id: int) -> DataFrame:
    return postings.where((F.col("term") == term) & (F.col("doc_id") == doc_id)).select("doc_id", "positions")


def skip_table(postings: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th posting of a term: ordinal, its doc_id and the one before it, and its offset in varint bytes.

    A posting takes the document gap, its number of positions and the position gaps.
    """
    if step <= 0:
        raise ValueError("skip step must be positive")
    w = W.partitionBy("term").orderBy("doc_id")
    before = F.coalesce(F.lag("doc_id").over(w), F.lit(0))
    # What the positions take is known before the window, so that they are not shuffled.
    gaps = F.transform("positions", lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get("positions", i - 1)))
    inner = varint_length(F.size("positions").cast("long")) + F.aggregate(F.transform(gaps, varint_length), F.lit(0).cast("long"), lambda s, x: s + x)
    size = varint_length(F.col("doc_id") - before) + F.col("_inner")
    ranked = postings.select("term", "doc_id", inner.alias("_inner")).select("term", "doc_id", before.alias("previous_doc_id"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"), size.alias("_size"))
    offset = F.coalesce(F.sum("_size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return ranked.withColumn("offset", offset).where(F.col("ordinal") % step == 0).select("term", "ordinal", F.col("doc_id").alias("first_doc_id"), "previous_doc_id", "offset")


def has_position_gap(first: list[int], second: list[int], gap: int = 1) -> bool:
    return not {p + gap for p in first}.isdisjoint(second)
