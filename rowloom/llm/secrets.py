"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Candidates are found by pattern in each whole text. Their values are hashed, and each
hash is counted over distinct repositories and owners: a value that more owners have
than copies of a document explain, or that is in more repositories, is a widely copied
example; another one that looks random is owner-specific and live-looking.
Opaque tokens, which the base patterns miss, count as secrets only by this.

Spans are code points, end exclusive. Patterns are Java's, ASCII only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import Scratch


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that is the value (0: all), the least length of the value, and if it must mix digits and both cases."""

    name: str
    pattern: str
    group: int
    least: int
    mixed: bool = False


#: Fixed patterns of the base kinds, in the order of the result.
ASSIGN = Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12)
ACCESS = Kind("access", r"AKIA[A-Z0-9]+", 0, 18)
HEX = Kind("hex", r"[0-9a-f]{16,}", 0, 16)
BASE = (ASSIGN, ACCESS, HEX)
#: What the method adds: long mixed tokens that only one owner has.
OPAQUE = Kind("opaque", r"[A-Za-z0-9+/_=-]{20,}", 0, 20, mixed=True)
KINDS = (*BASE, OPAQUE)
#: A value of more owners than this, or in more repositories, is widely copied. Two owners may hold copies of one document.
MOST_OWNERS, MOST_REPOS = 2, 3
#: A random-looking value has a digit and at least so many distinct characters.
LIVE_CHARACTERS = 8


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """Matches in order: kind, place, code points since the last match, length, value.

    A kind whose pattern is one repeated class of characters may name the least length in the pattern: the maximal runs are the same.
    """
    found = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1))
    value = lambda m: F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m
    pieces = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found))
    rows = F.transform(
        F.arrays_zip(pieces.alias("before"), found.alias("match")),
        lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("place"), F.length(m["before"]).cast("long").alias("before"), F.length(m["match"]).cast("long").alias("size"), value(m["match"]).alias("value")),
    )
    return F.when(text.rlike(kind.pattern), rows).otherwise(F.expr("array()").cast("array<struct<kind:int,place:int,before:bigint,size:bigint,value:string>>"))


def candidates(docs: DataFrame, repo_cols: Sequence[str], owner_col: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, text_hash, repo, owner, kind (its number), start, end, value of each match that is long enough. Equal rows of ``docs`` count once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*(_matches(F.col("text"), i, k) for i, k in enumerate(kinds)))
    key = ["doc_id", "text_hash", "repo", "owner", "kind"]
    read = docs.select(*_keys(repo_cols, owner_col), text.alias("text"))
    rows = read.select(*key[:4], F.explode(found).alias("m")).select(*key[:4], "m.*").distinct()
    upto = W.partitionBy(*key).orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("before") + F.col("size")).over(upto)
    spans = rows.select(*key, (end - F.col("size")).alias("start"), end.alias("end"), "value")
    least = F.element_at(F.array(*(F.lit(k.least) for k in kinds)), F.col("kind") + 1)
    size = F.when(F.col("kind").isin([i for i, k in enumerate(kinds) if k.group]), F.length("value")).otherwise(F.col("end") - F.col("start"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    return spans.where((size >= least) & (~F.col("kind").isin([i for i, k in enumerate(kinds) if k.mixed]) | mixed))


def _name(column: str) -> Column:
    """A null name is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _keys(repo_cols: Sequence[str], owner_col: str) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    repo = F.concat_ws("/", *(_name(c) for c in repo_cols))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), repo.alias("repo"), _name(owner_col).alias("owner")]


def widely_copied(found: DataFrame, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """(value_hash, n_repos, n_owners) of values that too many repositories or owners have. Copies in one repository are folded first."""
    once = found.select("value_hash", "repo", "owner").distinct()
    counted = once.groupBy("value_hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    return counted.where((F.col("n_owners") > most_owners) | (F.col("n_repos") > most_repos))


def scan_secrets(docs: DataFrame, repo_cols: Sequence[str] = ("source", "lang"), owner_col: str = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """Spans of secrets of each whole text.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live, one
    row per row of ``docs``, null or repeated ids included. A repository is named by
    ``repo_cols`` together, its owner by ``owner_col``. ``spans`` has the base spans, and those
    opaque tokens that are live: random-looking, of ``most_owners`` owners and in ``most_repos``
    repositories at most. ``n_copied`` counts spans of values that are in more, ``n_live``
    those of live values. A null text counts as empty, a null name as one more name.
    Other columns are not read. No documents: no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    live = (F.size(F.array_distinct(F.split("value", ""))) >= LIVE_CHARACTERS) & F.col("value").rlike("[0-9]")
    found = candidates(docs, repo_cols, owner_col).select("doc_id", "text_hash", "repo", "owner", "kind", "start", "end", F.sha2("value", 256).alias("value_hash"), live.alias("live"))
    found = scratch.keep(found)
    # Only what is widely copied is joined, a small part of the values, so that it is mostly broadcast.
    judged = found.join(widely_copied(found, most_owners, most_repos), "value_hash", "left").withColumn("copied", F.col("n_owners").isNotNull()).withColumn("live", F.col("live") & ~F.col("copied"))
    judged = judged.where((F.col("kind") < len(BASE)) | F.col("live"))
    text = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    number = lambda i: F.count_if(F.col("kind") == i)
    # The spans of one document.
    per = judged.groupBy("doc_id", "text_hash", "repo", "owner").agg(
        number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.count_if("copied").alias("n_copied"), F.count_if("live").alias("n_live"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
    )
    per = per.select("*", text(F.filter("all", lambda s: s["kind"] < len(BASE))).alias("base"), text(F.col("all")).alias("spans"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "text_hash", "repo", "owner")]
    out = docs.select(*_keys(repo_cols, owner_col)).alias("d").join(per.alias("p"), same, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("d.doc_id", count("n_assign"), count("n_access"), count("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), count("n_copied"), count("n_live"))
