"""Schema evolution by stable ids, and metadata migration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TYPES, dump_yaml, load_yaml


@dataclass(frozen=True)
class EvolvedColumn:
    stable_id: int
    name: str
    type: str
    codec: str = "auto"
    nullable: bool = False
    aliases: tuple[str, ...] = ()
    default: object = None


@dataclass(frozen=True)
class Revision:
    revision: int
    columns: tuple[EvolvedColumn, ...]

    def __post_init__(self):
        if self.revision < 1 or not self.columns:
            raise ValueError("schema revision needs a positive number and columns")
        ids = [c.stable_id for c in self.columns]
        if min(ids) < 1 or len(set(ids)) < len(ids):
            raise ValueError("stable ids must be positive and unique")
        names = [n for c in self.columns for n in (c.name, *c.aliases)]
        if not all(names) or len(set(names)) < len(names):
            raise ValueError("names and aliases must be non-empty and unique")
        fits = {"u64": lambda v: type(v) is int and v >= 0, "bool": lambda v: type(v) is bool, "string": lambda v: type(v) is str}
        for c in self.columns:
            if c.type not in TYPES or c.default is not None and not fits[c.type](c.default):
                raise ValueError(f"column {c.name} has a bad type or default")


def parse_revision(text: str) -> Revision:
    data = load_yaml(text)
    columns = []
    for c in data["columns"]:
        known = {"stable_id", "id", "name", "type", "codec", "nullable", "aliases", "default"}
        if not set(c) <= known:
            raise ValueError("invalid schema")
        default = c.get("default")
        columns.append(EvolvedColumn(c.get("stable_id", c.get("id")), c["name"], c["type"], c.get("codec", "auto"), c.get("nullable", False), tuple(c.get("aliases") or ()), default.get("value") if isinstance(default, dict) else default))
    return Revision(data.get("revision", data.get("schema_revision", 1)), tuple(columns))


@dataclass
class Assessment:
    """Actions (action, stable_id, writer name, reader name) and issues (issue, stable_id); compatible without issues."""

    actions: list[tuple[str, int, str | None, str | None]] = field(default_factory=list)
    issues: list[tuple[str, int | None]] = field(default_factory=list)

    @property
    def compatible(self) -> bool:
        return not self.issues


def assess(writer: Revision, reader: Revision) -> Assessment:
    """What a reader's columns take from a writer's rows, in the reader's order; dropped columns last."""
    out = Assessment()
    if reader.revision < writer.revision:
        out.issues.append(("ReaderRevisionIsOlder", None))
    by_id = {c.stable_id: c for c in writer.columns}
    for c in reader.columns:
        w = by_id.pop(c.stable_id, None)
        if w:
            if w.type != c.type:
                out.issues.append(("ValueTypeChanged", c.stable_id))
            if w.nullable and not c.nullable:
                out.issues.append(("NullabilityTightened", c.stable_id))
            out.actions.append(("Read", c.stable_id, w.name, c.name))
        elif c.default is not None:
            out.actions.append(("FillDefault", c.stable_id, None, c.name))
        elif c.nullable:
            out.actions.append(("FillNull", c.stable_id, None, c.name))
        else:
            out.issues.append(("RequiredColumnAddedWithoutDefault", c.stable_id))
    out.actions += [("Drop", i, w.name, None) for i, w in by_id.items()]
    return out


def assess_table(spark: SparkSession, writer: Revision, reader: Revision) -> DataFrame:
    """The same as rows: stable_id, outcome, one for each issue of a column, else one for its action. A full join on the ids of two small column lists.

    An older reader's revision is a row without a column.
    """
    schema = "stable_id long, name string, type string, nullable boolean, has_default boolean"
    rows = lambda r: spark.createDataFrame([(c.stable_id, c.name, c.type, c.nullable, c.default is not None) for c in r.columns], schema)
    w, r = rows(writer).alias("w"), rows(reader).alias("r")
    both = w.join(r, F.col("w.stable_id") == F.col("r.stable_id"), "full")
    shared = F.col("w.stable_id").isNotNull() & F.col("r.stable_id").isNotNull()
    issues = F.array_compact(F.array(
        F.when(shared & (F.col("w.type") != F.col("r.type")), F.lit("ValueTypeChanged")),
        F.when(shared & F.col("w.nullable") & ~F.col("r.nullable"), F.lit("NullabilityTightened")),
    ))
    single = (
        F.when(F.col("r.stable_id").isNull(), "Drop")
        .when(F.col("w.stable_id").isNull(), F.when(F.col("r.has_default"), "FillDefault").when(F.col("r.nullable"), "FillNull").otherwise("RequiredColumnAddedWithoutDefault"))
        .otherwise("Read")
    )
    outcome = F.explode(F.when(F.size(issues) > 0, issues).otherwise(F.array(single)))
    out = both.select(F.coalesce("r.stable_id", "w.stable_id").alias("stable_id"), F.col("w.name").alias("writer_name"), F.col("r.name").alias("reader_name"), outcome.alias("outcome"))
    if reader.revision < writer.revision:
        out = out.unionByName(spark.createDataFrame([(None, None, None, "ReaderRevisionIsOlder")], out.schema))
    return out


def evolve(df: DataFrame, writer: Revision, reader: Revision) -> DataFrame:
    """A writer's rows as the reader's columns: one projection."""
    found = assess(writer, reader)
    if not found.compatible:
        raise ValueError(f"schemas are incompatible: {found.issues}")
    by_id = {c.stable_id: c for c in reader.columns}
    out = []
    for action, i, source, name in found.actions:
        kind = TYPES[by_id[i].type] if i in by_id else None
        if action == "Read":
            out.append(F.col(source).cast(kind).alias(name))
        elif action == "FillDefault":
            out.append(F.lit(by_id[i].default).cast(kind).alias(name))
        elif action == "FillNull":
            out.append(F.lit(None).cast(kind).alias(name))
    return df.select(*out)


def migrate_metadata(text: str, assignments: dict[str, int] | None = None) -> str:
    """Version 1 metadata (columns by name) to version 2 (by stable id); version 2 comes back unchanged.

    Each column needs exactly one id. Keys that aren't known stay as they are.
    """
    data = load_yaml(text)
    version = data.get("metadata_version", 1)
    given = assignments or {}
    if version == 2:
        if given:
            raise ValueError("metadata already has stable ids")
        return text
    if version != 1:
        raise ValueError("unsupported metadata version")
    names = [c["name"] for c in data["columns"]]
    if set(given) != set(names):
        raise ValueError("assignments must name each column exactly")
    if len(set(given.values())) < len(given) or min(given.values(), default=1) < 1:
        raise ValueError("stable ids must be positive and unique")
    out = {"metadata_version": 2} | {k: v for k, v in data.items() if k != "metadata_version"}
    out["columns"] = [{"stable_id": given[c["name"]]} | c for c in data["columns"]]
    return dump_yaml(out)
