"""Log schemas: an ordered list of typed columns with a codec, kept outside the data as YAML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {"bool": T.BooleanType(), "string": T.StringType(), "u64": T.LongType()}
#: Codecs by type and format: the stream format (blocks) and the row-group formats.
STREAM_CODECS = {"u64": ("delta_varint_u64",), "string": ("dictionary", "rle"), "bool": ()}
GROUP_CODECS = {"u64": ("auto", "bitpack", "delta_bitpack", "delta_varint_u64", "stored"), "string": ("auto", "dictionary", "prefix", "rle", "stored"), "bool": ("auto", "bitmap")}


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    type: str
    codec: str = "auto"
    nullable: bool = False


@dataclass(frozen=True)
class Schema:
    columns: tuple[ColumnSchema, ...]

    def __post_init__(self):
        if not self.columns:
            raise ValueError("schema needs at least one column")
        names = [c.name for c in self.columns]
        if not all(names):
            raise ValueError("schema column name is empty")
        if len(set(names)) < len(names):
            raise ValueError("schema column name is repeated")
        for c in self.columns:
            if c.type not in TYPES:
                raise ValueError(f"schema column type {c.type}")

    def check_stream(self) -> Schema:
        """The block stream: unsigned and string columns, never null."""
        for c in self.columns:
            if c.nullable or c.codec not in STREAM_CODECS[c.type]:
                raise ValueError("schema column codec")
        return self

    def check_groups(self) -> Schema:
        """The row-group formats."""
        for c in self.columns:
            if c.codec not in GROUP_CODECS[c.type]:
                raise ValueError("row groups have no such codec for the column's type")
        return self

    def column(self, name: str) -> ColumnSchema:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"column does not exist: {name}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type], c.nullable, {"codec": c.codec}) for c in self.columns])


def load_yaml(text: str):
    try:
        import yaml
    except ImportError:
        return _simple_yaml(text)
    return yaml.safe_load(text)


def parse_schema(text: str) -> Schema:
    """``columns:`` with name, type, codec and nullable; other keys are errors."""
    data = load_yaml(text)
    if not isinstance(data, dict) or set(data) != {"columns"} or not isinstance(data["columns"], list):
        raise ValueError("invalid schema")
    out = []
    for c in data["columns"]:
        if not isinstance(c, dict) or not {"name", "type", "codec"} <= set(c) <= {"name", "type", "codec", "nullable"}:
            raise ValueError("invalid schema")
        if not isinstance(c.get("nullable", False), bool):
            raise ValueError("invalid schema")
        out.append(ColumnSchema(str(c["name"]), str(c["type"]), str(c["codec"]), c.get("nullable", False)))
    return Schema(tuple(out))


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    low = {"true": True, "false": False, "null": None, "~": None, "": None, "[]": []}
    if text in low:
        return low[text]
    if text.lstrip("-").isdigit():
        return int(text)
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",")]
    return text


def _simple_yaml(text: str):
    """Maps, lists of maps and scalars by indentation: the part of YAML that schemas use."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, depth: int):
        if lines[at][1].startswith("- "):
            out: list = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
                body = lines[at][1][2:]
                if ":" in body and not body.startswith(("'", '"')):
                    lines[at] = (depth + 2, body)
                    item, at = block(at, depth + 2)
                else:
                    item, at = _scalar(body), at + 1
                out.append(item)
            return out, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == depth and not lines[at][1].startswith("- "):
            key, sep, value = lines[at][1].partition(":")
            if not sep:
                raise ValueError("invalid schema")
            at += 1
            if value.strip():
                found[key] = _scalar(value)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][1].startswith("- ") and lines[at][0] == depth):
                found[key], at = block(at, lines[at][0])
            else:
                found[key] = None
        return found, at

    if not lines:
        return None
    value, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError("invalid schema")
    return value


def dump_yaml(value, indent: int = 0) -> str:
    """The inverse of the simple reader, with keys in their order."""
    pad = " " * indent
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            if isinstance(v, (dict, list)) and v:
                out.append(f"{pad}{k}:\n{dump_yaml(v, indent + 2)}")
            else:
                out.append(f"{pad}{k}: {_plain(v)}\n")
        return "".join(out)
    if isinstance(value, list):
        out = []
        for v in value:
            body = dump_yaml(v, indent + 2) if isinstance(v, dict) else f"{pad}  {_plain(v)}\n"
            out.append(f"{pad}- {body[indent + 2 :]}")
        return "".join(out)
    return f"{pad}{_plain(value)}\n"


def _plain(value) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return str(value).lower()
    if value == []:
        return "[]"
    text = str(value)
    if isinstance(value, str) and (not text or _scalar(text) != text or text[0] in "-#[]{}&*!|>%@`'\"" or ": " in text or " #" in text):
        return "'" + text + "'"
    return text
