"""Frontmatter: find the block, read it into typed columns, check it.

Blocks of plain ``key: value`` lines and flat ``[a, b]`` lists are read by
native expressions.  Only other blocks go to Python, and only the block does:
the page text never leaves the JVM for this.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import WHITE_SPACE, is_blank, strip_bom, trim_space

# fixed values: opening lines of a block and the line that closes each
BLOCK = r"(?s)\A\s*+(---|---yaml|\+\+\+|---toml|;;;|---json)[^\S\n]*+\n"
WHOLE = (
    r"(?s)\A\s*+(?:---(?:yaml|toml|json)?+[^\S\n]*+\n.*?(?<=\n)[^\S\n]*+---"
    r"|\+\+\+[^\S\n]*+\n.*?(?<=\n)[^\S\n]*+\+\+\+"
    r"|;;;[^\S\n]*+\n.*?(?<=\n)[^\S\n]*+;;;)[^\S\n]*+(?:\n|\z)"
)

HEADER = T.StructType([
    T.StructField("ok", T.BooleanType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),  # JSON per value
    T.StructField("title", T.StringType()),         # only when it is a string
    T.StructField("title_text", T.StringType()),    # any type, as text
    T.StructField("type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("tag_text", T.StringType()),
])

_WORD = r"(?!(?i:true|false|yes|no|on|off|y|n|null)[ ]*(?:[,\]\n]))[\p{L}_/][^:#,\[\]{}\"'\\&*!|>%@`\p{Cc}]*"
_DATE = r"\d{4}-\d\d-\d\d"
_COUNT = r"[1-9]\d{0,8}"
_LIST = rf"\[ *(?:{_WORD}(?:, *{_WORD})*)? *\]"
_KEY = r"[A-Za-z_][A-Za-z0-9_-]*"
_PLAIN = rf"\A(?:{_KEY}: +(?:{_WORD}|{_DATE}|{_COUNT}|{_LIST})[ ]*\n)*+\z"


def _trimmed(value: str) -> str:
    return value.strip(WHITE_SPACE)


def _go_text(value) -> str:
    """How the value prints as plain text."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + " ".join(_go_text(v) for v in value) + "]"
    if isinstance(value, dict):
        inner = " ".join(f"{k}:{_go_text(v)}" for k, v in sorted(value.items(), key=str))
        return f"map[{inner}]"
    return str(value)


def _yaml_load(block: str):
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover
        raise RuntimeError("nested frontmatter needs PyYAML on the executors") from exc

    class Loader(yaml.SafeLoader):
        pass

    # dates stay text
    Loader.yaml_implicit_resolvers = {
        first: [(tag, rx) for tag, rx in pairs if tag != "tag:yaml.org,2002:timestamp"]
        for first, pairs in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    try:
        return yaml.load(block, Loader)
    except yaml.YAMLError as exc:
        raise ValueError(str(exc)) from exc


def _load(fence: str, block: str):
    if fence in ("+++", "---toml"):
        import tomllib

        return tomllib.loads(block)
    if fence in (";;;", "---json"):
        return json.loads(block)
    return _yaml_load(block)


def read_block(fence: str, block: str) -> dict:
    """One block as the fields of ``HEADER``."""
    out = {f.name: None for f in HEADER.fields} | {"ok": False, "fields": {}, "tags": [], "aliases": []}
    try:
        data = _load(fence, block)
    except (ValueError, TypeError, RecursionError):
        return out
    if data is None:
        data = {}
    if not isinstance(data, dict):
        return out
    data = {str(k): v for k, v in data.items()}
    out["ok"] = True
    out["fields"] = {k: json.dumps(v, ensure_ascii=False, default=str) for k, v in data.items()}
    for name in ("title", "type", "category"):
        if isinstance(data.get(name), str):
            out[name] = data[name]
    if "title" in data:
        out["title_text"] = _trimmed(_go_text(data["title"]))
    tags, aliases = data.get("tags"), data.get("aliases")
    if isinstance(tags, list):
        out["tags"] = list(dict.fromkeys(_trimmed(t) for t in tags if isinstance(t, str) and t))
        out["tag_text"] = ",".join(_go_text(t) for t in tags)
    elif isinstance(tags, str):
        parts = (_trimmed(t) for t in tags.split(","))
        out["tags"] = list(dict.fromkeys(t for t in parts if t))
        out["tag_text"] = tags
    if isinstance(aliases, list):
        out["aliases"] = [_trimmed(a) for a in aliases if isinstance(a, str) and a]
    elif isinstance(aliases, str) and _trimmed(aliases):
        out["aliases"] = [_trimmed(aliases)]
    return out


@F.pandas_udf(HEADER)
def _read_blocks(fence: pd.Series, block: pd.Series) -> pd.DataFrame:
    """Blocks that the native reading leaves; equal ones of a batch are read once, null ones not at all."""
    blank = {f.name: None for f in HEADER.fields}
    known: dict[tuple, dict] = {}
    rows = []
    for key in zip(fence, block):
        if key[1] is None:
            rows.append(blank)
            continue
        if key not in known:
            known[key] = read_block(*key)
        rows.append(known[key])
    return pd.DataFrame(rows, columns=HEADER.names)


def _once(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """Add a struct ``name`` of ``columns``, each computed once.

    The optimizer merges projections, and so repeats an expression at every place that uses it;
    it does not look through a generator.
    """
    return df.withColumn(name, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _plain_header(keys: Column, raw: Column) -> dict[str, Column]:
    """Columns of a block that matches ``_PLAIN``, from the keys and values of its lines."""
    items = lambda v: F.filter(
        F.transform(F.split(F.regexp_replace(v, r"\A\[|\]\z", ""), ","), lambda i: F.trim(i)),
        lambda i: i != "")
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    as_json = F.transform(raw, lambda v: (
        F.when(v.startswith("["), F.concat(
            F.lit("["), F.array_join(F.transform(items(v), quoted), ", "), F.lit("]")))
        .when(v.rlike(rf"\A{_COUNT}\z"), v).otherwise(quoted(v))))

    def value(name: str) -> Column:
        return F.try_element_at(raw, F.nullif(F.array_position(keys, name), F.lit(0)).cast("int"))

    def text(name: str) -> Column:
        v = value(name)
        return F.when(v.startswith("[") | v.rlike(rf"\A{_COUNT}\z"), F.lit(None)).otherwise(v)

    none = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        v = value(name)
        return (F.when(v.startswith("["), items(v)).when(text(name).isNotNull(), F.array(v))
                .otherwise(none))

    tags, title = value("tags"), value("title")
    return {
        "ok": F.lit(True),
        "fields": F.map_from_arrays(keys, as_json),
        "title": text("title"),
        "title_text": F.when(
            title.startswith("["), F.concat(F.lit("["), F.array_join(items(title), " "), F.lit("]"))).otherwise(title),
        "type": text("type"),
        "category": text("category"),
        "tags": F.array_distinct(listed("tags")),
        "aliases": listed("aliases"),
        "tag_text": F.when(tags.startswith("["), F.array_join(items(tags), ",")).otherwise(text("tags")),
    }


def with_header(df: DataFrame, text: str = "content") -> DataFrame:
    """Add ``header`` (``HEADER``; its fields are null where there is no block) and ``body``.

    ``body`` is the text after the block, or the whole text when the block
    cannot be read.  The text is read once; blocks that are not plain go to Python, without their page.
    """
    text_ = strip_bom(F.col(text))
    found = _once(df, "_t", text=text_, whole=F.regexp_extract(text_, WHOLE, 0))
    whole = F.col("_t.whole")
    found = _once(found, "_b", fence=F.regexp_extract(whole, BLOCK, 1), block=F.regexp_replace(F.regexp_replace(whole, BLOCK, ""), r"[^\n]*\n?\z", ""))
    fence, block = F.col("_b.fence"), F.col("_b.block")
    plain = fence.isin("---", "---yaml") & block.rlike(_PLAIN)
    lines = F.when(plain, F.regexp_extract_all(block, F.lit(r"(?md)^([^\n]+)$"), 1))
    found = _once(found, "_l", keys=F.transform(lines, lambda l: F.substring_index(l, ":", 1)), raw=F.transform(lines, lambda l: F.trim(F.regexp_replace(l, r"\A[^:]*: +", ""))))
    keys = F.col("_l.keys")
    kind = F.when(whole == "", 0).when(keys.isNotNull() & (F.size(keys) == F.size(F.array_distinct(keys))), 1).otherwise(2)
    found = _once(found, "_k", kind=kind)
    kind = F.col("_k.kind")
    odd = lambda c: F.when(kind == 2, c)
    read = found.withColumn("_other", _read_blocks(odd(fence), odd(block)))
    fields = _plain_header(keys, F.col("_l.raw"))
    opened = (kind == 1) | F.coalesce(F.col("_other.ok"), F.lit(False))
    after = F.substring(F.col("_t.text"), F.char_length(whole) + 1, F.lit(2**31 - 1))
    header = F.struct(*[F.when(kind == 1, fields[n]).otherwise(F.col("_other")[n]).cast(HEADER[n].dataType).alias(n) for n in HEADER.names])
    parts = _once(read, "_p", body=F.when(opened, after).otherwise(F.col("_t.text")), header=header)
    return parts.select(*df.columns, F.col("_p.body").alias("body"), F.col("_p.header").alias("header"))


def field_count(header: Column) -> Column:
    return F.coalesce(F.size(header["fields"]), F.lit(0))


def has_field(header: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(header["fields"], name), F.lit(False))


def valid_page(header: Column) -> Column:
    """The block reads, is not empty and holds a title that is not blank."""
    return F.coalesce(
        header["ok"] & (field_count(header) > 0) & ~is_blank(header["title_text"]), F.lit(False))


def warnings(content: Column, header: Column) -> Column:
    """What a written page lacks, in a fixed order."""
    missing = ~trim_space(content).startswith("---") | ~F.coalesce(header["ok"], F.lit(True))
    source = F.coalesce(header["type"] == "source", F.lit(False))
    lacks = F.array_compact(F.array(
        F.when(~has_field(header, "title"), F.lit("missing frontmatter field: title")),
        F.when(source & ~has_field(header, "source_path"), F.lit("source page missing field: source_path")),
        F.when(source & ~has_field(header, "ingested_at"), F.lit("source page missing field: ingested_at")),
    ))
    return F.when(missing, F.array(F.lit("missing YAML frontmatter"))).otherwise(lacks)
