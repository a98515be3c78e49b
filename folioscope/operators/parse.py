"""One pass from page text to columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import header as hd
from folioscope.functions import links as ln
from folioscope.functions import text as tx
from folioscope.operators.rows import unnest
from folioscope.session import written


def page_title(header: Column, body: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(header["title"], F.lit("")), tx.heading_title(body), tx.file_title(path))


def parse_pages(pages: DataFrame, dialect: str = "wikilink") -> DataFrame:
    """Columns of every page; select what you need, the rest is not computed.

    ``pages`` has ``path`` and ``content``; other columns are kept.  ``dialect``
    is ``wikilink`` (double-bracket links, inline tags, fields) or ``markdown``.
    """
    body, header, path = F.col("body"), F.col("header"), F.col("path")
    none = F.array().cast("array<string>")
    tags = F.coalesce(header["tags"], none)
    if dialect == "wikilink":
        links, attachments = ln.wikilinks(body)
        tags = F.array_distinct(F.concat(tags, ln.inline_tags(body)))
        fields = ln.fields(body)
    elif dialect == "markdown":
        links, attachments = ln.markdown_links(body)
        fields = F.create_map().cast("map<string,string>")
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    return hd.with_header(pages).withColumns({
        "title": page_title(header, body, path),
        "type": F.coalesce(header["type"], F.lit("")),
        "category": tx.normalize_category(header["category"]),
        "tags": tags,
        "aliases": F.coalesce(header["aliases"], none),
        "links": links,
        "attachments": attachments,
        "fields": fields,
        "valid": hd.valid_page(header),
        "warnings": hd.warnings(F.col("content"), header),
        "source_type": F.lit("obsidian" if dialect == "wikilink" else "markdown"),
    })


PARSED = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("type", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("attachments", T.ArrayType(T.StringType())), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
])


def parse_with(pages: DataFrame, parser: Callable[[str, str], dict], name: str) -> tuple[DataFrame, DataFrame]:
    """``(parsed, errors)``: pages by a parser of your own, for dialects besides the two.

    ``parser(path, content)`` returns the fields of ``PARSED`` (those it leaves out are empty) and raises where a page cannot be
    parsed: the page then is a row ``(path, message)`` of ``errors``, and the others go on.  A title left
    out is the file's name; categories are normalised.  ``name`` becomes ``source_type``.  It runs once a page, over Arrow batches of paths and
    texts; the result is stored, as both tables are read from it.
    """
    blank = {f.name: [] if isinstance(f.dataType, T.ArrayType) else {} if isinstance(f.dataType, T.MapType) else "" for f in PARSED.fields}
    schema = T.StructType([T.StructField("path", T.StringType()), *PARSED.fields, T.StructField("message", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    found = blank | {k: v for k, v in parser(path, content).items() if k in blank and v is not None}
                    rows.append({"path": path, **found, "message": None})
                except Exception as exc:  # noqa: BLE001 - one page must not end the job
                    rows.append({"path": path, **blank, "message": f"{type(exc).__name__}: {exc}"})
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    rows = written(pages.select("path", "content").mapInPandas(run, schema), "parsed_with")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), tx.file_title(F.col("path")))
    good = rows.where(F.col("message").isNull()).drop("message").withColumns({
        "title": title, "category": tx.normalize_category(F.col("category")), "tags": F.array_distinct("tags"), "source_type": F.lit(name)})
    return good, rows.where(F.col("message").isNotNull()).select("path", "message")


def index_rows(pages: DataFrame, dialect: str = "wikilink") -> DataFrame:
    """Rows of the stored ``pages`` table from ``path, content, size, mtime, indexed_at``."""
    parsed = parse_pages(pages.withColumn("content_hash", tx.content_hash(F.col("content"))), dialect)
    return parsed.select(
        "path", "title", "type", "category", "tags", "content", "content_hash", "size", "mtime", "indexed_at")


def link_rows(parsed: DataFrame) -> DataFrame:
    """``(path, link)``, one row per distinct link of a page."""
    return unnest(parsed, "links", "link", "path")


def tag_rows(parsed: DataFrame) -> DataFrame:
    return unnest(parsed, "tags", "tag", "path")
