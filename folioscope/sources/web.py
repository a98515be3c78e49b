"""Captured web pages as Markdown sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import hash8

# fixed values: body cap in bytes, slug cap in bytes
MAX_BODY = 10 << 20
SLUG_BYTES = 80


def _head_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes, and whole characters: a cut steps back over continuation bytes."""
    data = F.encode(text, "UTF-8")

    def inside(at: int) -> Column:
        """Whether the byte at ``at`` (from 1) continues a character."""
        return F.hex(F.substring(data, at, 1)).rlike("^[89AB]")

    size = F.when(~inside(limit + 1), limit).when(~inside(limit), limit - 1).when(~inside(limit - 1), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) > limit, F.substring(data, F.lit(1), F.greatest(size, F.lit(0))).cast("string")).otherwise(text)


def url_slug(url: Column) -> Column:
    """File name of a captured address: its path, else its host, else a hash."""
    host = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    raw = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.btrim(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit("/"))
    name = F.replace(F.replace(F.when(path == "", host).otherwise(path), F.lit("/"), F.lit("-")), F.lit(" "), F.lit("-"))
    return F.concat(F.lit("web-"), F.coalesce(_head_bytes(name, SLUG_BYTES), hash8(url)))


def capture_web(pages: DataFrame, today: str, max_body: int = MAX_BODY) -> DataFrame:
    """``(name, url, content)`` from ``(url, html)``: frontmatter, then at most ``max_body`` bytes of the body."""
    name = F.when(url_slug(F.col("url")).endswith(".md"), url_slug(F.col("url"))).otherwise(
        F.concat(url_slug(F.col("url")), F.lit(".md")))
    return pages.select(
        name.alias("name"), "url",
        F.concat(F.lit("---\nsource_url: "), "url", F.lit(f"\nfetched_at: {today}\n---\n\n"),
                 _head_bytes(F.col("html"), max_body)).alias("content"))
