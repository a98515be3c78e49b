"""Column expressions over paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DEFAULT_EXCLUDE = [".obsidian", ".trash"]
ARCHIVE_PREFIX = "sources/_archived"
SCHEMA_PAGE = "_schema.md"
INDEX_PAGE = "_index.md"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot of the last component onwards, or ''."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "")


def clean(path: Column) -> Column:
    """Lexically shortest form: no empty or '.' parts, '..' resolved."""
    rooted = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        n = F.size(kept)
        last = F.try_element_at(kept, F.lit(-1))
        return (
            F.when(part.isin("", "."), kept)
            .when((part == "..") & (n > 0) & (last != ".."), F.slice(kept, F.lit(1), n - 1))
            .when((part == "..") & rooted, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    joined = F.array_join(
        F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    full = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)
    needs = path.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(needs, F.when(full == "", F.lit(".")).otherwise(full)).otherwise(path)


def page_path(path: Column) -> Column:
    """Stored form of a page path: cleaned, with forward slashes."""
    return F.replace(clean(path), F.lit("\\"), F.lit("/"))


def effective_exclude(
    exclude: Sequence[str] = tuple(DEFAULT_EXCLUDE), exclude_read: Sequence[str] = ()
) -> list[str]:
    """Prefixes hidden from scans: the archive is always among them, once."""
    hidden = list(exclude)
    if ARCHIVE_PREFIX not in hidden:
        hidden.append(ARCHIVE_PREFIX)
    return hidden + list(exclude_read)


def under(path: Column, prefix: str) -> Column:
    """``path`` is ``prefix`` or lies below it (whole components)."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def excluded(path: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | under(path, prefix)
    return hit


def is_markdown(path: Column) -> Column:
    return F.lower(path).endswith(".md")
