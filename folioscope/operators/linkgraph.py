"""Link resolution and what follows from it: edges, broken links, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import paths as pt
from folioscope.operators.skew import key_counts, lookup_join


def resolve_names(names: DataFrame, pages: DataFrame) -> DataFrame:
    """``(link, target)`` for the distinct ``link`` texts that name a page.

    Candidates in order: ``link.md``, ``sources/link.md``, ``link`` itself, then
    the first page whose file name is the link without regard to case.
    """
    link = F.col("link")
    exact = names.select("link", F.posexplode(F.array(
        F.concat(link, F.lit(".md")),
        pt.clean(F.concat(F.lit("sources/"), link, F.lit(".md"))),
        link,
    )).alias("order", "path"))
    by_path = exact.join(pages.select("path"), "path").select("link", "order", F.col("path").alias("target"))

    by_base = pages.groupBy(F.lower(F.regexp_replace(pt.base_name(F.col("path")), r"\.md\z", "")).alias("base")).agg(
        F.min("path").alias("target"))
    folded = names.select("link", F.lower("link").alias("base")).join(by_base, "base").select(
        "link", F.lit(3).alias("order"), "target")
    return by_path.unionByName(folded).groupBy("link").agg(
        F.min_by("target", F.struct("order", "target")).alias("target"))


def resolved_links(links: DataFrame, pages: DataFrame, how: str = "inner") -> DataFrame:
    """``(link, path, target)``; with ``how='left'`` broken links have no target.

    Each distinct text is resolved once, however many pages use it.
    """
    counts = key_counts(links, "link")
    targets = resolve_names(counts.select("link"), pages)
    return lookup_join(links, targets, "link", how, counts=counts)


def graph_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per resolved link; two texts that name one page give two rows."""
    return resolved_links(links, pages).select(F.col("path").alias("source"), "target")


def graph_nodes(pages: DataFrame) -> DataFrame:
    return pages.select("path", display_title().alias("title"), F.coalesce("type", F.lit("")).alias("type"))


def display_title():
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("path"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return resolved_links(links, pages, "left").where(F.col("target").isNull()).select("path", "link")


def linked_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct pages some link resolves to; needs no join back to the links."""
    return resolve_names(links.select("link").distinct(), pages).select(F.col("target").alias("path")).distinct()


def orphan_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages no link resolves to, but for the two special pages and sources."""
    kept = pages.where(
        ~F.col("path").isin(pt.SCHEMA_PAGE, pt.INDEX_PAGE) & (F.coalesce("type", F.lit("")) != "source"))
    return kept.select("path").join(linked_pages(links, pages), "path", "left_anti")


def shared_names(rows: DataFrame, name: str) -> DataFrame:
    """``(name, path, n_pages)`` for names that at least two pages use."""
    counts = key_counts(rows, name)
    shared = counts.where(F.col("_rows") >= 2).select(name, F.col("_rows").alias("n_pages"))
    return lookup_join(rows, shared, name, counts=counts)
