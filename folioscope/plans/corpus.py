"""Jobs over the whole corpus: consistency, lint, graph, concept and index pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import header as hd
from folioscope.functions import paths as pt
from folioscope.operators import linkgraph as lg
from folioscope.operators.assemble import LINES_PER_PART, assemble, member_line, numbered
from folioscope.operators.changes import apply_changes, change_class
from folioscope.operators.parse import index_rows, link_rows, parse_pages, tag_rows
from folioscope.operators.rows import unnest
from folioscope.operators.skew import key_counts, lookup_join
from folioscope.session import broadcast_if_small, written


# --- consistency -----------------------------------------------------------

def check_consistency(scan: DataFrame, pages: DataFrame, content: DataFrame | Callable, now: Column,
                      dialect: str = "wikilink") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(changes, new_pages, errors)``.

    ``scan`` is the metadata-only listing ``(path, size, mtime)``.  ``content``
    is a table ``(path, content)``, or a function that reads the content of the
    rows it is given; either way only changed files are read.  A changed file
    without content is an error and keeps its old row.
    """
    changes = written(change_class(scan, pages), "changes")
    wanted = changes.where(F.col("change").isin("added", "updated")).join(scan, "path")
    wanted = written(wanted.select("path", "size", "mtime"), "changed")
    if callable(content):
        got = content(wanted)
    else:
        got = content.select("path", "content").join(broadcast_if_small(wanted), "path")
    got = got.where(F.col("content").isNotNull())
    errors = wanted.join(got.select("path"), "path", "left_anti").select(
        "path", F.concat(F.lit("read: "), "path").alias("error"))
    fresh = index_rows(got.select("path", "content", "size", "mtime", now.alias("indexed_at")), dialect)
    ops = fresh.select("*", F.lit("upsert").alias("op"), F.lit(1).alias("seq"))
    gone = changes.where(F.col("change") == "removed").select(
        "path", *[F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in fresh.columns if c != "path"],
        F.lit("delete").alias("op"), F.lit(1).alias("seq"))
    # the schema page is protected from writes, not from indexing
    updated = apply_changes(pages, ops.unionByName(gone), protected=(), unique=True)
    return changes, updated, errors


def rebuild(scan: DataFrame, now: Column, dialect: str = "wikilink") -> DataFrame:
    """All pages parsed anew from ``path, content, size, mtime``."""
    return index_rows(scan.withColumn("indexed_at", now), dialect)


# --- lint ------------------------------------------------------------------

def frontmatter_issues(parsed: DataFrame) -> DataFrame:
    header = F.col("header")
    source = F.coalesce(header["type"] == "source", F.lit(False))
    found = F.array_compact(F.array(
        F.when(F.col("title") == "", F.lit("missing title")),
        F.when(~hd.has_field(header, "type"), F.lit("missing type field")),
        *[F.when(source & ~hd.has_field(header, f), F.lit(f"source page missing {f}"))
          for f in ("source_path", "ingested_at")]))
    return unnest(parsed.where(F.col("path") != pt.SCHEMA_PAGE), found, "message",
                  "path", F.lit("frontmatter").alias("kind"))


def lint(parsed: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``(path, kind, message)``: parse, frontmatter, broken-link and orphan issues.

    ``parsed`` is the output of ``parse_pages``, best stored once.  ``errors``
    holds ``(path, message)`` of pages that could not be read.
    """
    links = link_rows(parsed)
    typed = parsed.select("path", "type")
    broken = lg.broken_links(links, typed).select(
        "path", F.lit("broken-link").alias("kind"),
        F.concat(F.lit("[["), "link", F.lit("]] not found")).alias("message"))
    orphans = lg.orphan_pages(links, typed).select(
        "path", F.lit("orphan").alias("kind"), F.lit("no incoming links").alias("message"))
    issues = frontmatter_issues(parsed).unionByName(broken).unionByName(orphans)
    if errors is not None:
        issues = issues.unionByName(errors.select("path", F.lit("parse").alias("kind"), "message"))
    return issues


def lint_summary(issues: DataFrame) -> DataFrame:
    """Issues per kind and in all (``kind`` 'total'); ``failed`` under strict rules."""
    return issues.rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("kind", F.lit("total")).alias("kind"), "n", (F.col("n") > 0).alias("failed"))


# --- graph -----------------------------------------------------------------

def link_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``."""
    return lg.graph_nodes(parsed.select("path", "title", "type")), lg.graph_edges(
        link_rows(parsed), parsed.select("path"))


# --- generated pages -------------------------------------------------------

def concept_slug(name: Column, kind: str) -> Column:
    if kind == "link":
        return F.concat(F.lit("concepts/"), F.lower(F.replace(name, F.lit(" "), F.lit("-"))), F.lit(".md"))
    return F.concat(F.lit("concepts/tag-"), F.lower(F.replace(name, F.lit("/"), F.lit("-"))), F.lit(".md"))


def new_concepts(links: DataFrame, tags: DataFrame, pages: DataFrame) -> DataFrame:
    """``(slug, kind, name, n_pages)`` of concept pages to create.

    A slug that exists is skipped; of two names with one slug links come before
    tags, then the first name.
    """
    def shared(rows: DataFrame, name: str, kind: str, order: int) -> DataFrame:
        return key_counts(rows, name).where(F.col("_rows") >= 2).select(
            concept_slug(F.col(name), kind).alias("slug"), F.lit(order).alias("order"),
            F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("_rows").alias("n_pages"))

    names = shared(links, "link", "link", 0).unionByName(shared(tags, "tag", "tag", 1))
    first = names.groupBy("slug").agg(F.min(F.struct("order", "name", "kind", "n_pages")).alias("_c"))
    free = first.join(pages.select(F.col("path").alias("slug")), "slug", "left_anti")
    return free.select("slug", F.col("_c.kind").alias("kind"), F.col("_c.name").alias("name"),
                       F.col("_c.n_pages").alias("n_pages"))


def synthesize(parsed: DataFrame, today: str, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """New concept pages ``(path, part, content)``, one per shared link or tag.

    ``parsed`` is the output of ``parse_pages``, best stored once.
    """
    members = [
        unnest(parsed, column, "name", "path", F.lit(kind).alias("kind"), lg.display_title().alias("title"))
        for kind, column in (("link", "links"), ("tag", "tags"))]
    concepts = new_concepts(link_rows(parsed), tag_rows(parsed), parsed.select("path"))
    mark = F.when(F.col("kind") == "tag", F.lit("#")).otherwise(F.lit(""))
    shown = F.when(F.col("kind") == "tag", F.concat(F.lit('"#'), "name", F.lit('"'))).otherwise(F.col("name"))
    count = F.when(F.col("kind") == "tag", F.lit("Tagged in")).otherwise(F.lit("Referenced by"))
    heads = concepts.select(F.col("slug").alias("path"), F.concat(
        F.lit("---\ntitle: "), shown, F.lit(f"\ntype: concept\ngenerated_at: {today}\n---\n\n# "), mark, "name",
        F.lit("\n\n_"), count, F.lit(" "), F.col("n_pages").cast("string"), F.lit(" pages._\n\n")).alias("head"))

    # the chosen concepts carry their sizes, so hot ones are spread without a count
    key = F.concat("kind", F.lit(":"), "name")
    sizes = concepts.select(key.alias("_key"), "slug", F.col("n_pages").alias("_rows"))
    chosen = lookup_join(
        members[0].unionByName(members[1]).withColumn("_key", key), sizes.select("_key", "slug"), "_key",
        counts=sizes.select("_key", "_rows"))
    lines = chosen.select(
        F.col("slug").alias("path"), F.col("path").alias("sort_key"),
        member_line(F.col("path"), F.col("title")).alias("line"))
    return assemble(heads, lines, lines_per_part)


def indexed_members(pages: DataFrame) -> DataFrame:
    """Pages that the index page lists: all but the two special ones."""
    return pages.where(~F.col("path").isin(pt.SCHEMA_PAGE, pt.INDEX_PAGE))


def recent_members(pages: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Sources indexed in the last ``days``, which the summary page lists."""
    age = F.unix_micros(now) - F.unix_micros("indexed_at")
    return pages.where(F.col("path").startswith("sources/") & (age < days * 86_400_000_000))


def listings(pages: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(counts, members)`` of both generated lists: ``(listing, n)`` and ``(listing, nth, path, title)`` in path order.

    Members are rows, numbered by one distributed sort; no cell holds a list.
    """
    both = indexed_members(pages).select(F.lit("index").alias("path"), F.col("path").alias("sort_key"), lg.display_title().alias("line")).unionByName(
        recent_members(pages, now, days).select(F.lit("digest").alias("path"), F.col("path").alias("sort_key"), lg.display_title().alias("line")))
    rows = numbered(both)
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(F.col("path").alias("listing"), "n")
    return counts, rows.select(F.col("path").alias("listing"), (F.col("number") + 1).alias("nth"), F.col("sort_key").alias("path"), F.col("line").alias("title"))


def page_list(members: DataFrame, target: str, head: Column, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """One generated page that lists ``members`` ``(path, title)`` in path order; they are read once."""
    members = written(members.select("path", "title"), "members")
    lines = members.select(
        F.lit(target).alias("path"), F.col("path").alias("sort_key"),
        member_line(F.col("path"), lg.display_title()).alias("line"))
    counts = members.agg(F.count(F.lit(1)).alias("_rows")).select(F.lit(target).alias("path"), "_rows")
    heads = counts.select("path", head.alias("head"))
    return assemble(heads, lines, lines_per_part)


def digest_recent(pages: DataFrame, now: Column, today: str, days: int = 7,
                  lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """The summary page of sources indexed in the last ``days``; none, no page."""
    recent = recent_members(pages, now, days)
    head = F.concat(
        F.lit(f"---\ntitle: Weekly Digest {today}\ntype: synthesis\ngenerated_at: {today}\n---\n\n"
              f"# Weekly Digest — {today}\n\n_Recent {days} day(s), "),
        F.col("_rows").cast("string"), F.lit(" source(s)._\n\n"))
    return page_list(recent, f"digests/weekly-{today}.md", head, lines_per_part)


def build_index_page(pages: DataFrame, today: str, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """The index page of all but the two special pages.

    An empty corpus gives a page without entries.
    """
    listed = written(indexed_members(pages).select("path", "title"), "listed")
    head = F.concat(
        F.lit(f"---\ntitle: Index\ntype: index\n---\n\n# Wiki Index\n\n_Generated {today}. "),
        F.col("_rows").cast("string"), F.lit(" pages._\n\n"))
    made = page_list(listed, pt.INDEX_PAGE, head, lines_per_part)
    empty = listed.agg(F.count(F.lit(1)).alias("_rows")).where("_rows = 0").select(
        F.lit(pt.INDEX_PAGE).alias("path"), F.lit(0).cast("bigint").alias("part"), head.alias("content"))
    return made.unionByName(empty)
