"""Questions asked of the processing ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators.changes import latest_per_key
from folioscope.operators.skew import key_counts, lookup_join

KEY = ["source_path", "content_hash"]


def with_previous(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries with the ledger row of the same path and content, if any."""
    previous = ledger.select(*KEY, *[
        F.col(c).alias(f"prev_{c}") for c in ("wiki_page", "status", "attempts", "last_error", "llm_model")])
    return entries.join(previous, KEY, "left")


def with_page_present(rows: DataFrame, pages: DataFrame, page: str = "prev_wiki_page") -> DataFrame:
    """Add ``page_present``.  Rows without a page name get a key of their own,
    so that they do not all meet in one task."""
    named = pages.select(F.col("path").alias("_page"), F.lit(True).alias("page_present"))
    name = F.coalesce(F.nullif(F.col(page), F.lit("")), F.concat(F.lit("\x00"), F.col("source_path")))
    return rows.join(named, name == F.col("_page"), "left").drop("_page").withColumn(
        "page_present", F.coalesce("page_present", F.lit(False)))


def upserted(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of each (path, content)."""
    return latest_per_key(rows, KEY, order)


def superseded(ledger: DataFrame, order: str = "digested_at") -> DataFrame:
    """At most one ``success`` per source: all but the latest become ``superseded``."""
    wins = ledger.where(F.col("status") == "success")
    latest = wins.groupBy("source_path").agg(
        F.max(F.struct(F.col(order), F.col("content_hash"))).alias("_last"), F.count(F.lit(1)).alias("_n"))
    several = latest.where(F.col("_n") > 1).select("source_path", "_last")
    rows = lookup_join(ledger, several, "source_path", "left")
    old = (F.col("status") == "success") & (F.struct(F.col(order), F.col("content_hash")) != F.col("_last"))
    return rows.withColumn(
        "status", F.when(F.coalesce(old, F.lit(False)), "superseded").otherwise(F.col("status"))
    ).select(*ledger.columns)


def missing_sources(ledger: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Success rows whose file is no longer in the folder snapshot."""
    return ledger.where(F.col("status") == "success").join(
        snapshot.select("source_path").distinct(), "source_path", "left_anti")


def page_claims(ledger: DataFrame) -> DataFrame:
    """``(wiki_page, first, last)``: the span of sources that name a page."""
    return ledger.where(F.coalesce("wiki_page", F.lit("")) != "").groupBy("wiki_page").agg(
        F.min("source_path").alias("first"), F.max("source_path").alias("last"))


def taken_by_other(rows: DataFrame, ledger: DataFrame, page: str = "wiki_page") -> DataFrame:
    """Add ``taken``: some other source (in any state) already names this page.

    A page's claimants are reduced to the first and last source first: another
    source exists exactly when one of the two is not the row's own.
    """
    claims = page_claims(ledger).withColumnRenamed("wiki_page", page)
    joined = lookup_join(rows, claims, page, "left")
    own = F.col("source_path")
    return joined.withColumn(
        "taken", F.coalesce((F.col("first") != own) | (F.col("last") != own), F.lit(False))).drop("first", "last")


def assign_pages(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``wiki_page`` to successful rows ``(source_path, content_hash)``.

    A base name goes to the first source by path that may have it: nobody else
    claims it in the ledger.  The others get a suffix from their path.
    """
    slug = tx.slug_for(F.col("source_path"), F.col("content_hash"))
    named = rows.withColumn("slug", slug).withColumn(
        "base", F.concat(F.lit("sources/"), F.col("slug"), F.lit(".md")))
    flagged = taken_by_other(named, ledger, "base")
    winner = flagged.where(~F.col("taken")).groupBy("base").agg(F.min("source_path").alias("_winner"))
    joined = lookup_join(flagged, winner, "base", "left", counts=key_counts(named, "base"))
    wins = F.coalesce(F.col("source_path") == F.col("_winner"), F.lit(False))
    suffixed = F.concat(F.lit("sources/"), F.col("slug"), F.lit("-"), tx.hash8(F.col("source_path")), F.lit(".md"))
    return joined.withColumn("wiki_page", F.when(wins, F.col("base")).otherwise(suffixed)).drop(
        "slug", "base", "taken", "_winner")


def status_report(ledger: DataFrame) -> DataFrame:
    """Rows per status and origin with the share of all rows."""
    total = ledger.agg(F.count(F.lit(1))).scalar()
    return ledger.groupBy("status", "run_origin").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.col("n") / total)
