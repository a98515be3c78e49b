"""Path listings and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import paths as pt


def visible(pages: DataFrame, exclude: Sequence[str]) -> DataFrame:
    return pages.where(~pt.excluded(F.col("path"), exclude))


def list_children(pages: DataFrame, prefix: str = ".", exclude: Sequence[str] = ()) -> DataFrame:
    """One level below ``prefix``: folders end in '/', files carry their columns."""
    lead = "" if prefix in (".", "") else prefix.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(lead) + 1, 2**31 - 1)
    below = pages.where(F.col("path").startswith(lead) & (F.col("path") != lead))
    name = F.substring_index(rest, "/", 1)
    child = below.select(
        F.concat(F.lit(lead), name).alias("child"), name.alias("name"),
        F.contains(rest, F.lit("/")).alias("is_dir"), "title", "type", "category")
    child = child.where(~pt.excluded(F.col("child"), exclude))
    shown = lambda c: F.when(F.col("is_dir"), F.lit("")).otherwise(F.coalesce(c, F.lit(""))).alias(c)
    return child.groupBy("child", "name", "is_dir").agg(
        F.max("title").alias("title"), F.max("type").alias("type"), F.max("category").alias("category"),
    ).select(
        F.when(F.col("is_dir"), F.concat("child", F.lit("/"))).otherwise(F.col("child")).alias("path"),
        "name", "is_dir", shown("title"), shown("type"), shown("category"))


def scan_prefix(pages: DataFrame, folder: str = "", exclude: Sequence[str] = ()) -> DataFrame:
    """Every visible Markdown page at or below ``folder``."""
    rows = visible(pages.where(pt.is_markdown(F.col("path"))), exclude)
    if folder:
        rows = rows.where(pt.under(F.col("path"), folder))
    return rows.select("path")


def lookup_pages(requests: DataFrame, pages: DataFrame, exclude_read: Sequence[str] = ()) -> DataFrame:
    """The requested pages; ``found`` tells which exist, ``status`` why not."""
    denied = pt.excluded(F.col("path"), exclude_read)
    wanted = requests.select(pt.page_path(F.col("path")).alias("path")).distinct()
    hit = pages.select("*", F.lit(True).alias("_hit"))
    return wanted.join(hit, "path", "left").select(
        "path",
        F.when(denied, "denied").when(F.col("_hit").isNull(), "not-found").otherwise("found").alias("status"),
        *[F.when(~denied, F.col(c)).alias(c) for c in pages.columns if c != "path"])


def lookup_vectors(requests: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors of the requested ``(path, model)`` pairs."""
    return embeddings.join(requests.select("path", "model").distinct(), ["path", "model"], "left_semi")


def existing(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """``(path, present)`` for each distinct requested path."""
    wanted = requests.select("path").distinct()
    return wanted.join(pages.select("path", F.lit(True).alias("present")), "path", "left").select(
        "path", F.coalesce("present", F.lit(False)).alias("present"))
