"""Joins and top-k that stay even when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is spread once it has more rows than this; each share gets about as many.
ROWS_PER_SHARE = 1_000_000


def key_counts(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    counts: DataFrame | None = None,
    rows_per_share: int = ROWS_PER_SHARE,
) -> DataFrame:
    """Join ``facts`` to the few ``lookup`` rows of their key, any key size.

    ``counts`` (``key``, ``_rows``) tells how many fact rows a key has; pass it
    where it is known already.  Without hot keys this is a plain join.  Otherwise each hot key, however
    many there are, is cut into shares by a hash of the row, and its lookup rows are repeated once per share,
    so that one key is joined by many tasks.  The hot keys are a table, never fetched; there is at most one for
    every ``rows_per_share`` rows.
    """
    counts = key_counts(facts, key) if counts is None else counts
    hot = counts.where(F.col("_rows") > rows_per_share).select(
        F.col(key).alias("_hot"), F.ceil(F.col("_rows") / rows_per_share).cast("int").alias("_n"))
    if hot.isEmpty():
        return facts.join(lookup, key, how)
    flat = [F.col(f"`{n}`") for n, t in facts.dtypes if n != key and not t.startswith(("map", "struct", "array", "binary"))]
    row = F.xxhash64(*flat or [F.lit(0)])
    share = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(row, F.col("_n")).cast("int"))
    left = facts.join(hot, facts[key] == F.col("_hot"), "left").withColumn("_share", share).drop("_hot", "_n")
    right = (
        lookup.join(hot, lookup[key] == F.col("_hot"), "left")
        .withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
        .drop("_hot", "_n")
    )
    return left.join(right, [key, "_share"], how).drop("_share")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key.

    Spark cuts each task's rows to ``k`` per key before the shuffle (window
    group limit), so a key with very many rows sends only ``k`` per task.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ordered)).where(F.col(rank) <= k)
