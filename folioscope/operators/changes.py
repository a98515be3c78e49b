"""Keyed change application and comparison of two states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import paths as pt


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key (an upsert); of equal ones, one of them.

    One aggregate with map-side combine: for rows of narrow columns.  A null ``order`` comes first.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*[k if k in keys else F.col("_row")[k].alias(k) for k in rows.columns])


def last_changes(changes: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The last change of each key, for rows of any width.  No two changes of a key may have one ``order``.

    The winner is found on narrow columns; wide ones are neither sorted nor held in an aggregate.
    """
    best = changes.groupBy(*keys).agg(F.max(order).alias("_best"))
    same = [changes[k].eqNullSafe(best[k]) for k in keys]
    return changes.join(best, [*same, changes[order] == best["_best"]], "left_semi")


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str] = ("path",),
    protected: Sequence[str] = (pt.SCHEMA_PAGE,),
    unique: bool = False,
) -> DataFrame:
    """``base`` after the last change of each key.

    ``changes`` has the columns of ``base`` plus ``op`` (``upsert`` or
    ``delete``) and ``seq``, the place in the log (a number no other change of the key has).  With ``unique`` each key
    changes once at most.  Changes to protected paths are ignored.  For moves see ``operators/moves.py``.
    """
    allowed = changes.where(~F.col(keys[0]).isin(list(protected))) if protected else changes
    last = allowed if unique else last_changes(allowed, keys)
    kept = base.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.where(F.col("op") == "upsert").select(*base.columns))


def _denied(path: Column, protected: Sequence[str], exclude_read: Sequence[str]) -> Column:
    """Pages that may not be changed: protected ones and those no one may read."""
    name = pt.page_path(path)
    return name.isin(list(protected)) | pt.excluded(name, exclude_read)


def write_ops(pages: DataFrame, protected: Sequence[str] = (pt.SCHEMA_PAGE,), exclude_read: Sequence[str] = ()) -> DataFrame:
    """Outcome of writing each page: ``status, bytes`` (``path, content`` in)."""
    denied = _denied(F.col("path"), protected, exclude_read)
    return pages.select(
        "path",
        F.when(denied, F.lit("denied")).otherwise(F.lit("written")).alias("status"),
        F.when(denied, F.lit(None)).otherwise(F.octet_length("content")).cast("bigint").alias("bytes"),
    )


def delete_pages(
    pages: DataFrame, doomed: DataFrame, protected: Sequence[str] = (pt.SCHEMA_PAGE,), exclude_read: Sequence[str] = ()
) -> DataFrame:
    """Pages (or vectors) that remain when the ``doomed`` paths are deleted."""
    allowed = doomed.where(~_denied(F.col("path"), protected, exclude_read)).select(pt.page_path(F.col("path")).alias("path"))
    return pages.join(allowed, "path", "left_anti")


def delete_outcomes(
    pages: DataFrame, doomed: DataFrame, protected: Sequence[str] = (pt.SCHEMA_PAGE,), exclude_read: Sequence[str] = ()
) -> DataFrame:
    """``(path, status)`` of each path asked to be deleted: denied, not-found or deleted."""
    asked = doomed.select(pt.page_path(F.col("path")).alias("path")).distinct()
    there = pages.select("path", F.lit(True).alias("_there"))
    status = F.when(_denied(F.col("path"), protected, exclude_read), "denied").when(F.col("_there").isNull(), "not-found").otherwise("deleted")
    return asked.join(there, "path", "left").select("path", status.alias("status"))


def move_pages(
    pages: DataFrame, moves: DataFrame, protected: Sequence[str] = (pt.SCHEMA_PAGE,), exclude_read: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(moved_pages, outcome)`` for moves ``(src, dst)``.

    A move needs an existing source and a free target, neither protected nor excluded from reading.  Of
    several moves to one target the first source by name gets it; of several
    from one source the first target by name is used.  Paths are compared in their stored form.
    """
    moves = moves.select(pt.page_path(F.col("src")).alias("src"), pt.page_path(F.col("dst")).alias("dst"))
    outcome = (
        moves.groupBy("src").agg(F.min("dst").alias("dst"))
        .join(pages.select(F.col("path").alias("src"), F.lit(True).alias("_there")), "src", "left")
        .join(pages.select(F.col("path").alias("dst"), F.lit(True).alias("_taken")), "dst", "left")
    )
    status = (
        F.when(_denied(F.col("src"), protected, exclude_read) | _denied(F.col("dst"), protected, exclude_read), "denied")
        .when(F.col("_there").isNull(), "not-found")
        .when(F.col("_taken").isNotNull(), "exists")
        .otherwise("moved")
    )
    outcome = outcome.select("src", "dst", status.alias("status"))
    first = outcome.where(F.col("status") == "moved").groupBy("dst").agg(F.min("src").alias("src"))
    moved = pages.join(first.select(F.col("src").alias("path"), "dst"), "path", "left").withColumn(
        "path", F.coalesce("dst", "path")).drop("dst")
    won = first.select("src", "dst", F.lit(True).alias("_won"))
    outcome = outcome.join(won, ["src", "dst"], "left").select(
        "src", "dst",
        F.when((F.col("status") == "moved") & F.col("_won").isNull(), "exists")
        .otherwise(F.col("status")).alias("status"))
    return moved.select(*pages.columns), outcome


def change_class(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(path, change)``: added, removed, updated or unchanged.

    Only size and modification time are compared; content is not read.
    """
    left = scan.select("path", F.col("size").alias("_s1"), F.col("mtime").alias("_m1"), F.lit(True).alias("_scan"))
    right = indexed.select("path", F.col("size").alias("_s2"), F.col("mtime").alias("_m2"), F.lit(True).alias("_idx"))
    same = F.col("_s1").eqNullSafe(F.col("_s2")) & F.col("_m1").eqNullSafe(F.col("_m2"))
    return left.join(right, "path", "full_outer").select(
        "path",
        F.when(F.col("_idx").isNull(), "added").when(F.col("_scan").isNull(), "removed")
        .when(same, "unchanged").otherwise("updated").alias("change"))


def change_counts(changes: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return changes.agg(n("added"), n("removed"), n("updated"))


def refresh_due(last_refresh: Column, now: Column, interval_s: int = 5, force: bool = False) -> Column:
    """Whether a refresh is due: never refreshed, old enough, or forced."""
    if force:
        return F.lit(True)
    age = F.unix_micros(now) - F.unix_micros(last_refresh)
    return F.coalesce(age >= interval_s * 1_000_000, F.lit(True))
