"""Page text from list lines, for lists of any length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import written

# Lines of a list in one row.
LINES_PER_PART = 20_000


def member_line(path, title):
    """A list entry that links to a page under its title."""
    link = F.regexp_replace(path, r"\.md\z", "")
    return F.concat(F.lit("- [["), link, F.lit("|"), title, F.lit("]]\n"))


def numbered(lines: DataFrame) -> DataFrame:
    """``path, sort_key, line`` with ``number``, a line's place in its list from 0.

    Lines are numbered by one distributed sort: each task numbers what it holds of a list, and starts where
    the tasks before it ended.
    """
    ranged = lines.select("path", "sort_key", "line").repartitionByRange("path", "sort_key").sortWithinPartitions("path", "sort_key", "line")
    stored = written(ranged.withColumns({"_task": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "lines")
    held = stored.groupBy("path", "_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of a page
    starts = held.select("path", "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return stored.join(starts, ["path", "_task"]).select("path", "sort_key", "line", (F.col("_id") + F.col("_shift")).alias("number"))


def assemble(heads: DataFrame, lines: DataFrame, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """``(path, part, content)``: each head followed by its lines in order.

    ``heads`` has ``path, head``; ``lines`` has ``path, sort_key, line``.  A page is its
    rows in order of ``part``: lines ``part * lines_per_part`` and on, the head before those of
    part 0.  A page without lines has no row.  Parts depend on the
    order alone, and no task or cell holds a whole list.
    """
    rows = numbered(lines).select("path", F.floor(F.col("number") / lines_per_part).alias("part"), "number", "line")
    entries = F.array_sort(F.collect_list(F.struct("number", "line")))
    text = rows.groupBy("path", "part").agg(F.array_join(F.transform(entries, lambda e: e["line"]), "").alias("lines"))
    first = heads.select("path", "head", F.lit(0).cast("bigint").alias("part"))
    return text.join(first, ["path", "part"], "left").select("path", "part", F.concat(F.coalesce("head", F.lit("")), "lines").alias("content"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, state = None, None
    for batch in batches:
        done = []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            if name != path:
                if state is not None:
                    done.append((path, state.hexdigest()))
                path, state = name, hashlib.sha256()
            state.update(content.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["path", "content_hash"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([state.hexdigest()])], ["path", "content_hash"])


def page_digests(parts: DataFrame) -> DataFrame:
    """``(path, content_hash)`` of whole pages: the SHA-256 of all parts of ``assemble`` in their order.

    Parts run through the digest one after another, so no cell holds a page.
    """
    ordered = parts.select("path", "part", F.encode("content", "UTF-8").alias("content")).repartition("path").sortWithinPartitions("path", "part")
    return ordered.select("path", "content").mapInArrow(_digests, "path string, content_hash string")
