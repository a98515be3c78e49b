"""What several of these operators share: stored tables, batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import tune, work_dir

# Text bytes that a Python step holds at once; a longer text is a batch alone.
BATCH_BYTES = 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Shared:
    """Tables of one run in the folder that all executors share."""

    def __init__(self, spark: SparkSession):
        self.spark = tune(spark)
        self.root = work_dir(spark)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back, so that it is never computed again.

        Its shuffle files are of no use from then on and go with the write.
        """
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def share_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_batches(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where the text of a column passes ``most`` bytes."""
    for batch in batches:
        texts = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        at, group = 0, np.cumsum(sizes + 64) // most
        for stop in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
            if stop > at:
                yield batch.slice(at, stop - at)
            at = stop


def _compact(pairs: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Spanning forests of chunks of edges: the same components, fewer rows."""
    def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        node, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = smallest_labels(len(node), where[:len(a)], where[len(a):])
        kept = label != np.arange(len(node))
        return pa.record_batch({"a": node[label[kept]], "b": node[kept]}, schema=pa.schema({"a": pa.int64(), "b": pa.int64()}))

    held, rows = [], 0
    for batch in pairs:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            out = forest(*(np.concatenate([np.asarray(x.column(i)) for x in held]) for i in (0, 1)))
            yield out
            held, rows = [], 0
    if rows:
        yield forest(*(np.concatenate([np.asarray(x.column(i)) for x in held]) for i in (0, 1)))


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(label, before):
            return label


def compacted(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as one spanning forest per task and million rows."""
    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_compact, "a long, b long")


def components(shared: Shared, edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` of every node of ``edges`` (a, b): the smallest reachable node.

    Distributed union-find by alternating star contractions: each node points its
    larger neighbours, then its smaller ones, at the smallest.  Built from partial
    aggregates and equi-joins, so a node with very many edges is summed before the
    shuffle and its join is split.  Each round is stored, and it ends when a
    round changes nothing.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    rows = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars, last, turn = shared.put(f"{name}-0", rows), None, 0
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last, turn = state, turn + 1
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("u < v").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = shared.put(f"{name}-large-{turn}", large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        stars = shared.put(f"{name}-{turn}", small)
        shared.drop(f"{name}-large-{turn}")
        shared.drop(f"{name}-{turn - 1}")
