"""Near copies of documents: every pair whose sets of word shingles are similar enough.

Candidates come from SimHash: fingerprints of the shingles at most 3 bits apart, by multi-index hashing.  That
reaches the nearest copies only: at a Jaccard similarity of 0.8 about ten of 64 bits differ, and segments with balls that
let 16 bits through meet in a seventh of all pairs.  Bands of MinHash add the others: ``BANDS`` bands of ``ROWS`` minima
each send a pair of similarity 0.8 to a common bucket with a probability of 0.9997, and of 0.9 with all but one.  Every
link of either is then verified by the exact Jaccard similarity of the two sets.

Documents of equal sets are one row before any bucket.  A bucket compares its rows with its smallest one
first; then those in different components yet are compared with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Shared, compacted, components
from folioscope.llm.simhash import kept_of_classes, majority, near_prints, shingled, without_gone

BANDS, ROWS = 16, 4
SIMILARITY = 0.8
_FACTORS = np.random.default_rng(23).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
# Shingles that a Python step multiplies at once.
SHINGLES = 1 << 18


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name of each document's set, and a hash of each band of its minima."""
    for batch in batches:
        column = batch.column(1)
        sizes = np.asarray(column.value_lengths()).astype(np.int64)
        flat = np.asarray(column.flatten()).view(np.uint64)
        names, prints, bands = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.uint64), []
        for i, (stop, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist())):
            # a text without words has the set of nothing, which is like itself only
            own = np.unique(flat[stop - size:stop]) if size else np.zeros(1, np.uint64)
            names[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), np.int64)[0]
            prints[i] = majority(flat[stop - size:stop])
            minima = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
            for at in range(0, len(own), SHINGLES):
                part = own[at:at + SHINGLES]
                minima = np.minimum(minima, [(part * f).min() for f in _FACTORS])
            bands.append([hashlib.blake2b(b"%d " % b + minima[b * ROWS:(b + 1) * ROWS].tobytes(), digest_size=8).digest() for b in range(BANDS)])
        keys = np.frombuffer(b"".join(x for row in bands for x in row), np.int64)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(keys))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names), pa.array(prints.view(np.int64)), rows], ["doc_id", "text_hash", "fp", "print", "bands"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets (fp, shingles) are similar enough."""
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("set_b"))
    low, high = F.least(F.size("set_a"), F.size("set_b")), F.greatest(F.size("set_a"), F.size("set_b"))
    met = pairs.join(left, "a").join(right, "b").where(low >= SIMILARITY * high)
    # a generator, so that the sets are compared once and not for every use of the number
    both = F.explode(F.array(F.size(F.array_intersect("set_a", "set_b")))).alias("both")
    return met.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("sizes"), both).where(F.col("both") >= SIMILARITY * (F.col("sizes") - F.col("both"))).select("a", "b")


def _print_pairs(shared: Shared, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (fp, print) with fingerprints at most 3 bits apart: those of one fingerprint with its smallest set, and the smallest ones."""
    first = shared.put("print-first", sets.groupBy("print").agg(F.min("fp").alias("a")))
    _, stars, links = near_prints(shared, first.select(F.col("print").alias("fp")))
    apart = stars.unionByName(links.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    near = apart.select(F.col("a").alias("print"), "b").join(first, "print").select("a", F.col("b").alias("print")).join(first.withColumnRenamed("a", "b"), "print")
    equal = sets.join(first, "print").where("fp != a").select("a", F.col("fp").alias("b"))
    return shared.put("print-pairs", equal.unionByName(near.select("a", "b")))


def near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, kept)`` of every document (doc_id, text), ``fp`` naming its set of shingles.

    ``component_id`` is the smallest ``doc_id`` reachable by sets of a Jaccard similarity of 0.8 or more; shingles,
    null ids and ``kept`` are as in ``simhash.near_duplicates``.  Texts without words are copies of each other.
    """
    shared = Shared(docs.sparkSession)
    prints = shared.put("sets", shingled(docs, width).mapInArrow(_signed, "doc_id long, text_hash long, fp long, print long, bands array<long>"))
    members = prints.select("doc_id", "text_hash", "fp")
    distinct = prints.groupBy("fp").agg(F.first("bands").alias("bands"), F.min("print").alias("print"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"))
    distinct = shared.put("distinct-sets", distinct.select("fp", "print", "one.doc_id", "one.text_hash", "bands"))
    printed = _print_pairs(shared, distinct.select("fp", "print"))
    buckets = distinct.select("fp", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # exploded and self-joined rows are many more than Spark takes them for: never sent whole to every task
    held = shared.put("set-buckets", buckets.hint("merge").join(least, "bucket"))
    # the sets of what has company by its fingerprint or in a bucket, of one document each
    company = held.select("fp").union(printed.select("a")).union(printed.select("b")).distinct()
    wanted = company.join(distinct.drop("bands", "print"), "fp").withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash")
    again = shingled(docs, width)
    named = again.join(wanted, again["doc_id"].eqNullSafe(wanted["id"]) & (again["text_hash"] == wanted["hash"]))
    sets = shared.put("shingles", named.dropDuplicates(["fp"]).select("fp", F.array_distinct("hashes").alias("shingles")))
    stars = shared.put("set-stars", _similar(printed.unionByName(held.where("fp != a").select("a", F.col("fp").alias("b"))).distinct(), sets))
    first = components(shared, stars, "set-first").withColumnRenamed("component", "label").withColumnRenamed("node", "fp")
    labelled = shared.put("set-labelled", held.select("bucket", "fp").join(first, "fp", "left").select("bucket", "fp", F.coalesce("label", "fp").alias("label")))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    rest = labelled.join(mixed, "bucket")
    other = rest.select("bucket", F.col("fp").alias("b"), F.col("label").alias("label_b"))
    pairs = rest.withColumnRenamed("fp", "a").hint("merge").join(other, "bucket").where("label < label_b").select("a", "b").distinct()
    joined = components(shared, compacted(stars.unionByName(_similar(pairs, sets))), "set-all").withColumnRenamed("node", "fp")
    classes = distinct.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))
    return kept_of_classes(shared.put("set-members", members.join(classes, "fp")))


def without_near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are kept of their component; rows equal in id and text are one document."""
    return without_gone(docs, near_copies(docs, width).where("not kept"))
