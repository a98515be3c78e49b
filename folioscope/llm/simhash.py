"""SimHash near-duplicates found by multi-index hashing.

A fingerprint of 64 bits is cut into two halves.  Two fingerprints at most 3 bits
apart differ by at most 1 bit in one of them, so each fingerprint is stored under
its two halves and looked up under all halves within 1 bit: 33 + 33 exact
keys.  What a lookup finds is verified by the complete distance.

Equal fingerprints are one row before any lookup.  Links already implied by others
are not made: a first round links the rows of each bucket to its smallest
fingerprint, and lookups then keep links between different components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Shared, compacted, components, lower_ascii

BITS = 64
# Shingles whose bits a Python step counts at once.
SHINGLES = 1 << 18


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        counts += np.unpackbits(hashes[at:at + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column(1)
        sizes = np.asarray(hashes.value_lengths()).astype(np.int64)
        flat = np.asarray(hashes.flatten()).view(np.uint64)
        stops = np.cumsum(sizes)
        prints = np.zeros(len(sizes), np.uint64)
        for i, (stop, size) in enumerate(zip(stops.tolist(), sizes.tolist())):
            prints[i] = majority(flat[stop - size:stop])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every document (doc_id, text): the majority bits of its shingles' XXH64.

    A-Z are lower-cased; words are what white space parts; a text of fewer than ``width``
    words is one shingle, one without words (also null) has the fingerprint 0.
    """
    return shingled(docs, width).mapInArrow(_counted, "doc_id long, text_hash long, fp long")


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, hashes, text_hash)``: the XXH64 of each run of ``width`` words, repeats included."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"), text_hash(docs).alias("text_hash"))
    n = F.size("words")
    shifted = [F.slice("words", i + 1, F.greatest(n - width + 1, F.lit(0))).alias(f"w{i}") for i in range(width)]
    joined = F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(F.concat_ws(" ", *[x[f"w{i}"] for i in range(width)])))
    whole = F.xxhash64(F.array_join("words", " "))
    hashes = F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(whole)).otherwise(joined)
    return rows.select("doc_id", hashes.alias("hashes"), "text_hash")


def _keys(fp: Column, masks: list[int]) -> Column:
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(0xFFFFFFFF)
    first = F.lit(1 << 32)
    return F.explode(F.array(*[high.bitwiseXOR(F.lit(m)) for m in masks], *[low.bitwiseXOR(F.lit(m)).bitwiseOR(first) for m in masks]))


BALL = [0] + [1 << i for i in range(BITS // 2)]


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, kept)`` of every document (doc_id, text).

    ``component_id`` is the smallest ``doc_id`` reachable by fingerprints at most
    ``distance`` (up to 3) bits apart, itself included.  Rows of equal id stay separate rows; a
    null id is no smallest id, and is the component's id where no other is.  ``kept`` is true for one document
    of a component, that of the smallest id (of several the smallest text hash).  Texts without words
    share the fingerprint 0.  Other columns are ignored; an empty table gives no rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the two halves cover distances up to 3")
    shared = Shared(docs.sparkSession)
    prints = shared.put("prints", fingerprints(docs, width))
    labelled, _, links = near_prints(shared, shared.put("distinct", prints.select("fp").distinct()), distance)
    joined = components(shared, compacted(links.select(F.col("label").alias("a"), F.col("other_label").alias("b"))), "links")
    classes = labelled.join(joined.withColumnRenamed("node", "label"), "label", "left").select("fp", F.coalesce("component", "label").alias("label"))
    return kept_of_classes(shared.put("members", prints.join(classes, "fp")))


def near_prints(shared: Shared, distinct: DataFrame, distance: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(labelled, stars, links)`` of distinct fingerprints (fp): the components (fp, label) of the first round's pairs
    (a, b), and the pairs (fp, other) of different ones, with their labels."""
    buckets = distinct.select("fp", _keys(F.col("fp"), [0]).alias("key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    # one round of stars: every fingerprint of a bucket against its smallest
    least = buckets.groupBy("key").agg(F.min("fp").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Spark takes exploded rows for as few as they were before, and would send all of them to every task
    stars = buckets.hint("merge").join(least, "key").where(near & (F.col("fp") != F.col("other"))).select(F.col("other").alias("a"), F.col("fp").alias("b"))
    first = components(shared, stars, "stars")
    labelled = shared.put("labelled", distinct.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label")))
    held = labelled.select("fp", "label", _keys(F.col("fp"), [0]).alias("key"))
    asked = labelled.select(F.col("fp").alias("other"), F.col("label").alias("other_label"), _keys(F.col("fp"), BALL).alias("key"))
    links = held.hint("merge").join(asked, "key").where(near & (F.col("fp") < F.col("other")) & (F.col("label") != F.col("other_label")))
    return labelled, stars, links.select("fp", "other", "label", "other_label")


def kept_of_classes(members: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, kept)`` of documents (doc_id, text_hash, fp) with the ``label`` of their component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    out = members.join(members.groupBy("label").agg(first), "label").withColumn("component_id", F.col("first.doc_id"))
    return out.select("doc_id", "text_hash", "fp", "component_id", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are kept of their component; rows equal in id and text are one document."""
    return without_gone(docs, near_duplicates(docs, width, distance).where("not kept"))


def without_gone(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those named in ``rows`` (doc_id, text_hash)."""
    gone = rows.select("doc_id", "text_hash").distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (text_hash(docs) == gone["text_hash"]), "left_anti")
