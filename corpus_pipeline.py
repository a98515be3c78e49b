"""The cleaning pipeline over ``documents``: each stage is written and reread as the next one's input.

Toxic documents go, then lines seen before, then near copies of documents, then documents that
hold benchmark items; what is left is packed into training sequences.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontamination, linededup, neardocs, packing, toxicity
from folioscope.llm.catalog import table, tokenizer
from folioscope.llm.common import Shared

#: No statement of SQL has a learned model, SimHash, MinHash or a tokenizer; the tests compare with plain versions.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the multiple-instance model of the labels."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that have a copy or near copy before them."""
    return linededup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: found by SimHash, beyond its reach by MinHash, of a Jaccard similarity of 0.8 or more over runs of five words."""
    return neardocs.without_near_copies(docs, width=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), length=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    shared = Shared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.put(name, stage(spark, docs, sf_dir))
    return docs
