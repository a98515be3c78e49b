"""Embedding of stale pages in batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators.changes import apply_changes
from folioscope.operators.vectors import stale_pages

DIMS = 64
OUT = "path string, content_hash string, vector array<float>, dims int, outcome string"


def hashed_trigrams(texts: list[str], dims: int = DIMS) -> list[np.ndarray]:
    """Default embedder: signed counts of hashed trigrams, unit length."""
    out = []
    for text in texts:
        raw = text.lower().encode()
        vector = np.zeros(dims, dtype=np.float64)
        if len(raw) >= 3:
            b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
            code = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
            mixed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            sign = np.where(mixed & np.uint64(1), 1.0, -1.0)
            np.add.at(vector, ((mixed >> np.uint64(1)) % np.uint64(dims)).astype(int), sign)
        else:
            vector[zlib.crc32(raw) % dims] = 1.0
        norm = np.linalg.norm(vector)
        out.append((vector / norm if norm else vector).astype(np.float32))
    return out


def embed_pages(stale: DataFrame, fn: Callable[[list[str]], list] = hashed_trigrams, batch: int = 32) -> DataFrame:
    """``path, content_hash, vector, dims, outcome`` for each stale page.

    Pages without content are ``skipped``.  When ``fn`` fails on a batch all its
    pages are ``failed``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                readable = part["text"].notna()
                vectors = pd.Series([None] * len(part), index=part.index, dtype=object)
                outcome = pd.Series("skipped", index=part.index)
                if readable.any():
                    try:
                        made = fn(list(part.loc[readable, "text"]))
                        for i, vector in zip(part.index[readable], made):
                            vectors[i] = np.asarray(vector, dtype=np.float32)
                        outcome[readable] = "embedded"
                    except Exception:
                        outcome[readable] = "failed"
                yield pd.DataFrame({
                    "path": part["path"], "content_hash": part["content_hash"], "vector": vectors,
                    "dims": vectors.map(lambda v: 0 if v is None else len(v)).astype("int32"), "outcome": outcome})

    ready = stale.select("path", "content_hash", tx.embed_text(F.col("path"), F.col("content")).alias("text"))
    return ready.mapInPandas(run, OUT)


def embed_stale(
    pages: DataFrame, embeddings: DataFrame, model: str, fn: Callable[[list[str]], list] = hashed_trigrams,
    batch: int = 32,
) -> DataFrame:
    return embed_pages(stale_pages(pages, embeddings, model), fn, batch)


def store_vectors(embeddings: DataFrame, made: DataFrame, model: str, now: Column) -> DataFrame:
    """``embeddings`` with the new vectors put in by (path, model)."""
    ops = made.where(F.col("outcome") == "embedded").select(
        "path", "content_hash", F.lit(model).alias("model"), "vector", "dims", now.alias("updated_at"),
        F.lit("upsert").alias("op"), F.lit(1).alias("seq"))
    return apply_changes(embeddings, ops, keys=("path", "model"), protected=(), unique=True)


def outcome_counts(made: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    return made.agg(n("embedded"), n("skipped"), n("failed"), F.count(F.lit(1)).alias("total"))
