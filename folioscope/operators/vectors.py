"""Embedding upkeep and nearest vectors by dot product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.skew import top_per_key
from folioscope.session import bounded_rows

DEFAULT_K = 5
QUERY_BLOCK = 4096      # queries of one matrix
CORPUS_BLOCK = 100_000  # vectors of one block when the queries are many
SLICE = 2048            # vectors scored at a time inside a task
_HITS = "query_path string, path string, score double"


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 for unequal lengths."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    unit = F.transform(vector, lambda x: (x / F.sqrt(squares)).cast("float"))
    return F.when(squares == 0, vector).otherwise(unit)


def stale_pages(pages: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Pages without a vector of ``model`` or with one of older content."""
    have = embeddings.where(F.col("model") == model).select("path", F.col("content_hash").alias("_hash"))
    return pages.join(have, "path", "left").where(
        F.col("_hash").isNull() | (F.col("_hash") != F.col("content_hash"))).drop("_hash")


def live_vectors(embeddings: DataFrame, pages: DataFrame, model: str) -> DataFrame:
    """Vectors of ``model`` whose page is indexed."""
    return embeddings.where(F.col("model") == model).select("path", "vector").join(
        pages.select("path"), "path", "left_semi")


def _no_hits() -> pd.DataFrame:
    return pd.DataFrame({"query_path": pd.Series(dtype=object), "path": pd.Series(dtype=object),
                         "score": pd.Series(dtype="float64")})


class _Best:
    """The best ``k`` per query seen so far, ties by path.

    Queries and hits are numbers here; names are compared only where scores are equal.
    """

    def __init__(self, names: list[str], vectors: list[np.ndarray], k: int):
        self.names, self.k = names, k
        self.number = {n: i for i, n in enumerate(names)}
        self.by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        dims = np.asarray([len(v) for v in vectors])
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            self.by_dims[int(d)] = (rows, np.stack([vectors[i] for i in rows]).astype(np.float64))
        self.least = np.full(len(names), -np.inf)  # the k-th best score of each query
        self.query, self.score, self.path = np.empty(0, np.int64), np.empty(0), np.empty(0, dtype=object)

    def add(self, paths: np.ndarray, vectors: list[np.ndarray]) -> None:
        for at in range(0, len(paths), SLICE):
            self._add(paths[at:at + SLICE], vectors[at:at + SLICE])

    def _add(self, paths: np.ndarray, vectors: list[np.ndarray]) -> None:
        dims = np.asarray([len(v) for v in vectors])
        scores = np.zeros((len(self.names), len(paths)))
        for d, (rows, matrix) in self.by_dims.items():
            cols = np.flatnonzero(dims == d)
            if len(cols):
                block = np.stack([vectors[i] for i in cols]).astype(np.float64)
                scores[np.ix_(rows, cols)] = matrix @ block.T
        own = [(self.number[p], j) for j, p in enumerate(paths.tolist()) if p in self.number]
        if own:
            scores[tuple(np.array(own).T)] = -np.inf
        least = self.least
        better = scores >= least[:, None]
        if len(paths) > self.k and np.count_nonzero(better) > 4 * self.k * len(self.names):
            least = np.maximum(least, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
            better = scores >= least[:, None]
        q, j = np.nonzero(better & (scores > -np.inf))
        query, score = np.concatenate([self.query, q]), np.concatenate([self.score, scores[q, j]])
        path = np.concatenate([self.path, paths[j]])
        order = np.lexsort((np.unique(path, return_inverse=True)[1], -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[nth < self.k]
        self.query, self.score, self.path = query[nth < self.k], score[kept], path[kept]
        full = order[nth == self.k - 1]
        self.least[self.query[np.searchsorted(self.query, query[nth == self.k - 1])]] = score[full]

    def rows(self) -> pd.DataFrame:
        if not len(self.query):
            return _no_hits()
        return pd.DataFrame({"query_path": np.asarray(self.names, dtype=object)[self.query], "path": self.path, "score": self.score})


def _one_pass(corpus: DataFrame, names: list[str], vectors: list, k: int) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(
        (names, [np.asarray(v, dtype=np.float32) for v in vectors]))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Best(*shared.value, k)
        for batch in batches:
            if len(batch):
                held.add(batch["path"].to_numpy(), list(batch["vector"]))
        yield held.rows()

    return corpus.select("path", "vector").mapInPandas(best, _HITS)


def _blocked(corpus: DataFrame, queries: DataFrame, k: int, n_queries: int, n_corpus: int, query_block: int) -> DataFrame:
    """Exact block join: every query block meets every corpus block once, in as many groups as there are cores at least.

    The corpus is copied once for every block of queries, so blocks are as large as a task may hold.
    """
    q_blocks = max(1, -(-n_queries // max(query_block, QUERY_BLOCK)))
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    c_blocks = max(1, -(-n_corpus // CORPUS_BLOCK), -(-cores // q_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_path", "query_vector",
                       F.pmod(F.xxhash64("query_path"), F.lit(q_blocks)).cast("int").alias("qb"),
                       every(c_blocks).alias("cb"))
    c = corpus.select("path", "vector", every(q_blocks).alias("qb"),
                      F.pmod(F.xxhash64("path"), F.lit(c_blocks)).cast("int").alias("cb"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = _Best(list(left["query_path"]), list(left["query_vector"]), k) if len(left) else None
        if held is None or not len(right):
            return _no_hits()
        paths, vectors = right["path"].to_numpy(), list(right["vector"])
        held.add(paths, vectors)
        return held.rows()

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(best, _HITS)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Top ``k`` corpus vectors by dot product for each ``(query_path, query_vector)``.

    Queries that fit one block are sent to every task, which scores its rows by
    matrix products and keeps ``k`` per query.  More queries meet the corpus
    block by block.  Either way each task returns ``k`` rows per query at most.
    """
    k = DEFAULT_K if k <= 0 else k
    few = bounded_rows(queries.select("query_path", "query_vector"), query_block)
    if few is not None:
        hits = _one_pass(corpus, [r[0] for r in few], [r[1] for r in few], k)
    else:
        hits = _blocked(corpus, queries, k, queries.count(), corpus.count(), query_block)
    return top_per_key(hits, ["query_path"], [F.desc("score"), F.col("path")], k)


def similar_by_vector(
    paths: DataFrame, embeddings: DataFrame, pages: DataFrame, model: str, k: int = DEFAULT_K
) -> DataFrame:
    """Nearest pages of the requested paths, with title, type and category."""
    live = live_vectors(embeddings, pages, model)
    queries = live.join(paths.select("path").distinct(), "path", "left_semi").select(
        F.col("path").alias("query_path"), F.col("vector").alias("query_vector"))
    names = pages.select("path", "title", "type", "category")
    return nearest(queries, live, k).join(names, "path").select(
        "query_path", "rank", "path", "title", "type", "category", "score")


def similar(
    paths: DataFrame, embeddings: DataFrame, pages: DataFrame, model: str, k: int = DEFAULT_K
) -> DataFrame:
    """By vector where the page has one (and a model is set), else by its title."""
    from folioscope.operators.search import similar_by_text

    columns = ["query_path", "rank", "path", "title", "type", "category", "score"]
    if not model:
        return similar_by_text(pages, paths, k).select(*columns)
    near = similar_by_vector(paths, embeddings, pages, model, k)
    live = live_vectors(embeddings, pages, model).select("path")
    # a lone vector has no neighbour, so its page falls back to its title too
    matched = live.where(live.limit(2).agg(F.count(F.lit(1))).scalar() > 1)
    rest = paths.select("path").join(matched, "path", "left_anti")
    return near.unionByName(similar_by_text(pages, rest, k).select(*columns))


def count_by_model(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("model").agg(F.count(F.lit(1)).alias("n"))

