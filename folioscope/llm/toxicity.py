"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A document is a bag of sentences.  Sentence ``i`` is toxic with probability
``s_i = 1 / (1 + exp(-(b + sum of word weights)))``, and a document is toxic unless
none of its sentences is: ``P = 1 - prod(1 - s_i)`` (noisy-or).  The likelihood of the
document labels is maximised over ``b`` and the weights by Adam with an L1 step,
so most weights end at zero.  Words are lower-cased; a word weighs as the
sum of itself and its beginnings of ``PREFIXES`` letters, hashed to ``FEATURES`` places.

The fit uses at most ``bound`` labelled documents of each label (those with the
smallest hash of the id); scoring covers every text, whole, in one narrow pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_batches

FEATURES = 1 << 20
PREFIXES = (4, 5, 6)
BOUND = 3000
ROUNDS = 120
RATE = 0.1
L1 = 2e-5
START_BIAS = -5.0
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_STOPS = (".", "!", "?", "\n")


def features_of(word: str) -> list[int]:
    return [zlib.crc32(f"{n}:{word[:n]}".encode()) % FEATURES for n in PREFIXES if len(word) > n] + [zlib.crc32(f"w:{word}".encode()) % FEATURES]


class _Bags:
    """Labelled documents as sentences of feature numbers."""

    def __init__(self, texts: list[str]):
        known: dict[str, list[int]] = {}
        feats, sizes, owner = [], [], []
        for d, text in enumerate(texts):
            row: list[int] = []
            for token in [*_TOKEN.findall(text.lower()), "."]:
                if token in _STOPS:
                    if row:
                        feats.append(np.array(row, np.int32))
                        sizes.append(len(row))
                        owner.append(d)
                    row = []
                else:
                    got = known.get(token)
                    if got is None:
                        got = known[token] = features_of(token)
                    row += got
        flat = np.concatenate(feats) if feats else np.empty(0, np.int32)
        owner_of_flat = np.repeat(owner, sizes) if sizes else np.empty(0, np.int64)
        # a feature of one document alone cannot be learned from
        pairs = np.unique(flat.astype(np.int64) * (len(texts) + 1) + owner_of_flat)
        spread = np.bincount(pairs // (len(texts) + 1), minlength=FEATURES)
        kept = spread[flat] >= 2
        self.names, inner = np.unique(flat[kept], return_inverse=True)
        self.flat = inner
        sentence = np.repeat(np.arange(len(sizes)), sizes)[kept]
        self.sizes = np.bincount(sentence, minlength=len(sizes))
        self.sentence = sentence
        self.owner = np.array(owner, np.int64)


def train(texts: list[str], toxic: list[int], rounds: int = ROUNDS) -> tuple[float, dict[int, float]]:
    """Bias and the weights that are not zero."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return (5.0 if len(y) and y[0] else -12.0), {}
    bags = _Bags(texts)
    w, b = np.zeros(len(bags.names)), START_BIAS
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for t in range(1, rounds + 1):
        z = b + np.bincount(bags.sentence, weights=w[bags.flat], minlength=len(bags.sizes))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(bags.owner, weights=np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=len(y))
        p = np.clip(-np.expm1(none), 1e-9, 1 - 1e-12)
        pull = np.where(y == 1, -(1 - p) / p, 1.0) * each
        g = pull[bags.owner] * s
        gw = np.bincount(bags.flat, weights=g[bags.sentence], minlength=len(w))
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = RATE / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7)
        w = w - step * m / (1 - 0.9 ** t)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step * L1, RATE), 0)
        b -= RATE * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-7)
    kept = np.flatnonzero(w)
    return float(b), dict(zip(bags.names[kept].tolist(), w[kept].tolist()))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, bound: int = BOUND) -> tuple[float, dict[int, float]]:
    """The model, from labelled ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``usable`` may narrow the labels by ``doc_id``.  Null labels and ids are ignored, of
    several labels of an id the highest holds.  Without both labels the model
    is a constant.  The fit is one task over at most ``2 * bound`` documents.
    """
    held = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if usable is not None:
        held = held.where(usable)
    held = held.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = held.where("toxic = 1").orderBy(order, "doc_id").limit(bound).unionByName(held.where("toxic = 0").orderBy(order, "doc_id").limit(bound))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable").head(4 * bound)  # repeated ids count as repeated texts
        bias, weights = train(pdf["text"].tolist(), pdf["toxic"].tolist())
        return pd.DataFrame({"feature": [-1, *weights], "weight": [bias, *weights.values()]})

    out = found.withColumn("fit", F.lit(0)).groupBy("fit").applyInPandas(run, "feature long, weight double").collect()
    model = {r.feature: r.weight for r in out}
    return model.pop(-1, -12.0), model


class _Weights(dict):
    """Numbers words by their weight; a stop closes a sentence."""

    def __init__(self, weights: dict[int, float]):
        self.weights, self.values = weights, []
        for stop in _STOPS:
            self[stop] = -1

    def __missing__(self, word: str) -> int:
        value = sum(self.weights.get(f, 0.0) for f in features_of(word))
        if len(self) > 2_000_000 or len(word) > 64:  # not remembered
            self.values.append(value)
            return len(self.values) - 1
        self[word] = n = len(self.values)
        self.values.append(value)
        return n


class _Scorer:
    """Scores texts in one worker."""

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights, self.known = bias, weights, _Weights(weights)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its probability, its sentences, those from 0.5 up."""
        if len(self.known.values) > 2_500_000:
            self.known = _Weights(self.weights)
        tokens, ends = [], []
        for t in texts:
            if t:
                tokens += _TOKEN.findall(t.lower())
            tokens.append("\n")
            ends.append(len(tokens))
        which = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        if not len(which):
            return np.empty(0), np.empty(0, np.int64), np.empty(0)
        stops = np.flatnonzero(which < 0)
        value = np.where(which < 0, 0.0, np.array(self.known.values or [0.0])[which])
        begin = np.concatenate([[0], stops[:-1] + 1])
        real = stops > begin
        z = self.bias + np.add.reduceat(value, begin)
        s = np.where(real, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        owner, n = np.searchsorted(ends, stops, side="right"), len(texts)
        none = np.bincount(owner, weights=np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=n)
        return np.abs(np.expm1(none)), np.bincount(owner, weights=real, minlength=n).astype(np.int64), np.bincount(owner, weights=s >= 0.5, minlength=n)


def score(docs: DataFrame, model: tuple[float, dict[int, float]]) -> DataFrame:
    """``(doc_id, score, n_sentences, offending)`` of every document.

    ``offending`` holds start, end and score of the sentences from 0.5 up, in code
    points.  A null or empty text, or one without words, has no sentence and the score 0.
    Rows of equal or null id stay separate rows; other columns are ignored.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*broadcast.value)
        for batch in text_batches(batches):
            texts = batch.column(1).to_pylist()
            scores, sentences, hits = scorer(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores, pa.float64()), pa.array(sentences, pa.int64()),
                pa.array([_located(t, scorer.bias, scorer.known) if h else [] for t, h in zip(texts, hits)], spans)], ["doc_id", "score", "n_sentences", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below 0.5."""
    broadcast = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*broadcast.value)
        for batch in text_batches(batches, column=at):
            scores, _, _ = scorer(batch.column(at).to_pylist())
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)


def _located(text: str, bias: float, known: _Weights) -> list[dict]:
    out = []
    for m in SENTENCE.finditer(text):
        words = [known[w] for w in _TOKEN.findall(m[0].lower())]
        s = 1 / (1 + np.exp(-np.clip(bias + sum(known.values[i] for i in words if i >= 0), -30, 30)))
        if s >= 0.5 and any(i >= 0 for i in words):
            out.append({"start": m.start(), "end": m.end(), "score": float(s)})
    return out


def toxic_documents(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> DataFrame:
    """``score`` with the decision ``predicted`` (1 from 0.5 up)."""
    return score(docs, fit(docs, labels, usable)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
