"""Katz backoff language model over words, counted and evaluated where the text is.

With ``c`` the training count of an n-gram, ``C(h)`` the count of its history and ``d``
the Good-Turing discount of its order,

    P(w | h) = d[c] * c / (C(h) + RESERVED)      if (h, w) was seen
             = alpha(h) * P(w | shorter h)       if not

and ``alpha(h)`` makes the probabilities of a history sum to one exactly: it is the mass
the seen words leave, over the mass they leave in the shorter model.  The shortest
model gives the mass that its words leave to one class of unknown words.
``RESERVED`` keeps that mass above zero for a history none of whose counts is discounted.

Documents are taken in chunks of about ``CHUNK`` tokens.  A chunk asks for the counts of
its distinct n-grams, bucket by bucket of their hash (64 bits), with its own counts as the
question; a bucket adds the questions of all chunks up, stores the table of its n-grams,
and answers each chunk.  So an n-gram, however frequent, is one number per
chunk, and no bucket depends on how words are spread.  Backoff weights are sums
over the n-grams of a history: the first chunk that holds an n-gram adds it in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Shared, text_batches

CHUNK = 500_000
RESERVED = 0.5
# Good-Turing discounts counts up to this.
DISCOUNTED = 5
# Distinct n-grams a bucket is asked about, roughly.
BUCKET_KEYS = 600_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_END, _START = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def squeezed(values: np.ndarray) -> bytes:
    """An array of integers as bytes: planes of equal place together, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def opened(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CHUNK_SCHEMA = "chunk long, doc_ids array<long>, train array<boolean>, sizes array<int>, words binary, tokens binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema({"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), "train": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "words": pa.binary(), "tokens": pa.binary()})
    number = TaskContext.get().partitionId() << 20
    known: dict[str, int] = {}
    doc_ids, train, sizes, tokens, total = [], [], [], [], 0

    def row() -> pa.RecordBatch:
        words = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known), np.uint64, len(known))
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((number, doc_ids, train, sizes, squeezed(words), squeezed(np.concatenate(tokens))), schema)], schema=schema)

    for batch in text_batches(batches):
        ids, texts, flags = (batch.column(i).to_pylist() for i in range(3))
        found = [_WORD.findall(t.translate(_LOWER)) if t else [] for t in texts]
        flat = [w for ws in found for w in ws]
        tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int32, len(flat)))
        doc_ids += ids
        train += flags
        sizes += map(len, found)
        total += len(flat) + len(ids)
        if total >= CHUNK:
            yield row()
            number, total = number + 1, 0
            known = {}
            doc_ids, train, sizes, tokens = [], [], [], []
    if doc_ids:
        yield row()


class _Chunk:
    """The n-grams of a chunk: for every order, keys and histories of its tokens."""

    def __init__(self, train: np.ndarray, sizes: np.ndarray, words: bytes, tokens: bytes, order: int):
        hashes, local = _mix(opened(words, np.uint64)), opened(tokens, np.int32)
        # every document: order - 1 starts, its words, one end
        full = sizes.astype(np.int64) + order
        stops = np.cumsum(full)
        place = np.arange(len(local)) + np.repeat(np.arange(len(sizes)) * order + (order - 1), sizes)
        stream = np.full(int(stops[-1]), _START, np.uint64)
        stream[place] = hashes[local]
        stream[stops - 1] = _END
        self.real = np.ones(len(stream), bool)
        for i in range(order - 1):
            self.real[stops - full + i] = False
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.train = np.repeat(train, sizes + 1)
        self.sizes = sizes.astype(np.int64) + 1
        grams = [stream]
        for k in range(2, order + 1):
            grams.append(_mix(np.concatenate([[np.uint64(_START)], grams[-1][:-1]]) * np.uint64(0x9E6C63D0876A9A47 + 2 * k) + stream))
        self.keys = [g[self.real] for g in grams]
        before = [np.concatenate([[np.uint64(_START)], g[:-1]]) for g in grams[:-1]]
        self.histories = [None, *[b[self.real] for b in before]]
        first = np.zeros(len(self.doc), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        self.first = first
        self.unique, self.at, self.which = [], [], []
        for keys in self.keys:
            u, at, which = np.unique(keys, return_index=True, return_inverse=True)
            self.unique.append(u)
            self.at.append(at)
            self.which.append(which)


def _buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket ends among sorted keys: buckets are ranges of the hash."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0 ** 64 / buckets)).astype(np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def _deltas(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""


class Katz:
    """A trained model and the scores of the documents it was given."""

    def __init__(self, docs: DataFrame, train: Column, order: int = 2):
        self.shared, self.order = Shared(docs.sparkSession), order
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
        self.chunks = self.shared.put("chunks", rows.mapInArrow(_chunks, CHUNK_SCHEMA))
        seen = self.chunks.select(
            F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x + 1).alias("tokens"),
            F.size(F.filter("train", lambda t: t)).alias("docs"),
            F.aggregate(F.arrays_zip("train", "sizes"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["train"], x["sizes"] + 1).otherwise(0)).alias("train_tokens"))
        total = seen.agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"), F.sum("train_tokens").alias("train_tokens")).first()
        self.train_docs, self.train_tokens = int(total.docs or 0), int(total.train_tokens or 0)
        self.buckets = max(1, math.ceil(int(total.tokens or 0) * order / BUCKET_KEYS))
        self._count()
        self._discount()

    def _count(self) -> None:
        """Ask and answer; stores ``ngrams`` (by order and bucket) and ``answers``."""
        order, buckets = self.order, self.buckets
        asked_type = pa.schema({"bucket": pa.int32(), "order": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()})

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                chunk = _Chunk(np.array(row["train"], bool), np.array(row["sizes"], np.int32), row["words"], row["tokens"], order)
                out = []
                for k in range(order):
                    counts = np.bincount(chunk.which[k], weights=chunk.train, minlength=len(chunk.unique[k])).astype(np.uint32)
                    begin = 0
                    for bucket, stop in enumerate(_buckets_of(chunk.unique[k], buckets).tolist()):
                        if stop > begin:
                            out.append((bucket, k + 1, row["chunk"], _deltas(chunk.unique[k][begin:stop]), squeezed(counts[begin:stop])))
                        begin = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), asked_type)], schema=asked_type)

        def answer(table: pa.Table) -> pa.Table:
            bucket, k = table["bucket"][0].as_py(), table["order"][0].as_py()
            chunks = np.asarray(table["chunk"].combine_chunks())
            by = np.argsort(chunks, kind="stable")
            keys = [np.cumsum(opened(table["keys"][i].as_py(), np.uint64), dtype=np.uint64) for i in by.tolist()]
            counts = [opened(table["counts"][i].as_py(), np.uint32) for i in by.tolist()]
            flat = np.concatenate(keys)
            unique, first, which = np.unique(flat, return_index=True, return_inverse=True)
            total = np.bincount(which, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)
            reply = (total << 1)[which]
            reply[first] |= 1  # who is first adds the n-gram to its history's sums
            stops = np.cumsum([len(x) for x in keys])[:-1]
            seen = total > 0
            few = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
            rows = [(bucket, k, int(chunks[i]), squeezed(r)) for i, r in zip(by.tolist(), np.split(reply, stops))]
            rows.append((bucket, k, -1, _deltas(unique[seen])))
            rows.append((bucket, k, -2, squeezed(total[seen])))
            rows.append((bucket, k, -3, squeezed(few)))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "order", "chunk", "data"])

        asked = self.chunks.mapInArrow(ask, "bucket int, order int, chunk long, keys binary, counts binary")
        told = asked.groupBy("order", "bucket").applyInArrow(answer, "bucket int, order int, chunk long, data binary")
        self.told = self.shared.put("ngrams", told)

    def ngrams(self) -> DataFrame:
        """``(order, bucket, ngram, count)``: every n-gram of the training texts, by its hash."""
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (r for b in batches for r in b.to_pylist()):
                if r["keys"]:
                    keys = np.cumsum(opened(r["keys"], np.uint64), dtype=np.uint64)
                    yield pa.record_batch({"order": pa.array([r["order"]] * len(keys), pa.int32()), "bucket": pa.array([r["bucket"]] * len(keys), pa.int32()), "ngram": keys.view(np.int64), "count": opened(r["counts"], np.int64)})

        stored = self.told.where("chunk in (-1, -2)").groupBy("order", "bucket").agg(F.first(F.expr("if(chunk = -1, data, null)"), True).alias("keys"), F.first(F.expr("if(chunk = -2, data, null)"), True).alias("counts"))
        return stored.mapInArrow(rows, "order int, bucket int, ngram long, count long")

    def _discount(self) -> None:
        """Discounts of counts 1 .. DISCOUNTED for every order, from counts of counts."""
        def add(table: pa.Table) -> pa.Table:
            total = sum(opened(x.as_py(), np.int64) for x in table["data"])
            return pa.table({"order": table["order"][:1], "few": pa.array([total.tolist()], pa.list_(pa.int64()))})

        # a few numbers for each order
        few = {r["order"]: np.array(r["few"]) for r in self.told.where("chunk = -3").groupBy("order").applyInArrow(add, "order int, few array<long>").collect()}
        self.discounts, self.vocabulary = [], int(few.get(1, np.zeros(2))[1:].sum())
        for k in range(1, self.order + 1):
            self.discounts.append(good_turing(few.get(k, np.zeros(DISCOUNTED + 3, int))))
        n = few.get(1, np.zeros(DISCOUNTED + 3, int))[1:DISCOUNTED + 1]
        r = np.arange(1, DISCOUNTED + 1)
        used = self.train_tokens - float((n * r * (1 - self.discounts[0])).sum())
        self.unknown = 1 - used / (self.train_tokens + RESERVED)

    def scores(self) -> DataFrame:
        """``(doc_id, train, n_tokens, n_known, base, score)`` of every document given.

        ``score`` is the sum of log10 probabilities of a text's words and its end;
        ``base`` that of the add-one unigram model.
        """
        order, train_docs, n_train, vocabulary = self.order, self.train_docs, self.train_tokens, self.vocabulary
        discounts, unknown = self.discounts, self.unknown
        kind = pa.schema({"kind": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
                          "base": pa.float64(), "score": pa.float64(), "order": pa.int32(), "history": pa.int64(), "seen": pa.float64(), "lower": pa.float64(), "times": pa.int64()})
        plain = "kind int, row long, doc_id long, train boolean, n_tokens long, n_known long, base double, score double, order int, history long, seen double, lower double, times long"

        def batch(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kind], schema=kind)

        def evaluate(key: tuple, chunk_rows: pa.Table, replies: pa.Table) -> pa.Table:
            row = chunk_rows.to_pylist()[0]
            chunk = _Chunk(np.array(row["train"], bool), np.array(row["sizes"], np.int32), row["words"], row["tokens"], order)
            counts, owned, out = [], [], []
            for k in range(order):
                mine = sorted((r["bucket"], r["data"]) for r in replies.to_pylist() if r["order"] == k + 1)
                reply = np.concatenate([opened(d, np.int64) for _, d in mine])
                counts.append((reply >> 1)[chunk.which[k]])
                owned.append(((reply & 1) == 1) & (reply > 1))
            known = counts[0] > 0
            # P of the longest seen suffix so far; unseen histories cost nothing
            p = np.where(known, _discounted(counts[0], discounts[0]) / (n_train + RESERVED), unknown)
            log = np.log10(np.maximum(p, 1e-300))
            histories = [np.full(len(p), n_train)]
            seen_p = [p]
            for k in range(1, order):
                # the starts are no tokens: a history of starts alone is seen once a training text
                history = np.where(chunk.first, train_docs, np.concatenate([[0], counts[k - 1][:-1]]))
                histories.append(history)
                seen = counts[k] > 0
                p = _discounted(counts[k], discounts[k]) / (history + RESERVED)
                seen_p.append(p)
                at = chunk.at[k][owned[k]]
                names, where = np.unique(chunk.histories[k][at], return_inverse=True)
                if len(names):
                    out.append(batch(len(names), kind=np.ones(len(names), np.int32), order=np.full(len(names), k + 1, np.int32), history=names.view(np.int64),
                                     seen=np.bincount(where, weights=p[at]), lower=np.bincount(where, weights=seen_p[k - 1][at])))
                back = ~seen & (history > 0)
                if back.any():
                    rows = row["chunk"] * (1 << 21) + chunk.doc[back]
                    pair = np.lexsort((chunk.histories[k][back], rows))
                    r, h = rows[pair], chunk.histories[k][back][pair]
                    new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
                    start = np.flatnonzero(new)
                    out.append(batch(len(start), kind=np.full(len(start), 2, np.int32), row=r[start], order=np.full(len(start), k + 1, np.int32), history=h[start].view(np.int64),
                                     times=np.diff(np.append(start, len(r)))))
                log = np.where(seen, np.log10(np.maximum(p, 1e-300)), log)
            base = np.log10((counts[0] + 1) / (n_train + vocabulary + 1))
            n = len(chunk.sizes)
            out.append(batch(n, kind=np.zeros(n, np.int32), row=row["chunk"] * (1 << 21) + np.arange(n), doc_id=row["doc_ids"], train=row["train"], n_tokens=chunk.sizes,
                             n_known=np.bincount(chunk.doc, weights=known, minlength=n).astype(np.int64), base=np.bincount(chunk.doc, weights=base, minlength=n),
                             score=np.bincount(chunk.doc, weights=log, minlength=n)))
            return pa.Table.from_batches(out, kind)

        replies = self.told.where("chunk >= 0")
        found = self.shared.put("evaluated", self.chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(evaluate, plain))
        left = (1 - F.col("seen")) / (1 - F.col("lower"))
        self.backoff = self.shared.put("backoff", found.where("kind = 1").groupBy("order", "history").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))
                                       .select("order", "history", F.log10(F.greatest(left, F.lit(1e-300))).alias("log_alpha")))
        owed = found.where("kind = 2").select("row", "order", "history", "times").join(self.backoff, ["order", "history"]).groupBy("row").agg(F.sum(F.col("times") * F.col("log_alpha")).alias("owed"))
        texts = found.where("kind = 0").select("row", "doc_id", "train", "n_tokens", "n_known", "base", "score")
        return texts.join(owed, "row", "left").withColumn("score", F.col("score") + F.coalesce("owed", F.lit(0.0))).drop("row", "owed")


def good_turing(few: np.ndarray) -> np.ndarray:
    """Katz's discounts of the counts 1 .. DISCOUNTED, from how many n-grams have each count.

    Where the counts of counts do not decrease in a way that gives discounts
    between 0 and 1 (small or odd corpora), half a count is taken off instead.
    """
    n, top = few.astype(float), DISCOUNTED
    out = np.empty(top)
    common = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    for r in range(1, top + 1):
        d = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (d - common) / (1 - common) if common < 1 else 0.0
        out[r - 1] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    factor = np.concatenate([[0.0], discounts, [1.0]])
    return counts * factor[np.minimum(counts, len(discounts) + 1)]


def katz_scores(docs: DataFrame, train: Column, order: int = 2) -> tuple[DataFrame, Katz]:
    """Train on the ``docs`` (doc_id, text) where ``train`` holds, and score all of them.

    Words are what white space parts, A-Z in lower case; a text's end counts as a
    token.  Null and empty texts are an end alone; rows of equal or null id stay separate rows;
    other columns are ignored.  Without training texts every token is unknown
    and has probability one.  An empty table gives no rows.
    """
    model = Katz(docs, train, order)
    return model.scores(), model
