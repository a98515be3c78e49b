"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are the stated queries; their words are the terms.  A document becomes a
row of term numbers, its passages are windows of ``WINDOW`` words every ``STRIDE``, and a
passage is the TF-IDF vector of its terms, with document frequencies counted over all
documents.

A randomised SVD over the passages of all documents gives the latent space: one pass sums
``A'(A G)`` for a Gaussian ``G``, a second the small matrix ``Q'A'A Q``; both sums are made
in the tasks and only matrices as wide as the benchmark's terms come to the driver.
A third pass projects each passage and keeps the items at a cosine of ``COSINE`` and more.  Such a
candidate is verified where it is found: the longest common subsequence of the item's words and the words
around the passage must hold ``EXACT`` of the item, or ``PARAPHRASE`` of it while ``ANSWER`` of its answer (its
last sentence, or the rarest words of an item of one sentence) is there in order.  Before that is computed, the
different words around must make up so much of both in any order; this drops nothing that would be accepted.

Items are taken in blocks of ``ITEMS``, so the broadcast terms and vectors have a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Shared, text_batches
from folioscope.llm.lm import opened, squeezed

WINDOW, STRIDE = 32, 16
RAREST = 8
RANK, EXTRA = 96, 16
COSINE = 0.15
# Passages that a step compares with the items at once.
ROWS = 512
# Rows that are added up in one go.
PART = 16
EXACT, PARAPHRASE, ANSWER = 0.75, 0.55, 0.8
ITEMS = 4000
FOUND = "doc_id long, text_hash long, item_id long, cosine double, common double, answer double"
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def answer_of(text: str) -> list[str]:
    """Words of the last sentence that has any."""
    for part in reversed(re.split(r"[.!?\n]+", text)):
        if found := words(part):
            return found
    return []


def rarest(item: list[int], df: np.ndarray) -> list[int]:
    """The rarest third of an item's words, at most ``RAREST``, in the item's order: what is checked where no last sentence stands apart."""
    first = {t: i for i, t in reversed(list(enumerate(item)))}
    chosen = sorted(first, key=lambda t: (df[t], first[t]))[:max(1, min(RAREST, len(item) // 3))]
    return sorted(chosen, key=first.get)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _term_rows(batches: Iterator[pa.RecordBatch], terms: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        rows = []
        for t in batch.column(2).to_pylist():
            found = np.fromiter(map(terms.get, words(t or ""), repeat(-1)), np.int32)
            rows.append(squeezed(found) if (found >= 0).any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "text_hash", "terms"])


def _sums(rows: np.ndarray, index: np.ndarray, begin: np.ndarray, add: np.ufunc = np.add) -> np.ndarray:
    """Sums (or maxima) of ``rows[index]`` over the runs of ``index`` that begin at ``begin``, none empty."""
    size = np.diff(np.append(begin, len(index)))
    while True:
        # parts of at most PART rows, the longest first: the n-th rows of those that have so many are added at once
        parts = -(-size // PART)
        at = np.cumsum(parts) - parts
        first = np.repeat(begin - PART * at, parts) + PART * np.arange(parts.sum())
        length = np.minimum(np.repeat(begin + size, parts) - first, PART)
        order = np.argsort(-length, kind="stable")
        first, more = first[order], np.searchsorted(-length[order], -np.arange(PART))
        total = rows[index[first]]
        for j in range(1, PART):
            if not more[j]:
                break
            add(total[:more[j]], rows[index[first[:more[j]] + j]], out=total[:more[j]])
        rows = np.empty_like(total)
        rows[order] = total
        if len(rows) == len(begin):
            return rows
        index, begin, size = np.arange(len(rows)), at, parts


class _Passages:
    """Weighted terms of a batch of documents, by stride blocks of words."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray):
        sizes = np.array([len(d) for d in docs])
        self.blocks = -(-sizes // STRIDE)
        flat = np.concatenate(docs) if docs else np.empty(0, np.int32)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        block = np.repeat(np.cumsum(self.blocks) - self.blocks, sizes) + place // STRIDE
        kept = (flat >= 0) & (weight[flat] > 0)
        self.place = np.flatnonzero(kept)
        self.term, self.block, self.n = flat[kept], block[kept], int(self.blocks.sum())
        self.doc_of_block = np.repeat(np.arange(len(docs)), self.blocks)

    def projected(self, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that have terms, and the sum of their rows of ``to``."""
        if not len(self.term):
            return np.empty(0, np.int64), np.empty((0, to.shape[1]), np.float32)
        begin = np.flatnonzero(np.concatenate([[True], self.block[1:] != self.block[:-1]]))
        out = np.empty((len(begin), to.shape[1]), np.float32)
        for at in range(0, len(begin), 4096):  # so many blocks at once
            stop = min(at + 4096, len(begin))
            a, b = begin[at], begin[stop] if stop < len(begin) else len(self.term)
            out[at:stop] = _sums(to, self.term[a:b], begin[at:stop] - a)
        return self.block[begin], out

    def before(self) -> np.ndarray:
        """For each term the place of the same one before it in its document, -1 if there is none."""
        key = self.doc_of_block[self.block] * (int(self.term.max(initial=0)) + 1) + self.term
        order = np.argsort(key, kind="stable")
        out, again = np.full(len(key), -1), key[order[1:]] == key[order[:-1]]
        out[order[1:][again]] = self.place[order[:-1][again]]
        return out


def _docs_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [opened(x, np.int32) if x else np.empty(0, np.int32) for x in batch.column(batch.schema.get_field_index("terms")).to_pylist()]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class LatentSearch:
    """The latent space of one block of items, and what it finds."""

    def __init__(self, shared: Shared, docs: DataFrame, items: list[tuple[int, str]], name: str):
        self.shared = shared
        self.items = [(i, words(t), answer_of(t)) for i, t in items]
        self.items = [x for x in self.items if x[1]]
        self.terms = {w: n for n, w in enumerate(dict.fromkeys(w for _, ws, _ in self.items for w in ws))}
        terms = shared.spark.sparkContext.broadcast(self.terms)
        rows = docs.mapInArrow(lambda b: _term_rows(b, terms.value), "doc_id long, text_hash long, terms binary")
        self.rows = shared.put(name, rows).where(F.col("terms").isNotNull())
        if self.terms:
            self._weigh()
            self._fit()

    def _weigh(self) -> None:
        n = len(self.terms)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, blocks = np.zeros(n, np.int64), 0
            for batch in _sliced(batches):
                p = _Passages(_docs_of(batch), np.ones(n))
                pairs = np.unique(p.term.astype(np.int64) * max(p.n, 1) + p.block)
                total += np.bincount(pairs // max(p.n, 1), minlength=n)
                blocks += p.n
            some = np.flatnonzero(total)
            yield pa.record_batch({"term": np.append(some, -1), "n": np.append(total[some], blocks)})

        # a row for each term of the benchmark
        counts = dict(self.rows.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
        blocks = max(counts.pop(-1, 0), 1)
        df = np.array([counts.get(i, 0) for i in range(n)])
        self.df = df
        # common words too: a paraphrase may keep those alone, besides the answer
        self.weight = np.log((1 + blocks) / (1 + df)) + 1e-3

    def _item_passages(self) -> np.ndarray:
        """Windows of the items' weighted terms as rows; ``self.owner`` has the item of each."""
        rows, self.owner = [], []
        for k, (_, ws, _) in enumerate(self.items):
            ids = np.array([self.terms[w] for w in ws])
            for at in range(0, max(len(ids) - WINDOW, 0) + STRIDE // 2, STRIDE // 2):
                v = np.zeros(len(self.terms))
                np.add.at(v, ids[at:at + WINDOW], self.weight[ids[at:at + WINDOW]])
                rows.append(v)
                self.owner.append(k)
        return np.array(rows)

    def _fit(self) -> None:
        """Randomised SVD of the passages: ``self.basis`` has the right singular vectors."""
        n, width = len(self.terms), min(RANK + EXTRA, len(self.terms))
        shown = self.shared.spark.sparkContext.broadcast((self.weight, np.random.default_rng(17).standard_normal((n, width)).astype(np.float32)))

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, g = shown.value
            to = (g * weight[:, None]).astype(np.float32)
            total = np.zeros((n, width))
            for batch in _sliced(batches):
                p = _Passages(_docs_of(batch), weight)
                blocks, x = p.projected(to)
                if not len(blocks):
                    continue
                order = np.argsort(p.term, kind="stable")
                term, row = p.term[order], np.searchsorted(blocks, p.block[order])
                begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                total[term[begin]] += _sums(x, row, begin) * weight[term[begin], None]
            some = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch({"term": some, "row": pa.array([total[i].tobytes() for i in some.tolist()], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            rows = np.frombuffer(b"".join(table["row"].to_pylist()), float).reshape(-1, width)
            return pa.table({"term": table["term"][:1], "row": pa.array([rows.sum(axis=0).tobytes()], pa.binary())})

        y = np.zeros((n, width))
        for r in self.rows.select("terms").mapInArrow(sketch, "term long, row binary").groupBy("term").applyInArrow(add, "term long, row binary").collect():
            y[r["term"]] = np.frombuffer(r["row"], float)
        # the items are passages too; counted so often that they weigh as much as all others together
        g = shown.value[1].astype(float)
        self.asked = self._item_passages()
        times = (g * y).sum() / width / max((self.asked ** 2).sum(), 1e-12)
        y += times * (self.asked.T @ (self.asked @ g))
        q = np.linalg.qr(y)[0]
        shown_q = self.shared.spark.sparkContext.broadcast((self.weight, q.astype(np.float32)))

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, basis = shown_q.value
            to = (basis * weight[:, None]).astype(np.float32)
            total = np.zeros((basis.shape[1], basis.shape[1]))
            for batch in _sliced(batches):
                x = _Passages(_docs_of(batch), weight).projected(to)[1].astype(float)
                total += x.T @ x
            yield pa.record_batch({"term": pa.array([0], pa.int64()), "row": pa.array([total.tobytes()], pa.binary())})

        def add_small(table: pa.Table) -> pa.Table:
            rows = np.frombuffer(b"".join(table["row"].to_pylist()), float).reshape(table.num_rows, -1)
            return pa.table({"term": table["term"][:1], "row": pa.array([rows.sum(axis=0).tobytes()], pa.binary())})

        made = self.rows.select("terms").mapInArrow(small, "term long, row binary").groupBy("term").applyInArrow(add_small, "term long, row binary").collect()
        gram = np.frombuffer(made[0]["row"], float).reshape(q.shape[1], -1) if made else np.zeros((q.shape[1],) * 2)
        own = self.asked @ q
        values, vectors = np.linalg.eigh(gram + times * (own.T @ own))
        self.singular = np.sqrt(np.maximum(values[::-1][:RANK], 0))
        self.basis = (q @ vectors[:, ::-1][:, :RANK]).astype(np.float32)

    def found(self) -> DataFrame:
        """``(doc_id, text_hash, item_id, cosine, common, answer)`` of verified passages."""
        if not self.terms:
            return self.shared.spark.createDataFrame([], FOUND)
        owner = np.array(self.owner)
        asked = (self.asked @ self.basis).astype(np.float32)
        norm = np.linalg.norm(asked, axis=1)
        asked = asked / np.maximum(norm, 1e-12)[:, None]
        texts = []
        for _, ws, answer in self.items:
            item = [self.terms[w] for w in ws]
            texts.append((item, rarest(item, self.df) if len(answer) == len(ws) else [self.terms[w] for w in answer]))
        # how often each item has each term; no item has more of one than it has words
        longest = max(len(item) for item, _ in texts)
        held = np.zeros((len(self.terms), len(texts)), np.min_scalar_type(longest))
        for k, (item, _) in enumerate(texts):
            np.add.at(held[:, k], item, 1)
        shown = self.shared.spark.sparkContext.broadcast((self.weight, self.basis, asked, owner, held, texts, [i for i, _, _ in self.items]))
        kind = pa.schema({"doc_id": pa.int64(), "text_hash": pa.int64(), "item_id": pa.int64(), "cosine": pa.float64(), "common": pa.float64(), "answer": pa.float64()})

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, basis, asked, owner, held, texts, names = shown.value
            to = (basis * weight[:, None]).astype(np.float32)
            length = np.array([len(item) for item, _ in texts])
            windows = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            # items of like length, which look at equally many words around a passage
            kind_of = np.ceil(np.log2(length)).astype(int)
            groups = [(g, int(length[g].max()), np.ascontiguousarray(held[:, g])) for g in (np.flatnonzero(kind_of == n) for n in np.unique(kind_of))]
            for batch in _sliced(batches):
                docs = _docs_of(batch)
                p = _Passages(docs, weight)
                blocks, x = p.projected(to)
                if not len(blocks):
                    continue
                before = p.before()
                # a window is two blocks of a document
                follows = np.zeros(len(blocks), bool)
                follows[:-1] = (blocks[1:] == blocks[:-1] + 1) & (p.doc_of_block[blocks[1:]] == p.doc_of_block[blocks[:-1]])
                x[follows] += x[np.flatnonzero(follows) + 1]
                x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                first = np.cumsum(p.blocks) - p.blocks
                sizes = np.array([len(d) for d in docs])
                start = np.cumsum(sizes) - sizes
                doc = p.doc_of_block[blocks]
                place = (blocks - first[doc]) * STRIDE
                tried: dict[tuple, tuple] = {}
                for at in range(0, len(x), ROWS):
                    # an item's best window at each passage
                    cosine = _sums(asked @ x[at:at + ROWS].T, np.arange(len(asked)), windows, np.maximum).T
                    met, whose, here = cosine >= COSINE, doc[at:at + ROWS], place[at:at + ROWS]
                    for group, reach, has in groups:
                        near = np.flatnonzero(met[:, group].any(axis=1))
                        if not len(near):
                            continue
                        # no subsequence is longer than what the different words around make up of the item
                        begin = start[whose[near]] + np.maximum(here[near] - reach, 0)
                        end = start[whose[near]] + np.minimum(here[near] + WINDOW + reach, sizes[whose[near]])
                        a, b = np.searchsorted(p.place, begin), np.searchsorted(p.place, end)
                        word = np.arange((b - a).sum()) + np.repeat(b - np.cumsum(b - a), b - a)
                        new = before[word] < np.repeat(begin, b - a)
                        row = np.repeat(np.arange(len(near)), b - a)[new]
                        most = _sums(has, p.term[word[new]], np.searchsorted(row, np.arange(len(near))))
                        met[np.ix_(near, group)] &= most / length[group] >= PARAPHRASE
                    for i, k in np.argwhere(met).tolist():
                        d = int(whose[i])
                        low, high = max(int(here[i] - length[k]), 0), int(min(here[i] + WINDOW + length[k], sizes[d]))
                        item, answer = texts[k]
                        near = docs[d][low:high].tolist()
                        there = set(near).__contains__
                        most = sum(map(there, item)) / len(item)
                        if most < PARAPHRASE or (most < EXACT and sum(map(there, answer)) / len(answer) < ANSWER):
                            continue
                        common = common_subsequence(item, near) / len(item)
                        there = common_subsequence(answer, near) / len(answer)
                        if common >= EXACT or (common >= PARAPHRASE and there >= ANSWER):
                            best = tried.get((d, k), (0.0, 0.0, 0.0))
                            tried[d, k] = max(best, (common, there, float(cosine[i, k])))
                hits = list(tried.items())
                if hits:
                    ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                        [ids[d] for (d, _), _ in hits], [hashes[d] for (d, _), _ in hits], [names[k] for (_, k), _ in hits],
                        [v[2] for _, v in hits], [v[0] for _, v in hits], [v[1] for _, v in hits]), kind)], schema=kind)

        return self.rows.mapInArrow(search, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, item_id, cosine, common, answer)``: items found in ``docs`` (doc_id, text).

    ``benchmark`` has ``item_id`` and ``text``; null or wordless items and texts match nothing.
    Several passages of a document with one item are one row, the best.  Rows of equal id are told apart by
    ``text_hash``; other columns are ignored; without items or documents there are no rows.
    """
    shared = Shared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-items.count() // ITEMS))
    out = None
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        found = LatentSearch(shared, rows, [(r["item_id"], r["text"]) for r in held], f"terms-{b}").found()
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("common", "answer", "cosine"))
    return out.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select("doc_id", "text_hash", "item_id", "best.cosine", "best.common", "best.answer")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that hold an item of ``benchmark``, all columns as they are."""
    bad = contaminated(docs, benchmark).select("doc_id", "text_hash").distinct()
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (own == bad["text_hash"]), "left_anti")
