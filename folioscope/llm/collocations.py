"""Collocations from depth-truncated suffix subtrees, built group by group of word prefixes.

The suffixes of the word sequence, cut to ``LONGEST`` words, form a tree whose node for a phrase
counts the phrase's occurrences.  The tree is never built whole.  It is cut vertically, by prefixes:
a prefix with more suffixes than the memory of a task allows is extended by its next word, level
by level; the prefixes below each extended one are packed into groups of about half of the budget.
All suffixes of a group lie in one task, which sorts them, adds up equal leaves and reads the counts
of all inner nodes from the totals of their leaves.  The extended prefixes have counts of their own.

A word that occurs fewer than ``least`` times is in no candidate and no part of one, so suffixes
end before it.  Texts become word numbers chunk by chunk: a chunk asks for the numbers of
its distinct words by an equi-join, so no task or broadcast holds the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Shared, text_batches
from folioscope.llm.lm import opened, squeezed
from folioscope.operators.skew import top_per_key

LONGEST = 4
# Words of a chunk, and distinct ones (a chunk ends at either), and suffixes that a group may hold.
CHUNK, CHUNK_WORDS = 4_000_000, 800_000
BUDGET = 200_000
# Prefixes that are extended, at most, at a level: the list of them is sent to every task.
EXTENDED = 1_000_000

# fixed values: what parts pieces, and words
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_UPPER = bytes(range(65, 91))
# all of them are single bytes of UTF-8, so texts are cut as bytes
_TABLE = bytes.maketrans(_UPPER + _BREAKS + _BLANKS, _UPPER.lower() + b"\n" * len(_BREAKS) + b"  ")
_KEY = ["w1", "w2", "w3", "w4"]


class _Numbers(dict):
    """Numbers words in the order they come; a break is -1 and what lies between two blanks -2."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 2
        return n


def _new_numbers() -> _Numbers:
    known = _Numbers()
    dict.update(known, {b"\n": -1, b"": -2})
    return known


CHUNKS = "chunk long, lang string, words array<string>, counts array<long>, total long, tokens binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of texts of one language: its distinct words with their counts, its word sequence."""
    from pyspark import TaskContext

    schema = pa.schema({"chunk": pa.int64(), "lang": pa.string(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "total": pa.int64(), "tokens": pa.binary()})
    number = TaskContext.get().partitionId() << 24
    held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}

    def row(lang: str) -> pa.RecordBatch:
        nonlocal number
        known, parts = held.pop(lang)
        tokens = np.concatenate(parts)
        words = [w.decode() for w in list(known)[2:]]
        counts = np.bincount(tokens[tokens >= 0], minlength=len(words))
        number += 1
        return pa.RecordBatch.from_arrays([
            pa.array([x], f.type) for x, f in zip((number - 1, lang, words, counts, int(counts.sum()), squeezed(tokens)), schema)], schema=schema)

    for batch in text_batches(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            known, parts = held.setdefault(lang, (_new_numbers(), []))
            pieces = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
            pieces.append(b"\n")
            tokens = np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))
            parts.append(tokens[tokens != -2])
        while held and (sum(len(p) for _, parts in held.values() for p in parts) >= CHUNK or sum(len(k) for k, _ in held.values()) >= CHUNK_WORDS):
            yield row(max(held, key=lambda x: sum(map(len, held[x][1]))))
    for lang in list(held):
        yield row(lang)


def _renumber(chunk: pa.Table, numbers: pa.Table) -> pa.Table:
    """The chunk's sequence by the numbers its words have everywhere; rare words and breaks are -1."""
    schema = pa.schema({"chunk": pa.int64(), "tokens": pa.binary()})
    if not chunk.num_rows:
        return schema.empty_table()
    tokens = opened(chunk["tokens"][0].as_py(), np.int32)
    to = np.full(max(int(tokens.max(initial=-1)), int(np.asarray(numbers["at"]).max(initial=-1))) + 2, -1, np.int64)
    to[np.asarray(numbers["at"])] = np.asarray(numbers["word"])  # the last place, for -1, stays -1
    return pa.table([chunk["chunk"], pa.array([squeezed(to[tokens])], pa.binary())], schema=schema)


def _suffixes(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(windows, lengths)`` of all positions that begin a phrase: up to ``depth`` words, -1 beyond the end."""
    n = len(tokens)
    ends = np.concatenate([tokens, np.full(depth, -1, tokens.dtype)])
    start = np.flatnonzero((tokens >= 0) & (ends[1:n + 1] >= 0))
    windows = np.stack([ends[start + i] for i in range(depth)], axis=1)
    for i in range(2, depth):
        windows[windows[:, i - 1] < 0, i] = -1
    return windows, (windows >= 0).sum(axis=1)


def _distinct(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each occurs."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    counts = np.diff(np.append(starts, len(rows))) if weights is None else np.add.reduceat(weights[order], starts)
    return rows[starts], counts


class Extended:
    """The extended prefixes of all levels: their counts, and the groups of what lies below them."""

    def __init__(self, total: int, budget: int):
        self.budget = budget
        # the root, the empty prefix, is always extended
        self.levels = [(np.empty((1, 0), np.int64), np.array([total]))]
        self._number()

    def _number(self) -> None:
        self.first, at = [], 0
        for _, counts in self.levels:
            groups = np.maximum(1, -(-2 * counts // self.budget))
            self.first.append((at + np.cumsum(groups) - groups, groups))
            at += int(groups.sum())
        self.groups = at

    def add(self, prefixes: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort(prefixes.T[::-1]) if len(prefixes) else np.empty(0, np.int64)
        self.levels.append((prefixes[order], counts[order]))
        self._number()

    def find(self, windows: np.ndarray, depth: int) -> np.ndarray:
        """Place of each window's first ``depth`` words among the extended prefixes, or -1."""
        prefixes, _ = self.levels[depth] if depth < len(self.levels) else (np.empty((0, depth), np.int64), None)
        if not depth:
            return np.zeros(len(windows), np.int64)
        if not len(prefixes):
            return np.full(len(windows), -1)
        # both in one sort: a window's place is that of the extended prefix it equals
        both = np.concatenate([prefixes.astype(windows.dtype), windows[:, :depth]])
        order = np.lexsort(both.T[::-1])
        new = np.concatenate([[True], (both[order][1:] != both[order][:-1]).any(axis=1)])
        run = np.empty(len(both), np.int64)
        run[order] = np.cumsum(new) - 1
        place = np.full(int(new.sum()), -1)
        place[run[:len(prefixes)]] = np.arange(len(prefixes))
        return place[run[len(prefixes):]]

    def group(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(group, level)`` of each window: below its longest extended prefix, by the hash of the next word.

        A window that ends where its longest extended prefix ends adds to no count below it: level -1.
        """
        group, level = np.zeros(len(windows), np.int64), np.full(len(windows), -1)
        for depth in range(len(self.levels)):
            at = self.find(windows, depth)
            there = (at >= 0) & (lengths > depth)
            first, groups = self.first[depth]
            here = at[there]
            word = windows[there, depth].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            group[there] = first[here] + ((word >> np.uint64(33)) % groups[here].astype(np.uint64)).astype(np.int64)
            level[there] = depth
            level[(at >= 0) & (lengths <= depth)] = -1
        return group, level


def _tokens(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[np.ndarray]:
    for batch in batches:
        for cell in batch.column(0):
            yield opened(cell.as_py(), np.int64).astype(kind)


class Phrases:
    """Counts of all phrases of 2 to ``LONGEST`` words that occur at least ``least`` times, by language."""

    def __init__(self, docs: DataFrame, least: int, budget: int = BUDGET):
        self.shared, self.least = Shared(docs.sparkSession), least
        rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
        self.chunks = self.shared.put("chunks", rows.mapInArrow(_chunks, CHUNKS))
        self.totals = self.chunks.groupBy("lang").agg(F.sum("total").alias("n"))
        self._words()
        total = int(self.words.agg(F.sum("f")).first()[0] or 0)
        # so that a level has no more than EXTENDED extended prefixes
        self.budget = max(budget, -(-4 * total // EXTENDED))
        self._extend(total)
        self._subtrees()

    def _words(self) -> None:
        """Stores ``words`` (lang, name, f, word: a number) and ``coded``, the chunks by those numbers."""
        asked = self.chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "_w")).select(
            "chunk", "at", "lang", F.col("_w.words").alias("name"), F.col("_w.counts").alias("count"))
        often = asked.groupBy("lang", "name").agg(F.sum("count").alias("f")).where(F.col("f") >= self.least)
        # numbers without gaps: small ones take few bytes in every window
        counted = self.shared.put("counted", often.withColumn("_id", F.monotonically_increasing_id()))
        task, at, first = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1), 0
        starts = []
        for r in counted.groupBy(task.alias("task")).count().orderBy("task").collect():  # a row for each task
            starts.append((r.task, first))
            first += r["count"]
        shift = self.shared.spark.createDataFrame(starts, "task long, first long")
        numbered = counted.withColumn("task", task).join(F.broadcast(shift), "task").select("lang", "name", "f", (at + F.col("first")).alias("word"))
        self.words = self.shared.put("words", numbered)
        self.kind = np.int32 if first < (1 << 31) - 1 else np.int64
        numbers = asked.join(self.words.select("lang", "name", "word"), ["lang", "name"]).select(F.col("chunk").alias("of"), "at", "word")
        coded = self.chunks.select("chunk", "tokens").groupBy("chunk").cogroup(numbers.groupBy("of")).applyInArrow(_renumber, "chunk long, tokens binary")
        self.coded = self.shared.put("coded", coded).select("tokens")

    def _extend(self, total: int) -> None:
        """Extends every prefix above a quarter of the budget, level by level."""
        spark, bar = self.coded.sparkSession, self.budget // 4
        self.extended = Extended(total, self.budget)
        hot = self.words.where(F.col("f") > bar).select(F.col("word").alias("w1"), "f").collect()  # at most EXTENDED
        self.extended.add(np.array([[r.w1] for r in hot], np.int64).reshape(-1, 1), np.array([r.f for r in hot], np.int64))
        for depth in range(2, LONGEST):
            if not len(self.extended.levels[-1][0]):
                break
            sent, kind_ = spark.sparkContext.broadcast(self.extended), self.kind

            def below(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
                held, size = [], 0
                for tokens in _tokens(batches, kind_):
                    windows, lengths = _suffixes(tokens, depth)
                    windows = windows[lengths >= depth]
                    held.append(_distinct(windows[sent.value.find(windows, depth - 1) >= 0]))
                    size += len(held[-1][0])
                    if size > CHUNK:
                        yield counted(held, depth)
                        held, size = [], 0
                if held:
                    yield counted(held, depth)

            def counted(held: list, depth: int) -> pa.RecordBatch:
                rows, counts = _distinct(*map(np.concatenate, zip(*held)))
                return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows.T), pa.array(counts, pa.int64())], names=[*_KEY[:depth], "f"])

            keys = _KEY[:depth]
            kind = ", ".join(f"{k} long" for k in keys) + ", f long"
            found = self.coded.mapInArrow(below, kind).groupBy(*keys).agg(F.sum("f").alias("f")).where(F.col("f") > bar).collect()  # at most EXTENDED
            self.extended.add(np.array([[r[k] for k in keys] for r in found], np.int64).reshape(-1, depth), np.array([r.f for r in found], np.int64))

    def _subtrees(self) -> None:
        """Stores ``phrases``: ``w1 .. w4`` (-1 beyond its end), ``depth``, ``f`` and ``before``, the counts of its beginnings of 2 words and more."""
        sent, least, kind_ = self.coded.sparkSession.sparkContext.broadcast(self.extended), self.least, self.kind

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tokens in _tokens(batches, kind_):
                rows, counts = _distinct(_suffixes(tokens, LONGEST)[0])
                group, level = sent.value.group(rows, (rows >= 0).sum(axis=1))
                kept = level >= 0
                for at in range(0, int(kept.sum()), 1 << 18):
                    part = np.flatnonzero(kept)[at:at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(group[part]), *(pa.array(c, pa.int64()) for c in rows[part].T), pa.array(counts[part], pa.int64())], names=["group", *_KEY, "n"])

        kind = "group long, w1 long, w2 long, w3 long, w4 long, n long"

        def subtrees(table: pa.Table) -> pa.Table:
            return _read_tree(np.stack([np.asarray(table[k]).astype(kind_) for k in _KEY], axis=1), np.asarray(table["n"]), sent.value, least)

        nodes = self.coded.mapInArrow(deal, kind).groupBy("group").applyInArrow(subtrees, NODES)
        whole = [r for depth in range(2, LONGEST) if depth < len(self.extended.levels) for r in _extended_nodes(self.extended, depth)]
        more = self.coded.sparkSession.createDataFrame(whole, NODES)  # at most 2 * EXTENDED
        self.phrases = self.shared.put("phrases", nodes.unionByName(more))


NODES = "w1 long, w2 long, w3 long, w4 long, depth int, f long, before array<long>"
_NODES = pa.schema({**{k: pa.int64() for k in _KEY}, "depth": pa.int32(), "f": pa.int64(), "before": pa.list_(pa.int64())})


def _extended_nodes(extended: Extended, depth: int) -> list[tuple]:
    """Extended prefixes as nodes: no group holds all of their leaves."""
    prefixes, counts = extended.levels[depth]
    before = np.stack([extended.levels[d][1][extended.find(prefixes, d)] for d in range(2, depth)], axis=1) if depth > 2 else np.empty((len(prefixes), 0), np.int64)
    return [(*map(int, p), *[-1] * (LONGEST - depth), depth, int(c), [int(x) for x in b]) for p, c, b in zip(prefixes, counts, before)]


def _read_tree(rows: np.ndarray, n: np.ndarray, extended: Extended, least: int) -> pa.Table:
    """All nodes of two words or more of one group's subtrees, counted from the totals of their leaves."""
    leaves, totals = _distinct(rows, n)
    lengths = (leaves >= 0).sum(axis=1)
    tops = extended.group(leaves, lengths)[1]
    fresh = np.ones((len(leaves), LONGEST), bool)  # whether a leaf begins a node of each depth
    for d in range(LONGEST):
        fresh[1:, d] = (leaves[1:, :d + 1] != leaves[:-1, :d + 1]).any(axis=1)
    sums = np.cumsum(totals)
    counted = np.zeros((len(leaves), LONGEST), np.int64)
    for d in range(LONGEST):
        starts = np.flatnonzero(fresh[:, d])
        ends = np.append(starts[1:], len(leaves)) - 1
        inside = sums[ends] - sums[starts] + totals[starts]
        node = np.cumsum(fresh[:, d]) - 1
        counted[:, d] = inside[node]
        # a beginning at or above the extended prefix has leaves in other groups; its count is known
        above = tops >= d + 1
        if above.any():
            at = extended.find(leaves[above], d + 1)
            counted[above, d] = extended.levels[d + 1][1][at]
    parts = []
    for depth in range(2, LONGEST + 1):
        node = np.flatnonzero(fresh[:, depth - 1] & (lengths >= depth) & (tops < depth) & (counted[:, depth - 1] >= least))
        words = leaves[node].copy()
        words[:, depth:] = -1
        before = pa.ListArray.from_arrays(np.arange(len(node) + 1, dtype=np.int32) * (depth - 2), counted[node, 1:depth - 1].reshape(-1))
        parts.append(pa.table([*(pa.array(c, pa.int64()) for c in words.T), pa.array(np.full(len(node), depth, np.int32)), pa.array(counted[node, depth - 1]), before], schema=_NODES))
    return pa.concat_tables(parts)


def _with_ends(phrases: Phrases) -> DataFrame:
    """``phrases`` with ``after``: the counts of the ends of 1, 2, .. words, each found at the phrase less its first word."""
    shared, known = phrases.shared, phrases.phrases
    words = phrases.words.select(F.col("word").alias("_last"), F.col("f").alias("_f"))
    done = shared.put("ends-2", known.where("depth = 2").join(words, F.col("w2") == F.col("_last")).select(*known.columns, F.array("_f").alias("after")))
    out = done
    for depth in range(3, LONGEST + 1):
        shorter = done.select(*[F.col(_KEY[i]).alias(f"_{i + 2}") for i in range(depth - 1)], F.col("f").alias("_f"), F.col("after").alias("_after"))
        same = [F.col(_KEY[i]) == F.col(f"_{i + 1}") for i in range(1, depth)]
        done = shared.put(f"ends-{depth}", known.where(F.col("depth") == depth).join(shorter, same).select(*known.columns, F.concat("_after", F.array("_f")).alias("after")))
        out = out.unionByName(done)
    return out


def _longer(phrases: DataFrame) -> DataFrame:
    """For every phrase inside a longer one, the greatest count of those that are longer by one word.

    A phrase's count is no greater than that of any phrase inside it, so what is longer by more
    words never holds more.
    """
    last = lambda d: [F.when(F.lit(i) < d - 1, F.col(k)).otherwise(F.lit(-1)).alias(k) for i, k in enumerate(_KEY)]
    rows = phrases.where("depth > 2")
    first = rows.select(*last(F.col("depth")), "f")
    rest = rows.select("w2", "w3", "w4", F.lit(-1).cast("long").alias("_end"), "f").toDF(*_KEY, "f")
    return first.unionByName(rest).groupBy(*_KEY).agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, budget: int = BUDGET) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best ``top`` phrases of 2 to 4 words.

    ``docs`` has ``text`` and ``lang``.  A-Z count in lower case; ``.,;:!?`` and line ends part pieces, blanks and
    tabs words; no phrase crosses a piece.  ``n`` counts a language's words, ``a`` a phrase's occurrences (at
    least ``least``), overlaps included.  Cut after its first words a phrase scores ``floor(2000000 * a / (l + r))``,
    ``l`` and ``r`` the counts of the two parts; the lowest score counts, ties to the shortest first part.  A
    phrase goes if a longer one that holds it occurs in at least ``share`` hundredths of its occurrences.
    Order: score, ``a`` (both descending), phrase in UTF-8 byte order.

    A null language is ``und``; null and empty texts have no words; equal rows each count, so an
    empty table, or one of rare words, gives no rows.  Other columns are ignored.
    ``budget`` is the number of suffixes that a task sorts at a time.
    """
    found = Phrases(docs, least, budget)
    shared, wide = found.shared, lambda c: c.cast("decimal(38,0)")
    known = _with_ends(found)
    longer = _longer(found.phrases)
    lone = known.join(longer, _KEY, "left").where(F.col("longest").isNull() | (100 * wide(F.col("longest")) < share * wide(F.col("f"))))
    lone = lone.join(found.words.select(F.col("word").alias("w1"), "lang", F.col("f").alias("f1")), "w1")
    # the counts of the first 1, 2, .. words, and of the last ones
    first = lambda k: "f1" if k == 1 else f"before[{k - 2}]"
    cut = lambda k: F.struct(
        F.expr(f"CAST((CAST(2000000 AS DECIMAL(38,0)) * CAST(f AS DECIMAL(19,0))) div (CAST({first(k)} AS DECIMAL(20,0)) + after[depth - {k + 1}]) AS BIGINT)").alias("score"),
        F.lit(k).alias("k"), F.expr(first(k)).alias("l"), F.expr(f"after[depth - {k + 1}]").alias("r"))
    cuts = F.array(*[F.when(F.col("depth") > k, cut(k)) for k in range(1, LONGEST)])
    scored = lone.select(*_KEY, "lang", F.col("f").alias("a"), F.array_min(F.array_compact(cuts)).alias("_c")).select(*_KEY, "lang", "a", "_c.l", "_c.r", "_c.score")
    stored = shared.put("scored", scored)
    # ties at the border stay until their phrases are spelled out
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = shared.put("near", stored.withColumn("_at", F.rank().over(order)).where(F.col("_at") <= top).drop("_at"))
    near = near.withColumn("_row", F.struct(*_KEY))
    names = near.select("_row", F.posexplode(F.array(*_KEY)).alias("_at", "word")).where("word >= 0").join(found.words.select("word", "name"), "word")
    spelled = names.groupBy("_row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "name"))), lambda x: x["name"]), " ").alias("phrase"))
    full = near.join(spelled, "_row").join(found.totals, "lang")
    ranked = top_per_key(full, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
