"""Hard negatives by exact integer products of many candidates at once.

Every component ``x`` becomes the integer ``floor(256 * x)``.  The components that several
candidates have in one dimension are biased to be non-negative and packed into the fields of
one wide integer (Kronecker substitution): with ``F`` bits a field,

    W[d] = sum over candidates j of (x[j][d] + B) << (F * j)

so one product ``(a[d] + A) * W[d]`` multiplies an anchor's component with all of them, and the
sum over ``d`` holds, field by field, ``sum (a + A)(x + B)``.  ``F`` is taken from the bounds of
the block, so no field runs over into the next one; the biases' known share is taken off after
unpacking, and the scores are exact whatever the size of the components.

Anchors and candidates meet block by block, as rows dealt by row number: a label, an id or a
vector that very many rows share is spread like any other.  A block returns at most the best
few rows of each anchor (and positive), which are then merged by a window with group limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Shared
from folioscope.operators.skew import top_per_key

SCALE = 256
# Rows of a block of candidates, and of a block of anchors.
CANDIDATES, ANCHORS = 8192, 2048
# Integer components of this size or more would pass any 64-bit score by far.
LARGEST = 1 << 54
SCORE = "decimal(38,0)"
_DIGITS = pa.decimal128(38, 0)


def packed(columns: np.ndarray, bias: int, width: int) -> int:
    """The biased integers of one dimension in fields of ``width`` bytes, the first one lowest."""
    if width <= 8:
        raw = np.zeros((len(columns), width), np.uint8)
        raw[:] = (columns.astype(np.int64) + bias).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return int.from_bytes(raw.tobytes(), "little")
    return int.from_bytes(b"".join((int(x) + bias).to_bytes(width, "little") for x in columns), "little")


def unpacked(value: int, n: int, width: int) -> np.ndarray:
    """The ``n`` fields of a wide integer: as 64-bit numbers where they fit, else as Python's."""
    raw = value.to_bytes(n * width, "little")
    if width <= 8:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
        return out.view("<i8").reshape(-1)
    return np.array([int.from_bytes(raw[i:i + width], "little") for i in range(0, n * width, width)], dtype=object)


class Packed:
    """Candidates packed dimension by dimension, and the products of anchors with them."""

    def __init__(self, vectors: np.ndarray, largest_anchor: int):
        self.n, self.dims = vectors.shape
        self.bias = max(1, -int(vectors.min())) if vectors.size else 1
        self.anchor_bias = largest_anchor
        top = (int(vectors.max()) if vectors.size else 0) + self.bias
        bits = (max(1, self.dims) * 2 * max(1, largest_anchor) * max(1, top)).bit_length()
        # one bit stays free, so that a field of eight bytes is never read as a negative number
        self.width = bits // 8 + 1
        self.words = [packed(vectors[:, d], self.bias, self.width) for d in range(self.dims)]
        kind = np.int64 if self.width <= 8 else object
        self.sums = vectors.astype(kind).sum(axis=1)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of one anchor with all candidates: one product for each of its components."""
        whole = sum(((int(a) + self.anchor_bias) * w for a, w in zip(anchor, self.words)), 0)
        fields = unpacked(whole, self.n, self.width)
        known = self.bias * int(anchor.astype(object).sum()) + self.dims * self.anchor_bias * self.bias
        return fields - known - self.anchor_bias * self.sums


def scaled_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(row, vec_id, label, x)`` of the rows that take part, with integer components."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * scale) < float(LARGEST))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.where(whole).where(F.forall("embedding", finite)).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", x.alias("x"))


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = lists.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.int64).reshape(-1, dims)


def _meetings(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes and vectors of the anchors and rows of a block that have equal lengths."""
    sizes_a, sizes_r = (np.asarray(t["dims"]) for t in (anchors, rows))
    for dims in np.intersect1d(sizes_a, sizes_r).tolist():
        if dims:
            a, r = np.flatnonzero(sizes_a == dims), np.flatnonzero(sizes_r == dims)
            yield a, r, _matrix(anchors.take(a)["x"], dims), _matrix(rows.take(r)["x"], dims)


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt so that each block of anchors meets each block of rows once."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    ab, rb = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // CANDIDATES), min(cores, n_rows // 256))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = anchors.select("*", F.size("x").alias("dims"), block(ab).alias("ab")).withColumn("rb", every(rb))
    right = rows.select("*", F.size("x").alias("dims"), block(rb).alias("rb")).withColumn("ab", every(ab))
    return left, right


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` highest scores, ties by smaller id."""
    if len(scores) > 4 * most and scores.dtype != object:
        least = -np.partition(-scores, most - 1)[most - 1]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    order = sorted(near.tolist(), key=lambda i: (-int(scores[i]), int(ids[i])))
    return np.array(order[:most], dtype=np.int64)


def _positives(most: int):
    schema = pa.schema({"anchor": pa.int64(), "anchor_id": pa.int64(), "label": pa.int64(), "positive_id": pa.int64(), "positive_score": _DIGITS})

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for a, r, av, rv in _meetings(anchors, rows):
            al, rl, ai, ri = (np.asarray(t[c])[w] for t, c, w in ((anchors, "label", a), (rows, "label", r), (anchors, "vec_id", a), (rows, "vec_id", r)))
            at = np.asarray(anchors["row"])[a]
            largest = int(np.abs(av).max()) + 1
            for label in np.intersect1d(al, rl).tolist():
                mine = np.flatnonzero(rl == label)
                held = Packed(rv[mine], largest)
                for i in np.flatnonzero(al == label).tolist():
                    scores, ids = held.scores(av[i]), ri[mine]
                    other = np.flatnonzero(ids != ai[i])
                    for j in _best(scores[other], ids[other], most).tolist():
                        out.append((at[i], ai[i], label, ids[other[j]], int(scores[other[j]])))
        return _table(out, schema)

    return find, "anchor long, anchor_id long, label long, positive_id long, positive_score " + SCORE


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    from decimal import Decimal

    return pa.table([pa.array([Decimal(x) for x in c] if f.type == _DIGITS else c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _negatives(most: int, low: int, high: int):
    schema = pa.schema({"anchor": pa.int64(), "anchor_id": pa.int64(), "positive_id": pa.int64(), "nth": pa.int32(), "positive_score": _DIGITS, "negative_id": pa.int64(), "negative_score": _DIGITS})

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for a, r, av, rv in _meetings(anchors, rows):
            al, rl, ai, ri = (np.asarray(t[c])[w] for t, c, w in ((anchors, "label", a), (rows, "label", r), (anchors, "vec_id", a), (rows, "vec_id", r)))
            at, wanted = np.asarray(anchors["row"])[a], anchors["positives"].take(a).to_pylist()
            held = Packed(rv, int(np.abs(av).max()) + 1)
            for i in range(len(a)):
                scores = held.scores(av[i])
                fit = np.flatnonzero((rl != al[i]) & (ri != ai[i]))
                s, ids = scores[fit], ri[fit]
                for p in wanted[i]:
                    best = int(p["positive_score"])
                    least, top = _band(best, low, high)
                    inside = np.flatnonzero((s >= least) & (s <= top))
                    for j in inside[_best(s[inside], ids[inside], most)].tolist():
                        out.append((at[i], ai[i], p["positive_id"], p["nth"], best, ids[j], int(s[j])))
        return _table(out, schema)

    return find, f"anchor long, anchor_id long, positive_id long, nth int, positive_score {SCORE}, negative_id long, negative_score {SCORE}"


def _band(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score ``s`` with ``low * positive <= 100 * s <= high * positive``."""
    return -(-low * positive // 100), high * positive // 100


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    label: Column | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; ``anchor`` marks the anchors by ``vec_id`` and
    ``label`` replaces the label column.  An anchor's positives are its ``positives`` best rows of
    the same label; for each, the ``negatives`` best rows of another label whose score is between ``low`` and
    ``high`` hundredths of the positive's.  Scores are integer inner products of ``floor(256 * x)``; higher ones
    come first, then smaller ids.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part, nor do
    components of 2**46 or more, whose scores no long could hold; a score that fits no long is null
    (it is still ranked exactly).  Rows of an anchor's own id are never its partners.  Equal rows each count;
    vectors of another length are not compared; empty vectors and empty tables give no rows; other columns are ignored.
    """
    shared = Shared(vectors.sparkSession)
    given = vectors if label is None else vectors.withColumn("label", label)
    rows = shared.put("rows", scaled_rows(given))
    anchors = shared.put("anchors", rows.where(anchor))
    n_rows, n_anchors = rows.count(), anchors.count()
    find, kind = _positives(positives)
    left, right = _grid(anchors, rows, n_anchors, n_rows)
    found = left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(find, kind)
    best = top_per_key(found, ["anchor"], [F.desc("positive_score"), F.col("positive_id")], positives, "nth")
    chosen = shared.put("positives", best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives")))
    asked = shared.put("asked", anchors.join(chosen, anchors["row"] == chosen["anchor"]).drop("anchor"))
    find, kind = _negatives(negatives, low, high)
    left, right = _grid(asked, rows, n_anchors, n_rows)
    found = left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(find, kind)
    ranked = top_per_key(found, ["anchor", "nth"], [F.desc("negative_score"), F.col("negative_id")], negatives)
    score = lambda name: F.expr(f"try_cast({name} AS bigint)").alias(name)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", score("positive_score"), score("negative_score"))
