"""Packing: documents in order, cut into training sequences by dynamic programming.

The documents, in ascending ``doc_id`` order and each closed by an end token, are
one long row of tokens.  It is cut into windows of at most ``length`` tokens.  A
cut behind a document is free, one behind a sentence costs ``SENTENCE_COST``
tokens, and one inside a sentence ``WORD_COST``; every missing token of a window
costs one.  The cheapest cuts are found exactly: with ``f[k]`` the least cost up to
candidate position ``c[k]``,

    f[k] = length - c[k] + cost[k] + min(f[i] + c[i] : c[k] - c[i] <= length)

and the minimum over that sliding range comes from a monotone queue, so each
candidate enters and leaves once.

Each task plans its range of ``doc_id`` in segments of about ``SEGMENT`` tokens,
which bounds its memory by one segment and one document.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_batches
from folioscope.llm.tokens import encoder

SENTENCE_COST = 2
WORD_COST = 12
# Inside longer stretches without a sentence end, a cut may fall every so many tokens.
STRIDE = 32
SEGMENT = 1 << 20

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, boundary string")


def best_cuts(places: np.ndarray, costs: np.ndarray, length: int) -> np.ndarray:
    """The cheapest window ends among ascending ``places``; the last is always one.

    No two neighbours in ``[0, *places]`` may be more than ``length`` apart.
    """
    c, cost = [0, *places.tolist()], [0, *costs.tolist()]
    best, back = [0] * len(c), [0] * len(c)
    queue = deque([0])  # of starts, by rising best + place
    for k in range(1, len(c)):
        here = c[k]
        while here - c[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[k] = i
        best[k] = best[i] + c[i] + length - here + cost[k]
        value = best[k] + here
        while queue and best[queue[-1]] + c[queue[-1]] >= value:
            queue.pop()
        queue.append(k)
    cuts, k = [], len(c) - 1
    while k:
        cuts.append(c[k])
        k = back[k]
    return np.array(cuts[::-1], np.int64)


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, none more than ``length`` behind the one before, and what ending there costs."""
    stride = min(STRIDE, length)
    known = np.union1d(doc_ends, sentence_ends)
    gaps = np.diff(known, prepend=0)
    more = np.maximum((gaps - 1) // stride, 0)
    more[gaps <= min(2 * stride, length)] = 0
    first = np.repeat(known - gaps, more)
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    inner = first + nth * stride
    places = np.concatenate([known, inner])
    costs = np.concatenate([np.where(np.isin(known, doc_ends), 0, SENTENCE_COST), np.full(len(inner), WORD_COST)])
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def _segment_pieces(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, sentence_ends: np.ndarray, length: int, first: int) -> tuple[pa.RecordBatch, int]:
    doc_ends = np.cumsum(lengths)
    places, costs = candidates(doc_ends, sentence_ends, length)
    cuts = best_cuts(places, costs, length)
    ends = np.union1d(cuts, doc_ends)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(doc_ends, starts, side="right")
    window = np.searchsorted(cuts, starts, side="right")
    window_start = np.concatenate([[0], cuts])[window]
    raw = ids.astype("<u4").tobytes()
    crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
    how = np.where(np.isin(ends, doc_ends), "document", np.where(np.isin(ends, sentence_ends), "sentence", "word"))
    return pa.record_batch({
        "doc_id": pa.array([doc_ids[i] for i in doc.tolist()], pa.int64()), "start": starts - (doc_ends - lengths)[doc], "length": ends - starts,
        "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": lengths[doc], "sequence_id": first + window,
        "offset": starts - window_start, "boundary": pa.array(how.tolist(), pa.string())}), len(cuts)


def pack(docs: DataFrame, tokenizer_file: str, length: int = 1024, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places in sequences.

    One row per piece: the document, where the piece starts in it, its length,
    checksum, the document's tokens, the sequence and the place there, and the kind
    of boundary it ends at.  Null and empty texts are the end token alone.
    Documents of equal id follow each other by their text's hash; null ids come
    first.  Other columns are ignored; an empty table gives no rows.  ``partitions``
    are ranges of ids (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_file).encode
        made = TaskContext.get().partitionId() << 40
        doc_ids, held, held_tokens = [], [], 0
        for batch in text_batches(batches):
            ids, offsets, ends = encode(batch.column(1).to_pylist(), end_id)
            doc_ids += batch.column(0).to_pylist()
            held.append((ids, np.diff(offsets), ends + held_tokens))
            held_tokens += len(ids)
            if held_tokens >= SEGMENT:
                out, count = _segment_pieces(doc_ids, np.concatenate([x[1] for x in held]), np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held]), length, made)
                made += count
                yield out
                doc_ids, held, held_tokens = [], [], 0
        if held:
            yield _segment_pieces(doc_ids, np.concatenate([x[1] for x in held]), np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held]), length, made)[0]

    ranged = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ranged.mapInArrow(run, SCHEMA)


def padding(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """Sequences, tokens and padding of packed pieces, in one row."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("tokens"), F.sum(length - F.col("used")).alias("padding"))
