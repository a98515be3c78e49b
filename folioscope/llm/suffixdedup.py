"""Repeated passages: suffix arrays over shards of the corpus, cut where content says so.

A string of ``length`` bytes is placed in a shard by its anchor: the piece of ``PIECE`` bytes in it
with the smallest hash, the leftmost of equals.  Equal strings have equal anchors at equal
places, so all starts of a string meet under one anchor, wherever they are.  The starts of a
text that share an anchor are one region of fewer than ``2 * length`` bytes.

Only anchors that occur twice can hold a repeated string.  Where all regions of one are equal, all their
strings are repeated; the regions of the others, equal ones once, are the shards: each shard gets a suffix array by induced sorting, and its permuted common prefixes
tell which starts share ``length`` bytes with another.  An anchor with more than
``HOT`` different regions (a passage in very many texts) would make one shard too large: its regions are dealt
to several shards.  Each of these also tells its different strings, once each; a string told by two shards is
repeated too, and goes back to the shards that hold it once.  That gives the same starts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Shared, text_batches
from folioscope.llm.suffixes import permuted_common_prefixes, suffix_array

PIECE = 32
# Bytes of regions in a shard, roughly.
SHARD_BYTES = 1 << 20
HOT = 1000
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
_PLACE = 24  # bits of a key that hold a position


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``PIECE`` bytes from each position on."""
    x = _BYTE[data]
    x ^= x >> np.uint64(29)
    width, factor = 1, 0xD6E8FEB86659FD93
    while width < PIECE:
        x = x[:-width] * np.uint64(factor) + x[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, first, last)`` of every region of texts that lie behind each other in ``data``.

    ``first`` and ``last`` are the region's first and last start, from the text's beginning.
    """
    n, window = len(data), length - PIECE + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none
    texts, hashes, firsts, lasts = [], [], [], []
    step = (1 << _PLACE) - 2 * length
    for base in range(0, n - length + 1, step):
        h = _piece_hashes(data[base:base + step + length - 1])
        keys = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        low, width = keys, 1
        while 2 * width <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < window:
            low = np.minimum(low[:len(low) - (window - width)], low[window - width:])
        anchor = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        start = np.arange(len(anchor)) + base
        text = np.searchsorted(ends, start, side="right")
        whole = start + length <= ends[np.minimum(text, len(ends) - 1)]
        start, text, anchor = start[whole], text[whole], anchor[whole]
        if not len(start):
            continue
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        at = np.flatnonzero(new)
        begin = np.concatenate([[0], ends])[text[at]]
        texts.append(text[at])
        hashes.append(h[anchor[at]].view(np.int64))
        firsts.append(start[at] - begin)
        lasts.append(start[np.append(at[1:], len(start)) - 1] - begin)
    if not texts:
        return none, none, none, none
    return tuple(map(np.concatenate, (texts, hashes, firsts, lasts)))


def _raw(texts: list) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _digest(region: bytes) -> int:
    """64 bits that stand, beside the anchor's 64, for a region."""
    return int.from_bytes(hashlib.blake2b(region, digest_size=8).digest(), "little", signed=True)


def repeated_in_shard(regions: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """Of all positions of the joined regions, the starts of strings that occur elsewhere."""
    sizes = np.array([len(r) for r in regions], np.int64)
    # a separator behind each region; no string runs over one
    data = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
    stops = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(data), bool)
    inside[stops] = False
    data[inside] = np.frombuffer(b"".join(regions), np.uint8).astype(np.uint16) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    order = suffix_array(data, 257)
    common = permuted_common_prefixes(data, order, stops[owner])
    long = common >= length
    found = long.copy()
    behind = np.flatnonzero(long[order])
    found[order[behind - 1]] = True  # a pair of neighbours is found from its later one
    return found | ((counts[owner] > 1) & (np.arange(len(data)) + length <= stops[owner]))


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


KEY = ["id", "hash_of_text"]
REGION = ["anchor", "digest"]


def repeated_passages(docs: DataFrame, length: int = 200) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` of every document (doc_id, text).

    ``spans`` are the maximal runs of bytes (start, end) covered by strings of ``length`` bytes that
    also start anywhere else, in the same document or in another, judged on the input; ``kept`` is the
    rest as bytes.  A null text is an empty one.  Matches never cross documents; rows of equal or null id
    stay separate rows, and repeat each other like any two.  Other columns are ignored.
    """
    if length < PIECE:
        raise ValueError(f"length must be at least {PIECE}")
    shared = Shared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("hash_of_text"), "doc_id", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            raws = _raw(batch.column(2).to_pylist())
            text, hashes, first, last = anchors(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]), length)
            digests = [_digest(raws[t][a:b]) for t, a, b in zip(text.tolist(), first.tolist(), (last + length).tolist())]
            which = pa.array(text, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(hashes, pa.int64()), pa.array(digests, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], [*KEY, *REGION, "first", "last"])

    places = shared.put("places", rows.select(*KEY, "text").mapInArrow(find, "id long, hash_of_text long, anchor long, digest long, first int, last int"))
    twice = shared.put("twice", places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1"))
    # where all regions of an anchor are equal, every string of theirs is repeated
    kept = shared.put("kept", places.join(twice.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchor"))
    shared.drop("places")
    one = F.min(F.struct(*KEY, "first", "last")).alias("one")
    mixed = shared.put("mixed", kept.where("mixed").groupBy(*REGION).agg(F.count(F.lit(1)).alias("n"), one))
    hot = mixed.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / max(1, HOT)).alias("pieces"))
    asked = mixed.join(hot, "anchor").select(*REGION, "n", "pieces", "one.*").groupBy(*KEY).agg(F.collect_list(F.struct(*REGION, "n", "pieces", "first", "last")).alias("asked"))

    def cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            out = []
            for raw, asked in zip(_raw(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                out += [(x["anchor"], x["digest"], x["n"], x["pieces"], raw[x["first"]:x["last"] + length]) for x in asked]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], [*REGION, "n", "pieces", "region"])

    # rows of equal id and text hold the same regions: any of them will do
    chosen = rows.select(*KEY, "text").join(asked, KEY).select("text", "asked").mapInArrow(cut_regions, "anchor long, digest long, n long, pieces long, region binary")
    parts = shared.put("regions", chosen).withColumn("hot", F.col("pieces") > 1)
    shared.drop("mixed")
    size = parts.where("not hot").agg(F.sum(F.length("region"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))

    def sort(table: pa.Table) -> pa.Table:
        held = {(a, d): (r, n, hot) for a, d, r, n, hot in zip(*(table[c].to_pylist() for c in (*REGION, "region", "n", "hot")))}
        names = sorted(held)
        found = repeated_in_shard([held[x][0] for x in names], np.array([held[x][1] for x in names]), length)
        ends = np.cumsum([len(held[x][0]) + 1 for x in names])
        a, b = _runs(found)
        owner = np.searchsorted(ends, a, side="right")  # separators are never found, so no run crosses one
        begin = np.concatenate([[0], ends])
        keys = np.array(names, np.int64).reshape(-1, 2)
        runs = pa.table({"anchor": keys[owner, 0], "digest": keys[owner, 1], "a": pa.array(a - begin[owner], pa.int32()), "b": pa.array(b - begin[owner], pa.int32()), "string": pa.nulls(len(a), pa.binary())})
        told: dict[bytes, tuple] = {}
        for i, name in enumerate(names):
            region, _, hot = held[name]
            for at in range(len(region) - length + 1) if hot else ():
                # a string that is found is a run already: it has no place to go back to
                told.setdefault(hashlib.blake2b(region[at:at + length], digest_size=16).digest(), (*name, -1 if found[begin[i] + at] else at))
        if not told:
            return runs
        anchor, digest, at = zip(*told.values())
        return pa.concat_tables([runs, pa.table({"anchor": pa.array(anchor, pa.int64()), "digest": pa.array(digest, pa.int64()), "a": pa.array(at, pa.int32()), "b": pa.array(at, pa.int32()), "string": pa.array(list(told), pa.binary())})])

    # the regions of a hot anchor are dealt by their own digests
    of = F.when(F.col("hot"), F.concat_ws(":", F.lit("hot"), F.col("anchor").cast("string"), F.pmod("digest", F.col("pieces")).cast("string"))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("string"))
    dealt = parts.dropDuplicates(REGION).select(*REGION, "region", "n", "hot", of.alias("shard"))
    sorted_ = shared.put("sorted", dealt.groupBy("shard").applyInArrow(sort, "anchor long, digest long, a int, b int, string binary"))
    told = sorted_.where("string is not null")
    # no string has two places to go back to in a shard, so two rows of one are two shards
    often = told.groupBy("string").agg(F.count(F.lit(1)).alias("shards"), F.max("a").alias("last")).where("shards > 1 and last >= 0")
    counted = told.where("a >= 0").join(often.select("string"), "string").select(*REGION, "a", "b")
    sorted_ = sorted_.where("string is null").select(*REGION, "a", "b")
    found = shared.put("found", sorted_.unionByName(counted).groupBy(*REGION).agg(F.collect_list(F.struct("a", "b")).alias("runs")))
    shared.drop("regions")
    shared.drop("sorted")

    def run(a, b):
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    whole = kept.where("not mixed").select(*KEY, F.array(run(F.col("first"), F.col("last"))).alias("runs"))
    some = kept.where("mixed").join(found, REGION).select(*KEY, F.transform("runs", lambda r: run(r["a"] + F.col("first"), r["b"] + F.col("first"))).alias("runs"))
    covered = whole.unionByName(some).groupBy(*KEY).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    joined = rows.join(covered, KEY, "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            spans, rest, sizes = [], [], []
            for raw, runs in zip(_raw(batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                gone: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"] + length) for r in runs or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in gone])
                rest.append(b"".join(raw[x:y] for x, y in zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], len(raw)])))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
