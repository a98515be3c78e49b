"""Approximate nearest neighbours by inner product: a graph by NN-descent, queries by greedy search.

**Graph.**  Every vector starts with its best few among the members of some random blocks.  Then, turn
by turn, each vector tells its neighbours, and its neighbours' lists it, of a sample of its list (those
not told yet first): a vector where lists meet compares all that met there, and sends each
the others that are closer than the worst on its list.  The lists are joined with these finds and cut to
``DEGREE``.  It ends when a turn changes fewer than ``SETTLED`` of all entries.  The turns are equi-joins
of stored tables; the rows of a vector on very many lists are split among several meetings.

**Search.**  A query has a pool of its best vectors so far.  In each round the next ``STEP``
unexpanded ones are joined with the graph, their neighbours are scored where the graph lies, and what beats
the pool's worst joins it.  A query is done when its pool holds nothing unexpanded.

Equal vectors are one node, so ties never crowd a list.  Vectors of different norms get one more
component that makes all norms equal, under which larger inner products are nearer for any query.
The graph works in single precision; the results' scores are computed in double from the given vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Shared
from folioscope.operators.skew import top_per_key
from folioscope.session import broadcast_if_small

DEGREE, SAMPLE, EACH = 40, 20, 8
# Random blocks to start from: how many for a vector, members of each, and neighbours taken from one.
STARTS, START_BLOCK, START_BEST = 3, 1024, 16
SETTLED = 0.25
# Reverse links that the graph adds to a list, size of a query's pool, vectors expanded in a round.
REVERSE, POOL, STEP = 20, 256, 40
# A search ends when fewer than this part of a full round is left to expand.
LEFT = 0.02
# Bytes of the vectors that a block of meetings or of the graph may need, and queries of a part.
BLOCK_BYTES, PART = 96 << 20, 256

LISTS = "home int, node long, vec binary, ids array<long>, scores array<float>, fresh array<boolean>, worst float, added int"
FOUND = pa.schema({"node": pa.int64(), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float32())})
# finds for one home (a part of the nodes) in one row: the nodes, how many finds each has, and the finds
FINDS = "to int, nodes array<long>, sizes array<int>, ids array<long>, scores array<float>"
_FINDS = pa.schema({"to": pa.int32(), "nodes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float32())})


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, kind))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(values, sizes)`` of a column of lists."""
    whole = column.combine_chunks()
    return np.asarray(whole.flatten()), np.diff(np.asarray(whole.offsets))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows, read where they lie."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    if not len(whole):
        return np.empty((0, 1), np.float32)
    stops = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset:whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[stops[0]:stops[-1]]
    return np.ascontiguousarray(data).view(np.float32).reshape(len(whole), -1)


def _freed(table: pa.Table) -> pa.Table:
    """``table``; what the work before it no longer uses goes back to the system, as a worker lives on."""
    pa.default_memory_pool().release_unused()
    return table


def home_of(nodes: np.ndarray, homes: int) -> np.ndarray:
    """``pmod(xxhash64(node), homes)`` as Spark computes it."""
    u = np.uint64
    p1, p2, p3, p4, p5 = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    h = (u(42 + 8) + p5) ^ (turned(np.asarray(nodes, np.int64).view(u) * p2, 31) * p1)
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> u(33))) * p2
    h = (h ^ (h >> u(29))) * p3
    return np.mod((h ^ (h >> u(32))).view(np.int64), homes)


def _dealt(node: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int, homes: int) -> pa.Table:
    """The best ``most`` distinct ids of each node, one row for each home that has some."""
    found = _grouped(node, ids, scores, most)
    if not found.num_rows:
        return _FINDS.empty_table()
    nodes, (ids, sizes), (scores, _) = np.asarray(found["node"]), _flat(found["ids"]), _flat(found["scores"])
    to = home_of(nodes, homes)
    order = np.argsort(to, kind="stable")
    rows = np.argsort(np.repeat(to, sizes), kind="stable")
    parts, counts = np.unique(to, return_counts=True)
    finds = np.bincount(np.searchsorted(parts, to), weights=sizes, minlength=len(parts)).astype(np.int64)
    return pa.Table.from_arrays([pa.array(parts.astype(np.int32)), _lists(nodes[order], counts, pa.int64()), _lists(sizes[order].astype(np.int32), counts, pa.int32()),
                                 _lists(ids[rows], finds, pa.int64()), _lists(scores[rows], finds, pa.float32())], schema=_FINDS)


def _grouped(node: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int, schema: pa.Schema = FOUND) -> pa.Table:
    """The best ``most`` distinct ids of each node, one row a node."""
    order = np.lexsort((ids, node))
    node, ids, scores = node[order], ids[order], scores[order]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])]) if len(node) else np.empty(0, bool)
    node, ids, scores = node[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, node))
    node, ids, scores = node[order], ids[order], scores[order]
    kept = np.arange(len(node)) - np.searchsorted(node, node) < most
    names, sizes = np.unique(node[kept], return_counts=True)
    return pa.Table.from_arrays([pa.array(names, pa.int64()), _lists(ids[kept], sizes, pa.int64()), _lists(scores[kept], sizes, pa.float32())], schema=schema)


def _start(homes: int):
    """Best neighbours inside one random block."""
    def start(table: pa.Table) -> pa.Table:
        nodes, vectors = np.asarray(table["node"]), _vectors(table["vec"])
        scores = vectors @ vectors.T
        np.fill_diagonal(scores, -np.inf)
        best = min(START_BEST, len(nodes) - 1)
        if best < 1:
            return _FINDS.empty_table()
        at = np.argpartition(-scores, best - 1, axis=1)[:, :best]
        return _dealt(np.repeat(nodes, best), nodes[at].reshape(-1), np.take_along_axis(scores, at, 1).reshape(-1), best, homes)

    return start


def _mixed(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A number for each pair and turn, the same in every task."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(turn * 0x632BE59B + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _sampled(at: np.ndarray, node: np.ndarray, ids: np.ndarray, fresh: np.ndarray, turn: int, sample: int) -> np.ndarray:
    """Which entries of the lists are told this turn: those not told yet, then others, at random."""
    order = np.lexsort((_mixed(node, ids, turn), ~fresh, at))
    out = np.zeros(len(at), bool)
    out[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order]) < sample
    return out


def _merge(degree: int, turn: int, sample: int):
    """Joins lists with finds: the best ``degree`` of both; entries told in this turn are no longer fresh."""
    schema = pa.schema({"home": pa.int32(), "node": pa.int64(), "vec": pa.binary(), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float32()), "fresh": pa.list_(pa.bool_()), "worst": pa.float32(), "added": pa.int32()})

    def merge(lists: pa.Table, finds: pa.Table) -> pa.Table:
        if not lists.num_rows:
            return schema.empty_table()
        lists = lists.sort_by("node")
        nodes = np.asarray(lists["node"])
        ids, sizes = _flat(lists["ids"])
        scores, fresh = _flat(lists["scores"])[0], _flat(lists["fresh"])[0]
        at = np.repeat(np.arange(len(nodes)), sizes)
        fresh = fresh & ~_sampled(at, nodes[at], ids, fresh, turn, sample) if len(at) else fresh.astype(bool)
        new_ids = _flat(finds["ids"])[0]
        new_at = np.repeat(np.searchsorted(nodes, _flat(finds["nodes"])[0]), _flat(finds["sizes"])[0])
        at, ids = np.concatenate([at, new_at]).astype(np.int64), np.concatenate([ids, new_ids]).astype(np.int64)
        scores = np.concatenate([scores, _flat(finds["scores"])[0]]).astype(np.float32)
        is_new = np.arange(len(at)) >= len(at) - len(new_at)
        fresh = np.concatenate([fresh, np.ones(len(new_at), bool)])
        order = np.lexsort((is_new, ids, at))
        first = np.concatenate([[True], (at[order][1:] != at[order][:-1]) | (ids[order][1:] != ids[order][:-1])])[:len(order)]
        kept = order[first]
        order = kept[np.lexsort((ids[kept], -scores[kept], at[kept]))]
        order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < degree]
        sizes = np.bincount(at[order], minlength=len(nodes))
        worst = np.full(len(nodes), -np.inf, np.float32)
        full = sizes >= degree
        worst[full] = scores[order][np.cumsum(sizes)[full] - 1]
        added = np.bincount(at[order], weights=is_new[order], minlength=len(nodes))
        return pa.Table.from_arrays([lists["home"], lists["node"], lists["vec"], _lists(ids[order], sizes, pa.int64()), _lists(scores[order], sizes, pa.float32()), _lists(fresh[order], sizes, pa.bool_()), pa.array(worst), pa.array(added.astype(np.int32))], schema=schema)

    return merge


def _tell(turn: int, sample: int):
    """The lists as what is told: ``told`` to ``at``; a list's owner gets it whole, the listed get the owner."""
    schema = pa.schema({"at": pa.int64(), "told": pa.list_(pa.int64()), "fresh": pa.list_(pa.bool_()), "back": pa.bool_()})

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            nodes = np.asarray(table["node"])
            ids, sizes = _flat(table["ids"])
            if not len(ids):
                continue
            fresh = _flat(table["fresh"])[0]
            at = np.repeat(np.arange(len(nodes)), sizes)
            told = _sampled(at, nodes[at], ids, fresh, turn, sample)
            at, ids, fresh = at[told], ids[told], fresh[told]
            sizes = np.bincount(at, minlength=len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), _lists(ids, sizes, pa.int64()), _lists(fresh, sizes, pa.bool_()), pa.array(np.zeros(len(nodes), bool))], schema=schema)
            one = np.ones(len(ids), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(nodes[at], one, pa.int64()), _lists(fresh, one, pa.bool_()), pa.array(np.ones(len(ids), bool))], schema=schema)

    return tell


def _meet(each: int, degree: int, width: int, turn: int, homes: int):
    """Compares all that were told to one vector, at most ``width`` at a time; finds for each of them."""
    def meet(told: pa.Table, vectors: pa.Table) -> pa.Table:
        if not told.num_rows or not vectors.num_rows:
            return _FINDS.empty_table()
        order = np.argsort(np.asarray(vectors["node"]))
        names, matrix, worst = np.asarray(vectors["node"])[order], _vectors(vectors["vec"])[order], np.asarray(vectors["worst"])[order]
        ids, sizes = _flat(told["told"])
        fresh = _flat(told["fresh"])[0]
        at, part = (np.repeat(np.asarray(told[c]), sizes) for c in ("at", "part"))
        x = np.searchsorted(names, ids)
        order = np.lexsort((~fresh, x, part, at))
        at, part, x, fresh = at[order], part[order], x[order], fresh[order]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (x[1:] != x[:-1])])
        at, part, x, fresh = at[new], part[new], x[new], fresh[new]
        order = np.lexsort((_mixed(at, x, turn), part, at))
        at, part, x, fresh = at[order], part[order], x[order], fresh[order]
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
        nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        group, place = np.cumsum(nth % width == 0) - 1, nth % width
        member = np.full((group[-1] + 1, width), -1)
        member[group, place] = x
        is_fresh = np.zeros(member.shape, bool)
        is_fresh[group, place] = fresh
        out, best = [], min(each, width - 1)
        for a in range(0, len(member), 512):
            m, f = member[a:a + 512], is_fresh[a:a + 512]
            v = matrix[m]
            s = v @ v.transpose(0, 2, 1)
            s[~((m >= 0)[:, :, None] & (m >= 0)[:, None, :] & (f[:, :, None] | f[:, None, :]))] = -np.inf
            s[:, np.arange(width), np.arange(width)] = -np.inf
            near = np.argpartition(-s, best - 1, axis=2)[:, :, :best]
            score = np.take_along_axis(s, near, 2)
            g, i, j = np.nonzero(score > worst[m][:, :, None])
            out.append((m[g, i], m[g, near[g, i, j]], score[g, i, j]))
        u, v, s = (np.concatenate(c) for c in zip(*out))
        sure = u >= 0
        return _freed(_dealt(names[u[sure]], names[v[sure]], s[sure], degree, homes))

    return meet


class Index:
    """The neighbour graph of a table of vectors; see ``build``."""

    def __init__(self, vectors: DataFrame, degree: int = DEGREE, sample: int = SAMPLE, settled: float = SETTLED):
        self.shared, self.degree, self.sample, self.settled = Shared(vectors.sparkSession), degree, sample, settled
        self._nodes(vectors)
        self._descend()
        self._graph()

    def _nodes(self, vectors: DataFrame) -> None:
        """Stores ``rows`` (vec_id, x), ``nodes`` (node, vec, x) and ``members`` (node, vec_id)."""
        x = F.transform("embedding", lambda v: v.cast("double"))
        finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 1.7976931348623157e308)
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
            F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", finite) & F.exists("x", lambda v: v != 0))
        rows = self.shared.put("given", rows)
        usual = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        self.dims = usual.dims if usual else 1
        self.rows = rows.where(F.size("x") == self.dims)
        distinct = self.shared.put("distinct", self.rows.groupBy("x").agg(F.min("vec_id").alias("node")))
        self.exact = distinct
        self.members = self.shared.put("members", self.rows.join(distinct, "x").select("node", "vec_id"))
        self.count = distinct.count()
        scale = distinct.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 1.0
        norm = distinct.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / scale) * (v / scale)))).first()[0] or 1.0
        self.scale, self.norm = float(scale), float(norm) ** 0.5
        nodes = distinct.select("node", "x").mapInArrow(_levelled(self.scale, self.norm, self.dims, True), "node long, vec binary")
        self.nodes = self.shared.put("nodes", nodes)
        # blocks by how many vectors they may need
        per = BLOCK_BYTES // (4 * (self.dims + 1) * (self.degree + REVERSE))
        self.homes = max(1, -(-self.count // max(64, per)))

    def _home(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.homes)).cast("int")

    def _descend(self) -> None:
        shared, blocks = self.shared, max(1, -(-self.count // START_BLOCK))
        blank = self.nodes.select(self._home("node").alias("home"), "node", "vec", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("scores"),
                                  F.array().cast("array<boolean>").alias("fresh"), F.lit(float("-inf")).cast("float").alias("worst"), F.lit(0).alias("added"))
        dealt = self.nodes.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).withColumn("block", F.pmod(F.xxhash64("node", "try"), F.lit(blocks)))
        finds = dealt.groupBy("try", "block").applyInArrow(_start(self.homes), FINDS)
        lists, turn = self._merged(blank, finds, -1), 0
        self.turns: list[int] = []
        while True:
            told = self._told(lists, turn)
            meet = _meet(EACH, self.degree, 2 * self.sample, turn, self.homes)
            wanted = told.select(F.col("block").alias("of"), F.explode("told").alias("node")).distinct().join(lists.select("node", "vec", "worst"), "node")
            finds = told.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(meet, FINDS)
            merged = self._merged(lists, finds, turn)
            shared.drop(f"lists-{turn - 1}")
            shared.drop(f"told-{turn}")
            lists, turn = merged, turn + 1
            added = int(lists.agg(F.sum("added")).first()[0] or 0)
            self.turns.append(added)
            if added <= self.settled * self.degree * self.count:
                break
        self.lists = lists

    def _merged(self, lists: DataFrame, finds: DataFrame, turn: int) -> DataFrame:
        return self.shared.put(f"lists-{turn}", lists.groupBy("home").cogroup(finds.groupBy("to")).applyInArrow(_merge(self.degree, turn, self.sample), LISTS))

    def _told(self, lists: DataFrame, turn: int) -> DataFrame:
        """What is told this turn, by block of meetings; a vector on very many lists has several meetings."""
        rows = lists.select("node", "ids", "fresh").mapInArrow(_tell(turn, self.sample), "at long, told array<long>, fresh array<boolean>, back boolean")
        stored = self.shared.put(f"told-{turn}", rows)
        width = 2 * self.sample
        often = self.shared.put(f"often-{turn}", stored.where("back").groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * width)
                                .select("at", F.ceil(F.col("n") / width).cast("int").alias("parts")))
        part = F.when(F.col("back") & F.col("parts").isNotNull(), F.pmod(F.xxhash64("told"), F.col("parts"))).otherwise(0).cast("int")
        dealt = stored.join(broadcast_if_small(often), "at", "left").withColumn("part", part)
        return dealt.select("at", "told", "fresh", "part", F.pmod(F.xxhash64("at", "part"), F.lit(self.homes)).cast("int").alias("block"))

    def _graph(self) -> None:
        """Stores ``graph``: a row per block, its nodes' lists (with the best reverse links) and the vectors they need."""
        links = self.lists.select("node", F.explode(F.arrays_zip("ids", "scores")).alias("_l")).select(F.col("_l.ids").alias("of"), "node", F.col("_l.scores").alias("score"))
        back = top_per_key(links, ["of"], [F.desc("score"), F.col("node")], REVERSE).groupBy("of").agg(F.collect_list("node").alias("back"))
        lists = self.shared.put("linked", self.lists.select("home", "node", "ids").join(back, F.col("node") == F.col("of"), "left").select(
            "home", "node", F.array_distinct(F.concat("ids", F.coalesce("back", F.array().cast("array<long>")))).alias("ids")))
        wanted = lists.select("home", F.explode("ids").alias("node")).distinct().join(self.nodes, "node").select(F.col("home").alias("of"), "node", "vec")
        graph = lists.groupBy("home").cogroup(wanted.groupBy("of")).applyInArrow(_bundle, "home int, nodes binary, stops binary, links binary, ids binary, vectors binary")
        self.graph = self.shared.put("graph", graph)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of the rows that ``queries`` (vec_id) names, but for themselves."""
        shared, empty = self.shared, F.array().cast("array<long>")
        asked = self.rows.join(queries.select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "x")
        asked = shared.put("asked", asked.withColumn("row", F.monotonically_increasing_id()))
        n = asked.count()
        parts = max(1, -(-n // PART))
        level = asked.select(F.col("row").alias("node"), "x").mapInArrow(_levelled(self.scale, self.norm, self.dims, False), "node long, vec binary").withColumnRenamed("node", "row")
        own = self.exact.join(self.lists.select("node", "ids"), "node").select("x", F.concat(F.array("node"), "ids").alias("todo"))
        begun = asked.join(own, "x").select("row", "todo").join(level, "row")
        pools = shared.put("pools-0", begun.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "row", "vec", empty.alias("ids"), F.array().cast("array<float>").alias("scores"),
                                                   empty.alias("done"), "todo"))
        turn = 0
        while (left := int(pools.agg(F.sum(F.size("todo"))).first()[0] or 0)) > (LEFT * STEP * n if turn else 0):
            worst = F.when(F.size("scores") >= POOL, F.element_at("scores", -1)).otherwise(float("-inf")).cast("float")
            front = pools.where(F.size("todo") > 0).select("row", "vec", worst.alias("worst"), F.explode("todo").alias("node")).withColumn("of", self._home("node"))
            found = front.groupBy("of").cogroup(self.graph.groupBy("home")).applyInArrow(_expand, "node long, ids array<long>, scores array<float>")
            found = found.withColumn("to", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
            turn += 1
            pools = shared.put(f"pools-{turn}", pools.groupBy("part").cogroup(found.groupBy("to")).applyInArrow(
                _pooled, "part int, row long, vec binary, ids array<long>, scores array<float>, done array<long>, todo array<long>"))
            shared.drop(f"pools-{turn - 1}")
        self.rounds, self.left = turn, left
        best = pools.select("row", F.explode(F.slice("ids", 1, 3 * k)).alias("node"))
        product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        scored = best.join(asked, "row").join(self.exact.select("node", F.col("x").alias("y")), "node").select("row", "query_id", "node", product.alias("score"))
        first = top_per_key(self.members, ["node"], [F.col("vec_id")], k + 1).drop("rank")
        rows = scored.join(first, "node").where("vec_id != query_id")
        return top_per_key(rows, ["row"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def _levelled(scale: float, norm: float, dims: int, fill: bool):
    """Vectors over the largest norm, in single precision, with a component that makes the norms equal (queries: zero)."""
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dims) / scale / norm
            if not fill:
                # a query's length does not matter: unit length keeps it in range
                x = x / np.abs(x).max(axis=1, keepdims=True).clip(1e-300)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            rest = np.sqrt(np.clip(1 - (x * x).sum(axis=1), 0, None)) * fill
            vectors = np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["node", "vec"])

    return level


def _bundle(lists: pa.Table, vectors: pa.Table) -> pa.Table:
    """A block of the graph in one row; links are places among the block's vectors."""
    names = ["nodes", "stops", "links", "ids", "vectors"]
    schema = pa.schema([pa.field("home", pa.int32()), *(pa.field(n, pa.binary()) for n in names)])
    if not lists.num_rows:
        return schema.empty_table()
    lists, vectors = lists.sort_by("node"), vectors.sort_by("node")
    ids, sizes = _flat(lists["ids"])
    known = np.asarray(vectors["node"])
    cells = (np.asarray(lists["node"]), np.cumsum(sizes), np.searchsorted(known, ids).astype(np.int32), known)
    data = [*(c.tobytes() for c in cells), _vectors(vectors["vec"]).tobytes()]
    return _freed(pa.table([lists["home"][:1], *(pa.array([d], pa.binary()) for d in data)], schema=schema))


def _expand(front: pa.Table, block: pa.Table) -> pa.Table:
    """Neighbours of the nodes to expand that beat the worst of the query's pool."""
    if not front.num_rows or not block.num_rows:
        return FOUND.empty_table()
    row = {c: block[c][0].as_buffer() for c in ("nodes", "stops", "links", "ids", "vectors")}
    nodes, stops, ids = (np.frombuffer(row[c], np.int64) for c in ("nodes", "stops", "ids"))
    links = np.frombuffer(row["links"], np.int32)
    if not len(ids):
        return FOUND.empty_table()
    matrix = np.frombuffer(row["vectors"], np.float32).reshape(len(ids), -1)
    front = front.sort_by("row")
    query, at = np.asarray(front["row"]), np.searchsorted(nodes, np.asarray(front["node"]))
    worst, cells = np.asarray(front["worst"]), front["vec"]
    begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    out_ids, out_scores, sizes = [], [], []
    starts = np.concatenate([[0], stops[:-1]])
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(query)]):
        x = np.unique(np.concatenate([links[starts[i]:stops[i]] for i in at[a:b].tolist()]))
        scores = matrix[x] @ np.frombuffer(cells[a].as_py(), np.float32)
        better = np.flatnonzero(scores > worst[a])
        if len(better) > POOL:
            better = better[np.argpartition(-scores[better], POOL - 1)[:POOL]]
        out_ids.append(ids[x[better]])
        out_scores.append(scores[better])
        sizes.append(len(better))
    return pa.Table.from_arrays([pa.array(query[begin]), _lists(np.concatenate(out_ids), np.array(sizes), pa.int64()), _lists(np.concatenate(out_scores), np.array(sizes), pa.float32())], schema=FOUND)


def _pooled(pools: pa.Table, found: pa.Table) -> pa.Table:
    """Pools joined with what was found, cut to ``POOL``, and what each expands next."""
    ids, scores = found["ids"].to_pylist(), found["scores"].to_pylist()
    by: dict[int, list[int]] = {}
    for i, row in enumerate(found["node"].to_pylist()):
        by.setdefault(row, []).append(i)
    out = []
    for p in pools.to_pylist():
        done = set(p["done"]) | set(p["todo"])
        best = dict(zip(p["ids"], p["scores"]))
        for i in by.get(p["row"], ()):
            best.update(zip(ids[i], scores[i]))
        order = sorted(best, key=lambda x: (-best[x], x))[:POOL]
        done &= set(order) | set(p["todo"])
        todo = [x for x in order if x not in done][:STEP]
        out.append(p | {"ids": order, "scores": [best[x] for x in order], "done": sorted(done), "todo": todo})
    return _freed(pa.Table.from_pylist(out, schema=pools.schema))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries`` (vec_id) its ``k`` nearest other rows found in ``vectors``.

    Nearness is the inner product in double precision of the given vectors (``vec_id``, ``embedding``), ties to the
    smaller id; if there are fewer than ``k`` other rows, all of them that were found.

    Vectors that are null, empty or zero, or hold a component that is null or not finite, and rows without an id take no part, as
    query or candidate; nor do vectors of another length than most have (of equally frequent lengths, the smallest counts).
    Equal vectors are each a candidate; rows of one id are never each other's candidates. An
    empty table gives no rows; other columns are ignored.
    """
    return Index(vectors).search(queries, k)
