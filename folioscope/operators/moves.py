"""A change log with moves: writes, deletions and renames composed in the order of the log.

Every change of a path ends one interval of the path's history and begins the next.  What lies at a
path during an interval is a known row, known to be nothing, the same as in another interval, or
still open: whether a move takes place depends on what its two paths hold at that moment.  Each round
decides the moves whose inputs tell enough and halves the chains of "the same as"
(pointer jumping), so a chain of renames takes a number of rounds logarithmic in its length, not one
for each rename.  Only paths, sequence numbers and pointers take part; page rows are joined at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import paths as pt
from folioscope.operators.changes import last_changes
from folioscope.session import written

# Changes of one path that a task orders at a time: a path's history is linked piece by piece.
PIECE = 1_000_000


def _held(slot: str) -> Column:
    return F.col(f"{slot}.path").isNotNull() | F.col(f"{slot}.row").isNotNull()


def _previous(slots: DataFrame) -> DataFrame:
    """``slots`` with ``before``: the slot of the same path's change before it; null for its first."""
    pieces = slots.withColumn("_piece", F.floor(F.col("seq") / PIECE))
    inside = pieces.withColumn("before", F.lag("slot").over(Window.partitionBy("path", "_piece").orderBy("seq")))
    ends = pieces.groupBy("path", "_piece").agg(F.max_by("slot", "seq").alias("_end"))
    ends = ends.select("path", "_piece", F.lag("_end").over(Window.partitionBy("path").orderBy("_piece")).alias("_end"))
    return inside.join(ends, ["path", "_piece"]).withColumn("before", F.coalesce("before", "_end")).drop("_piece", "_end")


def replay(base: DataFrame, changes: DataFrame, protected: Sequence[str] = (pt.SCHEMA_PAGE,)) -> tuple[DataFrame, DataFrame]:
    """``(pages, outcome)``: ``base`` after the whole log, and what became of each move.

    ``changes`` has the columns of ``base``, ``op`` (``upsert``, ``delete`` or ``move``), ``dst`` (the target
    of a move) and ``seq``, a number no other change has.  A move takes place if its source exists and its target is free at
    that point of the log, and neither is protected; its outcome is ``moved``, ``not-found``, ``exists`` or ``denied``
    (``seq, path, dst, status``).  A move to its own path finds it taken.  A change whose path is null is ignored.
    """
    guarded = lambda c: F.coalesce(c.isin(list(protected)), F.lit(False)) if protected else F.lit(False)
    is_move = F.col("op") == "move"
    log = changes.where(F.col("path").isNotNull())
    denied = guarded(F.col("path")) | (is_move & (guarded(F.col("dst")) | F.col("dst").isNull()))
    narrow = written(log.where(~denied).select("seq", "op", "path", F.when(is_move, F.col("dst")).alias("dst")), "log")
    moves = narrow.where(is_move)
    touched = moves.select("path").unionByName(moves.select(F.col("dst").alias("path"))).distinct()

    # paths no move touches: the last change stands
    plain = log.where(~guarded(F.col("path")) & (F.col("op") != "move")).join(touched, "path", "left_anti")
    last = last_changes(plain, ["path"])
    calm = base.join(last.select("path"), "path", "left_anti").join(touched, "path", "left_anti").unionByName(last.where("op = 'upsert'").select(*base.columns))

    # slots: what lies at a path after a change; 2 * seq, and 2 * seq + 1 for the target of a move
    busy = narrow.join(touched, "path", "left_semi").where(~is_move | (F.col("path") != F.col("dst")))
    slots = busy.select("path", "seq", (F.col("seq").cast("long") * 2).alias("slot"), "op").unionByName(
        busy.where(is_move).select(F.col("dst").alias("path"), "seq", (F.col("seq").cast("long") * 2 + 1).alias("slot"), "op"))
    first = written(touched.select("path", (-1 - F.monotonically_increasing_id()).alias("first")), "first")
    linked = written(_previous(slots).join(first, "path").select("path", "seq", "slot", "op", F.coalesce("before", "first").alias("before")), "linked")

    at_start = first.join(base.select("path", F.lit(True).alias("_there")), "path", "left").select(
        F.col("first").alias("slot"), F.lit(True).alias("known"), F.when(F.col("_there"), F.col("path")).alias("path"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("same"))
    fixed = linked.where("op != 'move'").select("slot", F.lit(True).alias("known"), F.lit(None).cast("string").alias("path"),
                                                F.when(F.col("op") == "upsert", F.col("seq").cast("long")).alias("row"), F.lit(None).cast("long").alias("same"))
    state = written(at_start.unionByName(fixed), "state-0")
    sides = linked.where("op = 'move'")
    pairs = sides.where("slot % 2 = 0").select("seq", F.col("slot").alias("src_slot"), F.col("before").alias("src")).join(
        sides.where("slot % 2 != 0").select("seq", F.col("slot").alias("dst_slot"), F.col("before").alias("dst")), "seq")
    pairs = written(pairs, "pairs")
    open_moves, turn = pairs, 0
    while True:
        decided = written(_decide(open_moves, state), f"decided-{turn}")
        waiting = decided.where("src_state is null").select("seq", "src_slot", "src", "dst_slot", "dst")
        made = decided.where("src_state is not null")
        made = made.select(F.col("src_slot").alias("slot"), "src_state.*").unionByName(made.select(F.col("dst_slot").alias("slot"), "dst_state.*"))
        turn += 1
        state = written(_jump(state.unionByName(made)), f"state-{turn}")
        left = state.agg(F.count_if(~F.col("known"))).first()[0]
        n = waiting.count()
        open_moves = waiting
        if not n and not left:
            break

    ends = linked.groupBy("path").agg(F.max_by("slot", "seq").alias("slot")).join(first, "path", "right").select("path", F.coalesce("slot", "first").alias("slot"))
    final = ends.join(state.select("slot", F.col("path").alias("_from"), F.col("row").alias("_row")), "slot").drop("slot")
    columns = [c for c in base.columns if c != "path"]
    kept = final.where("_from is not null").join(base.withColumnRenamed("path", "_from"), "_from").select("path", *columns)
    new = final.where("_row is not null").join(log.where("op = 'upsert'").select(F.col("seq").alias("_row"), *columns), "_row").select("path", *columns)
    pages = calm.unionByName(kept.select(*base.columns)).unionByName(new.select(*base.columns))

    seen = lambda name, at: state.select(F.col("slot").alias(at), F.coalesce("path", F.col("row").cast("string")).isNotNull().alias(name))
    told = pairs.select("seq", "src", "dst").join(seen("_src", "src"), "src").join(seen("_dst", "dst"), "dst").select("seq", "_src", "_dst")
    asked = log.where(is_move).select("seq", "path", "dst", denied.alias("_denied")).join(told, "seq", "left")
    own = asked.where("path = dst and not _denied")
    there = _held_at(own, linked, first, state)
    status = F.when(F.col("_denied"), "denied").when(~F.col("_src"), "not-found").when(F.col("_dst"), "exists").otherwise("moved")
    return pages, asked.where("_denied or path != dst or dst is null").select("seq", "path", "dst", status.alias("status")).unionByName(there)


def _decide(moves: DataFrame, state: DataFrame) -> DataFrame:
    """``moves`` with the states after them, null where they cannot be told yet."""
    fields = ["known", "path", "row", "same"]
    given = lambda at: state.select(F.col("slot").alias(at), F.struct(*fields).alias(f"_{at}"))
    rows = moves.join(given("src"), "src", "left").join(given("dst"), "dst", "left")
    known = lambda x: F.coalesce(F.col(f"_{x}.known"), F.lit(False))
    nothing = F.struct(F.lit(True).alias("known"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("same"))
    # what is known is passed on as it is, what is not as a pointer to it
    passed = lambda x: F.when(known(x), F.col(f"_{x}")).otherwise(F.struct(
        F.lit(False).alias("known"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("row"), F.coalesce(F.col(f"_{x}.same"), F.col(x)).alias("same")))
    free, taken, gone = known("dst") & ~_held("_dst"), known("dst") & _held("_dst"), known("src") & ~_held("_src")
    return rows.select("seq", "src_slot", "src", "dst_slot", "dst",
                       F.when(free | gone, nothing).when(taken, passed("src")).alias("src_state"),
                       F.when(gone, passed("dst")).when(free, passed("src")).when(taken, passed("dst")).alias("dst_state"))


def _jump(state: DataFrame) -> DataFrame:
    """Slots that are the same as another take its row, or point to where it points."""
    other = state.select(F.col("slot").alias("same"), F.col("known").alias("_known"), F.col("path").alias("_path"), F.col("row").alias("_row"), F.col("same").alias("_same"))
    open_ = state.where("not known").join(other, "same", "left")
    told = F.coalesce(F.col("_known"), F.lit(False))
    moved = open_.select("slot", told.alias("known"), F.when(told, F.col("_path")).alias("path"), F.when(told, F.col("_row")).alias("row"),
                         F.when(~told, F.coalesce("_same", "same")).alias("same"))
    return state.where("known").unionByName(moved)


def _held_at(asked: DataFrame, linked: DataFrame, first: DataFrame, state: DataFrame) -> DataFrame:
    """Outcome of moves to their own path: taken if it holds a page then, else not found."""
    before = asked.select("seq", "path", "dst").join(linked.select("path", F.col("seq").alias("_s"), "slot"), "path", "left").where("_s is null or _s < seq")
    at = before.groupBy("seq", "path", "dst").agg(F.max_by("slot", "_s").alias("slot"))
    lone = asked.select("seq", "path", "dst").join(at.select("seq", "slot"), "seq", "left").join(first, "path").select("seq", "path", "dst", F.coalesce("slot", "first").alias("slot"))
    there = lone.join(state.select("slot", F.coalesce("path", F.col("row").cast("string")).isNotNull().alias("_t")), "slot")
    return there.select("seq", "path", "dst", F.when(F.col("_t"), "exists").otherwise("not-found").alias("status"))
