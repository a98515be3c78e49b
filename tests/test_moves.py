"""Logs with moves against a plain replay, one change after another."""

import random

import pytest

from folioscope.operators import moves


def plain(base, log, protected=("_schema.md",)):
    state, told = dict(base), []
    for seq, op, path, dst, v in sorted(log):
        if op != "move":
            if path not in protected:
                state.pop(path, None)
                if op == "upsert":
                    state[path] = v
            continue
        if path in protected or dst in protected or dst is None:
            status = "denied"
        else:
            status = "not-found" if path not in state else "exists" if dst in state else "moved"
        if status == "moved":
            state[dst] = state.pop(path)
        told.append((seq, status))
    return sorted(state.items()), told


def replayed(spark, base, log):
    changes = spark.createDataFrame(log, "seq long, op string, path string, dst string, v long").repartition(3)
    pages, outcome = moves.replay(spark.createDataFrame(base, "path string, v long"), changes)
    return sorted(map(tuple, pages.collect())), sorted((r.seq, r.status) for r in outcome.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, monkeypatch, seed):
    monkeypatch.setattr(moves, "PIECE", 40)
    rng = random.Random(seed)
    names = [f"p{i}" for i in range(14)] + ["_schema.md"]
    log = []
    for seq in rng.sample(range(1000), 160):
        op = rng.choices(["upsert", "delete", "move"], [2, 2, 6])[0]
        log.append((seq, op, rng.choice(names), rng.choice(names) if op == "move" else None, seq))
    log.append((2000, "move", "p1", None, 0))
    base = [(n, -i) for i, n in enumerate(names[::2])]
    assert replayed(spark, base, log) == plain(base, log)


def test_long_chain_cycle_and_swap(spark):
    chain = [(i, "move", f"c{i}", f"c{i + 1}", None) for i in range(300)]
    swap = [(1000, "move", "x", "tmp", None), (1001, "move", "y", "x", None), (1002, "move", "tmp", "y", None), (1003, "delete", "c299", None, None)]
    cycle = [(1100, "move", "a", "b", None), (1101, "move", "b", "a", None), (1102, "move", "a", "a", None), (1103, "move", "none", "none", None)]
    base = [("c0", 7), ("x", 1), ("y", 2), ("a", 3), ("_schema.md", 0)]
    log = chain + swap + cycle
    assert replayed(spark, base, log) == plain(base, log)
    assert dict(plain(base, log)[0]) == {"c300": 7, "x": 2, "y": 1, "a": 3, "_schema.md": 0}


def test_no_changes(spark):
    assert replayed(spark, [("a", 1)], [])[0] == [("a", 1)]
    assert replayed(spark, [], [(1, "move", "a", "b", None)]) == ([], [(1, "not-found")])
